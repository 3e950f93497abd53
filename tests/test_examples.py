"""Training examples: missing fields, code without rules, the two ways to look tokens up, triplets of whole examples."""

import pytest

from corvane.operators.tokens import token_vocab
from corvane.plans.examples import training_examples, triplet_examples

ROWS = [
    (1, "def f(x):\n    # note\n    if x:\n        return 1", "Return one", "python"),
    (2, None, None, None),
    (3, "", "", "python"),
    (4, "anything at all", "Cobol", "cobol"),
    (5, "def f(x):\n    # note\n    if x:\n        return 1", "Return one", None),
    (6, "for i in x:\n" * 600, "loop", "python"),
]


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame(ROWS, "doc_id bigint, code string, docstring string, language string")


@pytest.fixture(scope="module")
def vocab(spark):
    return token_vocab(spark.createDataFrame([("def f x if return one for in",)], "text string"))


TYPES = ["module", "function_definition", "if_statement"]


def test_examples(records, vocab):
    out = {r.doc_id: r for r in training_examples(records, vocab, TYPES, 8).collect()}
    assert set(out) == {1, 2, 3, 4, 5, 6} and all(len(r.code_input_ids) == len(r.query_attention_mask) == 8 for r in out.values())
    assert out[1].code_input_ids == out[5].code_input_ids and out[1].graph == out[5].graph and out[5].language == "python"
    assert out[1].code_attention_mask == [1] * 7 + [0] and out[1].code_input_ids[6:] == [1, 0]  # def f x if x return, an unknown one
    ids = {r.token: r.token_id for r in vocab.collect()}
    assert out[1].query_input_ids[:2] == [ids["return"], ids["one"]]
    for empty in (2, 4):
        assert (out[empty].graph.features, out[empty].graph.src, out[empty].graph.dst) == ([0.0] * 4, [], [])
    assert out[3].graph.features[:4] == [0.0, 0.0, 0.0, 1.0]
    assert len(out[6].graph.features) == 4 * 500
    # module, def, comment, if, return: types by the given list, one more id for all others
    assert out[1].graph.features[0::4] == [0.0, 1.0, 3.0, 2.0, 3.0]
    assert sorted(zip(out[1].graph.src, out[1].graph.dst)) == sorted([(0, 1), (1, 0), (1, 2), (2, 1), (1, 3), (3, 1), (3, 4), (4, 3), (2, 3), (3, 2), (1, 3)])


def test_examples_are_narrow_with_a_small_vocabulary(records, vocab):
    assert "Join" not in training_examples(records, vocab, TYPES, 8)._jdf.queryExecution().executedPlan().toString()
    joined = training_examples(records, vocab, TYPES, 8, shipped=0)
    assert sorted(map(str, joined.collect())) == sorted(map(str, training_examples(records, vocab, TYPES, 8).collect()))


def test_triplets_of_whole_examples(records, vocab):
    examples = training_examples(records, vocab, TYPES, 8)
    rows = triplet_examples(examples, 3).collect()
    by_id = {r.doc_id: r for r in examples.collect()}
    assert sorted(r.doc_id for r in rows) == sorted(by_id)
    for r in rows:
        assert r.anchor == r.positive == by_id[r.doc_id] and r.negative == by_id[r.negative.doc_id] and r.negative.doc_id != r.doc_id
    assert triplet_examples(examples.where("doc_id = 1")).count() == 0
    assert training_examples(records.limit(0), vocab, TYPES, 8).count() == 0
