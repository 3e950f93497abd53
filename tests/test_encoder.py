"""Packed graphs against the joins, frozen statistics, the stored encoder and its index."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import gnn, graph as G, graph_blocks
from corvane.operators.outline import outline_nodes, with_outline
from corvane.plans.catalog.fixtures import code_records
from corvane.plans.catalog.graphs import DIM, encoder_weights, fitted_encoder, gat_layers, gcn_layers
from corvane.plans.encoder import CodeEncoder, first_seen_types, index_code
from corvane.plans.retrieval import encode_code
from corvane.runtime import checkpoint
from corvane.sources.index import IndexConfig, VectorIndex

SF_DIR = "/root/testdata/sf0.001"


def collected(df):
    return {(r["doc_id"], r["id"]): np.array(r["x"]) for r in df.collect()}


def close(a, b):
    return a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-9) for k in a)


@pytest.fixture(scope="module")
def small_graphs(spark):
    rng = np.random.default_rng(3)
    nodes = [(d, int(i), [float(v) for v in rng.normal(size=8)]) for d, n in ((1, 6), (2, 1), (-5, 4)) for i in range(n)]
    nodes += [(9, 100, [1.0] * 8), (9, -3, [0.5] * 8)]  # numbers need not be dense
    edges = [(1, 0, 1), (1, 1, 0), (1, 1, 0), (1, 2, 2), (1, 5, 4), (-5, 0, 3), (-5, 3, 0), (9, -3, 100)]
    return spark.createDataFrame(nodes, "doc_id bigint, id bigint, x array<double>"), spark.createDataFrame(edges, "doc_id bigint, src bigint, dst bigint")


@pytest.mark.parametrize("layers", [gcn_layers(2), gat_layers(2)], ids=["gcn", "gat"])
def test_packed_equals_joined(small_graphs, layers):
    nodes, edges = small_graphs
    packed = gnn.node_embeddings(nodes, edges, layers)
    assert close(collected(packed), collected(gnn.node_embeddings(nodes, edges, layers, max_packed=3)))
    assert "Exchange" not in packed._jdf.queryExecution().executedPlan().toString()  # packed once, then every layer in its row


def test_frozen_statistics_both_ways(small_graphs):
    nodes, edges = small_graphs
    layers = gat_layers(2)
    frozen = graph_blocks.fit_statistics(graph_blocks.pack(nodes, edges), graph_blocks.TableReader(), layers)
    whole = collected(gnn.node_embeddings(nodes, edges, layers))
    for most in (10**6, 1):  # in a row, by joins
        one = gnn.node_embeddings(nodes.where("doc_id = -5"), edges.where("doc_id = -5"), layers, frozen, max_packed=most)
        assert close(collected(one), {k: v for k, v in whole.items() if k[0] == -5})


def test_outline_in_a_row_has_the_edges_of_the_tables(spark):
    records = code_records(spark, SF_DIR).limit(40).unionByName(
        spark.createDataFrame([(-1, "", "d", "python", "f"), (-2, None, "d", "python", "f"), (-3, "x", "d", "cobol", "f"), (-4, "if a:\n" * 700, "d", "python", "f")], "doc_id bigint, code string, docstring string, language string, func_name string"),
        allowMissingColumns=True,
    )
    vocab = ["module", "line", "if_statement", "function_definition"]
    reader = graph_blocks.OutlineReader(vocab, np.arange(8.0).reshape(4, 2), np.ones((2, 4)))
    rows = with_outline(records, G.MAX_NODES).select("doc_id", *reader.columns).toArrow().combine_chunks()
    batch = reader.read([rows[c].combine_chunks() for c in reader.columns])
    nodes = outline_nodes(records)
    want = {}
    for e in G.graph_edges(nodes).collect():
        want.setdefault(e.doc_id, []).append((e.src, e.dst))
    first = np.cumsum(batch.sizes) - batch.sizes
    owner = np.repeat(np.arange(len(batch.sizes)), batch.sizes)
    got = {}
    for s, d in zip(batch.src, batch.dst):
        k = owner[s]
        got.setdefault(rows["doc_id"][int(k)].as_py(), []).append((int(s - first[k]), int(d - first[k])))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    sizes = dict(zip(rows["doc_id"].to_pylist(), batch.sizes.tolist()))
    assert (sizes[-1], sizes[-2], sizes[-3], sizes[-4]) == (1, 1, 1, 500)
    at = {d: int(f) for d, f in zip(rows["doc_id"].to_pylist(), first)}
    assert batch.x[at[-3]].tolist() == [0.0, 1.0]  # an empty graph is one zero node of the first type
    brackets = {(r.doc_id, r.id): r for r in nodes.where("type = 'bracket'").collect()}
    key, node = next(iter(brackets.items()))
    unknown = 4.0 + node.depth + node.child_count  # one more id, no vector of its own
    assert batch.x[at[key[0]] + key[1]].tolist() == [unknown, unknown]


def test_types_are_seen_in_one_outline_after_the_spread(spark, tmp_path, capfd):
    code = "def f():\n    if a:\n        return 1\n\n    x = 2\n    return x"
    rows = [(7, code, "python"), (3, "x = 1\nreturn", "java"), (3, "(\nfor i", "java"), (None, "while a", "java"), (9, None, "java"), (1, "class A", "cobol"), (2, "", "python")]
    records = spark.createDataFrame(rows, "doc_id bigint, code string, language string")
    got = [r.type for r in first_seen_types(records).orderBy("type_id").collect()]
    nodes = outline_nodes(records)
    assert got == [r.type for r in G.node_type_vocab(nodes).orderBy("type_id").collect()] and len(got) == 8
    records.write.parquet(str(tmp_path / "r"))
    seen = []
    real, G.node_type_vocab = G.node_type_vocab, seen.append
    try:
        first_seen_types(spark.read.parquet(str(tmp_path / "r")).repartition(3))
    finally:
        G.node_type_vocab = real
    seen[0].explain()
    plan = capfd.readouterr().out
    assert plan.count("split(code") == 1 and "split(" not in plan[plan.index("REPARTITION_BY_NUM") :]


def test_merged_statistics():
    rng = np.random.default_rng(1)
    parts = [rng.normal(3, 2, size=(n, 5)) for n in (1, 7, 30)]
    n, mean, spread = graph_blocks._merge([(len(p), p.mean(0), ((p - p.mean(0)) ** 2).sum(0)) for p in parts])
    rows = np.vstack(parts)
    assert n == 38 and np.allclose(mean, rows.mean(0)) and np.allclose(spread / n, rows.var(0))


@pytest.fixture(scope="module")
def encoder(spark):
    return fitted_encoder(spark, SF_DIR)


def vectors(df, key="doc_id"):
    return {r[key]: np.array(r["vec"]) for r in df.select(key, "vec").collect()}


def test_one_record_alone_equals_its_row_in_the_corpus(spark, encoder):
    records = code_records(spark, SF_DIR)
    whole = vectors(encoder.encode(records))
    for doc in list(whole)[:3]:
        alone = vectors(encoder.encode(records.where(F.col("doc_id") == doc)))
        assert np.allclose(alone[doc], whole[doc], atol=1e-12)
    vocab = first_seen_types(records)
    fitted = CodeEncoder.fit(records, encoder_weights(vocab), DIM, vocab)
    assert {k: v.round(9).tolist() for k, v in vectors(fitted.encode(records)).items()} == {
        k: v.round(9).tolist() for k, v in vectors(encode_code(records, encoder_weights(vocab), vocab, DIM)).items()
    }


def test_encoding_is_narrow_and_keeps_columns(spark, encoder):
    records = checkpoint(code_records(spark, SF_DIR).withColumn("types", F.lit("mine")))
    out = encoder.encode(records)
    assert out.columns == [*records.columns, "vec"] and out.first()["types"] == "mine"
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()


def test_snippets_with_nulls_and_without_rows(spark, encoder):
    rows = spark.createDataFrame([(1, None, None), (2, "", None), (3, "def f():\n    return 1", None), (4, "def f():\n    return 1", "python"), (5, "x", "cobol")], "doc_id bigint, code string, language string")
    out = {r.doc_id: r for r in encoder.embed_snippets(rows).collect()}
    assert {len(r.embedding) for r in out.values()} == {16} and {r.dimension for r in out.values()} == {16}
    assert out[3].embedding == out[4].embedding != out[2].embedding
    assert encoder.embed_snippets(rows.limit(0)).count() == 0


def test_loads_do_not_matter(spark, encoder, tmp_path):
    records = code_records(spark, SF_DIR).limit(60)
    schema = "code string, docstring string, language string, func_name string"
    found = []
    for loads in (1, 3):
        index = VectorIndex.create(spark, str(tmp_path / f"i{loads}"), IndexConfig(16), schema)
        for k in range(loads):
            index_code(index, encoder, records.where(F.col("doc_id") % loads == k), ingest=f"{k}")
        found.append({r.vec_id: (r.embedding, r.func_name) for r in index.vectors().collect()})
    assert found[0] == found[1] and len(found[0]) == 60


def test_an_outline_that_is_there_is_not_made_again(spark, monkeypatch):
    from corvane.operators import outline as O
    from corvane.plans import retrieval

    records = code_records(spark, SF_DIR).select("doc_id", "code", "language")
    vocab = first_seen_types(records)
    weights = encoder_weights(vocab)
    plain = CodeEncoder.fit(records, weights, DIM, vocab, 9)
    packed = checkpoint(with_outline(records).select("doc_id", "_types", "_parents", "_depths", "_children"))

    def again(*args):
        raise AssertionError("parsed again")

    monkeypatch.setattr(O, "with_outline", again)
    monkeypatch.setattr(retrieval, "with_outline", again)
    assert sorted(first_seen_types(packed).collect()) == sorted(vocab.collect())
    fitted = CodeEncoder.fit(packed, weights, DIM, vocab, 9)
    for a, b in zip(plain.statistics, fitted.statistics):
        assert np.allclose(a, b, atol=1e-9)
