"""Nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names; and the parts by themselves."""

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import bpe, chat, exact_dedup, html_blocks, language, minhash, phrases, pii, quality, suffix
from corvane.llm.chat import rotate
from corvane.llm.common import SMALL_SLICE_BYTES, by_slices, byte_slices, keep_rows
from corvane.llm.queries import ranks_path

LONG = " ".join(f"word{k % 977} number{k % 31}" for k in range(40_000))
PASSAGE = "this passage of rather many bytes is found in more than one of the documents here"
ROWS = [
    (1, "Alpha beta gamma delta epsilon"),
    (2, "alpha  BETA gamma delta epsilon"),
    (3, None),
    (4, ""),
    (5, "one two"),
    (5, "one two"),
    (None, "no id but text " + PASSAGE),
    (6, PASSAGE + " x"),
    (7, "y " + PASSAGE),
    (8, LONG),
    (9, LONG + " end"),
    (10, "\x00\t 　é😀"),
]
CLASH = ["class", "bucket", "row", "id", "_id", "digest", "key", "place", "component", "kept", "node", "sig", "n", "lang", "term", "pos", "doc", "score", "_once"]


@pytest.fixture(scope="module")
def table(spark):
    df = spark.createDataFrame(ROWS, "doc_id bigint, text string")
    return df.select("*", *[F.lit("x").alias(c) for c in CLASH])


@pytest.fixture(scope="module")
def empty(table):
    return table.where("false")


def by_id(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.doc_id, []).append(r)
    return out


ITEMS = [(1, "beta gamma delta"), (2, None), (3, ""), (4, "two"), (5, "number1 word2 number2 word3 number3 word4 number4 word5 number5 word6 number6 word7")]


def runs(spark):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    net = quality.Network.start(1)
    learn = spark.createDataFrame([(1, "the cat is here", "en"), (2, "der Hund ist da", "de"), (3, None, "de"), (4, "x", None)], "doc_id bigint, text string, lang string")
    return {
        "pii": pii.find_pii,
        "exact": exact_dedup.exact_dedup,
        "quality": lambda d: quality.score_documents(d, net),
        "filter": lambda d: quality.filter_documents(d, net, 0.0),
        "phrases": lambda d: phrases.decontaminate(d, items),
        "near": minhash.near_duplicates,
        "language": lambda d: language.predict(d, *language.fit(learn, F.lit(True))),
        "bpe": lambda d: bpe.encode_documents(d, ranks_path()),
        "suffix": suffix.remove_shared_passages,
    }


@pytest.mark.parametrize("name", ["pii", "exact", "quality", "filter", "phrases", "near", "language", "bpe", "suffix"])
def test_every_row_once_and_empty_tables(spark, table, empty, name):
    run = runs(spark)[name]
    got = by_id(run(table))
    assert {k: len(v) for k, v in got.items()} == {k: sum(i == k for i, _ in ROWS) for k in {i for i, _ in ROWS}}
    assert run(empty).count() == 0


def test_exact_ties_and_repeats(table):
    got = by_id(exact_dedup.exact_dedup(table))
    assert [(r.keep_id, r.group_size, r.kept) for r in got[3] + got[4]] == [(3, 2, True), (3, 2, False)]
    assert sorted(r.kept for r in got[5]) == [False, True] and got[5][0].group_size == 2
    assert got[None][0].keep_id is None and got[None][0].kept
    assert got[1][0].keep_id == 1 and got[2][0].keep_id == 2


@pytest.mark.parametrize("n", [0, 1, 2, 5_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 256, (n, 32), dtype="u1")
    mph = exact_dedup.PerfectHash.from_bytes(*exact_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(mph.slots(keys).tolist()) == list(range(n))


def test_exact_history_does_not_change_the_result(table):
    every = lambda cond: sorted(map(str, exact_dedup.exact_dedup(table, cond).drop("in_history").collect()))
    assert every(F.lit(True)) == every(F.lit(False)) == every(F.col("doc_id") % 2 == 0)


def test_phrases_and_proximity(spark, table):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = by_id(phrases.decontaminate(table, items))
    assert [(r.n_words, r.n_hit, r.n_items) for r in got[2]] == [(5, 3, 1)]
    assert [(r.n_words, r.n_hit, r.n_items) for r in got[3] + got[4]] == [(0, 0, 0)] * 2
    assert [(r.n_words, r.n_hit) for r in got[5]] == [(2, 1)] * 2
    assert all(not r.contaminated for r in by_id(phrases.decontaminate(table, items.where("false")))[1])
    docs = spark.createDataFrame([(1, "a rare b c"), (2, "rare x b x c"), (3, "rare c b"), (4, "c x x x rare b")], "doc_id bigint, text string")
    wanted, _ = phrases.phrases(spark.createDataFrame([(1, "rare b c")], "item_id bigint, text string"))
    index = phrases.build_index(docs)
    near = lambda slop: sorted(r.doc for r in phrases.matches(index, wanted, slop).select("doc").distinct().collect())
    assert (near(0), near(1), near(2)) == ([1], [1, 3], [1, 2, 3])


def test_a_look_up_reads_the_buckets_of_its_terms(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").repartition(3)
    index = phrases.build_index(docs)
    everything = index.postings.inputFiles()
    read = lambda df: {r[0] for r in df.select("_metadata.file_path").distinct().collect()}
    one = index.counts.orderBy(F.desc("count")).limit(1).select("term")
    found = index.of(one)
    assert "PartitionFilters: [" in found._jdf.queryExecution().executedPlan().toString()
    files = read(found)
    assert 0 < len(files) < len(set(everything)) / 10
    assert found.join(one, "term", "left_semi").count() == index.counts.agg(F.max("count")).first()[0]
    many = index.counts.limit(500).select("term")
    assert index.of(many).join(many, "term", "left_semi").count() == index.counts.join(many, "term", "left_semi").agg(F.sum("count")).first()[0]
    assert index.postings.count() == index.counts.agg(F.sum("count")).first()[0] == index.documents.agg(F.sum("n_words")).first()[0]


def test_phrases_of_rows_that_repeat_an_id(spark):
    items = spark.createDataFrame([(1, "rare b c")], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "rare x"), (1, "y b c"), (2, "rare b c"), (2, "clean"), (None, "z")], "doc_id bigint, text string")
    got = sorted((r.doc_id or 0, r.n_words, r.n_hit, r.contaminated) for r in phrases.decontaminate(docs, items).collect())
    assert got == [(0, 1, 0, False), (1, 2, 0, False), (1, 3, 0, False), (2, 1, 0, False), (2, 3, 3, True)]


def test_near_duplicates(table):
    got = by_id(minhash.near_duplicates(table))
    assert got[1][0].component_id == got[2][0].component_id == 1
    assert [(r.n_shingles, r.component_id, r.kept) for r in got[3] + got[4]] == [(0, 3, True), (0, 4, True)]
    assert sorted(r.kept for r in got[5]) == [False, True] and got[5][0].n_shingles == 1
    assert got[9][0].component_id == 8 and got[None][0].component_id is None


def test_hamming_join_finds_all_within_the_distance(spark):
    draw = np.random.default_rng(3)
    base = draw.integers(0, 1 << 16, minhash.SYMBOLS, dtype="u2")
    sigs = [base]
    for k in range(60):
        other = base.copy()
        at = draw.choice(minhash.SYMBOLS, minhash.MAX_DISTANCE if k % 2 else k % 16, replace=False)
        other[at] += 1
        sigs.append(other)
    keys = minhash.chunk_keys(np.array(sigs))
    assert all(set(keys[0].tolist()) & set(row.tolist()) for row in keys[1:])
    nodes = spark.createDataFrame([(k, bytearray(s.tobytes())) for k, s in enumerate(sigs)], "node bigint, sig binary")
    found = minhash.components(minhash.hamming_edges(nodes)).collect()
    assert {r.node: r.component for r in found} == dict.fromkeys(range(61), 0)


def test_near_duplicates_over_blocks(spark, monkeypatch):
    draw = random.Random(5)
    base = [f"w{k}" for k in range(120)]
    docs = []
    for k in range(60):
        words = list(base)
        for at in draw.sample(range(120), k % 9):
            words[at] = f"v{draw.random()}"
        docs.append((k, " ".join(words)))
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    whole = sorted(map(str, minhash.near_duplicates(df).collect()))
    monkeypatch.setattr(minhash, "BLOCK_BYTES", 10_000)
    assert sorted(map(str, minhash.near_duplicates(df).collect())) == whole
    monkeypatch.setattr(minhash, "RUN", 3)
    assert sorted(map(str, minhash.near_duplicates(df).collect())) == whole


def test_links_between_members_that_were_skipped():
    # Two clusters, a1 - a2 and b1 - b2, b3, b4, and one link a2 - b2 between them.
    ids = iter(range(1 << 20))
    take = lambda k: [next(ids) for _ in range(k)]
    moved = lambda base, at: base[:at] + base[at + 14 :] + take(14)
    core = take(192)
    a2, b2 = core + take(14), core + take(14)
    a1, b1 = moved(a2, 0), moved(b2, 20)
    sets = [a1, a2, b1, b2, moved(b1, 50), moved(b1, 70)]
    # Small sets that share one string with a member: a1, a2, b1 and b2 are looked at in this order.
    for k, n in enumerate((1000, 700, 400, 200)):
        own = take(1)
        sets[k] = sets[k] + own
        sets += [own + take(3) for _ in range(n)]
    sets = [np.array(sorted(s), "u8") for s in sets]
    forest = minhash.Forest(len(sets))
    for a, b in minhash.links(np.arange(len(sets)), sets, np.ones(len(sets), bool)):
        forest.join(a, b)
    assert [forest.root(k) for k in range(7)] == [0, 0, 0, 0, 0, 0, 6]


def test_components(spark):
    chain = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    got = {r.node: r.component for r in minhash.components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}
    assert minhash.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_shared_passages(table):
    got = by_id(suffix.remove_shared_passages(table, with_text=True))
    assert bytes(got[7][0].kept) == b"y " and got[6][0].n_removed == 0
    assert got[None][0].n_removed == len(PASSAGE) + 1 and got[5][0].n_removed == got[5][1].n_removed == 0
    assert got[9][0].n_removed == len(LONG) + 1 and bytes(got[9][0].kept) == b"end"


def test_merge_steps_only_rows_that_may_repeat(monkeypatch):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 200, 6_000).astype("u1")
    segments = {bytes(base[k : k + n]) for k, n in zip(rng.integers(0, 5_900, 300), rng.integers(50, 80, 300))}
    segments |= {bytes(rng.integers(0, 256, 60).astype("u1")) for _ in range(300)}
    segments = sorted(segments)
    sizes, ids = np.array([len(s) for s in segments]), rng.integers(-9, 1_000, len(segments))
    stepped, argsort = [], np.argsort

    def counted(a, *args, kind=None, **more):
        stepped.append(len(a) if kind == "stable" else 0)
        return argsort(a, *args, kind=kind, **more)

    monkeypatch.setattr(suffix, "SHARD_SEGMENTS", 100)
    monkeypatch.setattr(suffix.np, "argsort", counted)
    low = suffix.repeated_intervals(np.frombuffer(b"".join(segments), "u1"), sizes, ids)
    monkeypatch.undo()
    strings = [(s[k : k + 50], i) for s, i in zip(segments, ids) for k in range(len(s) - 49)]
    least = {}
    for s, i in strings:
        least[s] = min(i, least.get(s, i))
    assert low.tolist() == [least[s] for s, _ in strings]
    alone = len(least) - sum(c > 1 for c in Counter(s for s, _ in strings).values())
    assert sum(stepped) <= suffix.LENGTH * (len(strings) - alone) + 2 * suffix.LONE_STEPS * alone


def test_language_without_letters(spark, table):
    got = by_id(runs(spark)["language"](table))
    assert {r.lang_pred for r in got[3] + got[4]} == {"und"} and got[1][0].lang_pred in ("de", "en")


def test_language_tables_like_the_array_model(spark, monkeypatch):
    common = [(k, f"the cat number {'abcdefghij'[k % 10]} and the dog are here in the house", "en") for k in range(30)]
    rare = [(100, "der Hund läuft", "de"), (101, "猫が好き", "ja"), (102, "le chat", "fr")]
    docs = spark.createDataFrame([*common, *rare, (103, None, "en"), (104, "12", "fr"), (105, "x", None), (None, "zzz qqq", None)], "doc_id bigint, text string, lang string")
    fitted = language.fit(docs, F.lit(True))
    want = by_id(language.predict(docs, *fitted))
    monkeypatch.setattr(language, "MAX_NGRAMS", 20)
    model, sharpness, highest = language.fit(docs, F.lit(True))
    assert model.langs == fitted[0].langs == ["de", "en", "fr", "ja"] and sharpness == pytest.approx(fitted[1])
    assert highest == pytest.approx(fitted[2])
    got = by_id(language.predict(docs, model, sharpness, np.nextafter(highest, np.inf) + 1e-9))
    assert {k: [(r.lang_pred, r.accepted) for r in v] for k, v in got.items()} == {k: [(r.lang_pred, r.accepted) for r in v] for k, v in want.items()}
    assert [got[k][0].lang_pred for k in (100, 101, 102)] == ["de", "ja", "fr"]
    for k in want:
        assert (got[k][0].score, got[k][0].cross_entropy) == pytest.approx((want[k][0].score, want[k][0].cross_entropy), abs=1e-6)


def test_quality_keeps_all_columns(spark, table):
    kept = quality.filter_documents(table, quality.Network.start(1), 0.0)
    assert kept.columns == table.columns and kept.count() == len(ROWS)
    one = quality.train([b"a"], np.array([1.0], "f4"), 0.9)
    assert 0 < quality.sigmoid(quality.logits(one, np.empty(0, "u1"), np.array([0, 0])))[0] < 1


def test_quality_gradients():
    net = quality.Network.start(4)
    for a in net.arrays():
        a[...] = a.astype("f4")
    data = np.frombuffer(b"some text, long enough to be in several steps. " * 20, "u1")
    offsets, label = np.array([0, 300, len(data)]), np.array([0.0, 1.0], "f4")

    def loss():
        p = quality.sigmoid(quality.logits(net, data, offsets))
        return float(-(label * np.log(p) + (1 - label) * np.log(1 - p)).mean())

    for a, g in zip(net.arrays(), quality.gradients(net, data, offsets, label)):
        k = int(np.abs(g).argmax())
        old = a.flat[k]
        a.flat[k] = old + 1e-2
        up = loss()
        a.flat[k] = old - 1e-2
        down = loss()
        a.flat[k] = old
        assert abs((up - down) / 2e-2 - g.flat[k]) < 0.1 * abs(g.flat[k]) + 1e-3


def test_pii_patterns_and_decoding():
    draw = random.Random(2)
    email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
    ip = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    for _ in range(5_000):
        text = "".join(draw.choice("a1@.é -") for _ in range(draw.randint(0, 25)))
        assert list(pii._emails(text)) == [m.span() for m in email.finditer(text)]
        text = "".join(draw.choice("12..a") for _ in range(draw.randint(0, 25)))
        assert [m.span() for m in pii._IP.finditer(text)] == [m.span() for m in ip.finditer(text)]
    weights, moves = pii.train()
    for text, spans in pii._labelled():
        points = np.array([ord(c) for c in text], "u4")
        start, _, shape = pii.shapes(points, np.array([0, len(points)]))
        emit = pii.emissions(weights, shape, np.zeros(len(start), "i8"))
        cut, whole = pii.decode(emit, np.zeros(len(start), "i8"), moves), np.zeros(len(start), "i8")
        pii._viterbi(emit, np.array([0]), np.array([len(start)]), moves, whole)
        assert cut.tolist() == whole.tolist()
        assert [int(x) for x in cut] == [next((k for a, b, k in spans if a <= s < b), 0) for s in start.tolist()]


def test_bpe_appends_and_edits():
    vocabulary = bpe.Vocabulary(bpe.read_ranks(ranks_path()))
    draw = random.Random(9)
    for _ in range(200):
        piece = bytes(draw.choice(b"aeinrstth ndo") for _ in range(draw.randint(1, 40)))
        encoder = bpe.PrefixEncoder(vocabulary, piece[:3]).append(piece[3:])
        assert encoder.ids() == bpe.PrefixEncoder(vocabulary, piece).ids()
        a, b = sorted((draw.randint(0, len(piece)), draw.randint(0, len(piece))))
        assert encoder.edit(a, b, b"the").ids() == bpe.PrefixEncoder(vocabulary, piece[:a] + b"the" + piece[b:]).ids()


def test_bpe_pieces():
    import regex

    draw = random.Random(4)
    alphabet = "ab s't'rellm  \n\t\r\x0b'd'veΩé中1²Ⅷ９　\xa0_-!😀\x1c\x85"
    texts = ["".join(draw.choice(alphabet) for _ in range(draw.randint(0, 40))) for _ in range(3_000)]
    data = "".join(texts).encode()
    offsets = np.append(0, np.cumsum([len(t.encode()) for t in texts]))
    points, at, _ = bpe.code_points(np.frombuffer(data, "u1"), offsets)
    starts = set(bpe.piece_starts(points, at).tolist())
    want, base = set(), 0
    for text in texts:
        want.update(base + m.start() for m in regex.finditer(bpe.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"), text))
        base += len(text)
    assert starts == want


def test_html_edges(spark):
    pages = [
        (1, "u", None),
        (2, "u", ""),
        (3, "u", "<script>if (a<b) {'</p>'}</script><article><p>Kept &lt;b&gt; &amp here<p>And\n  this<!-- not <p>this</p> --></article>"),
        (4, "u", "<article><p>Text</p><div class='comments'><p>Reader says something quite long about it all</p></div><aside>More</aside></article>"),
        (4, "u", "<article><p>Text"),
        (5, None, '<article title="a > b"><p>In</p></article><p class="cookie-notice">We use cookies</p>'),
    ]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumn("text", F.lit("clash"))
    got = {(r.page_id, r.text) for r in html_blocks.extract(df).collect()}
    assert got == {(1, ""), (2, ""), (3, "Kept <b> & here\nAnd this"), (4, "Text"), (5, "In")}
    assert html_blocks.extract(df.where("false")).count() == 0


def test_chat_edges(spark):
    turns = [(1, 0, "system", "be nice"), (1, 1, "ann", "hi"), (1, 2, "bob", None), (1, 2, "bob", None), (2, None, None, "x"), (None, 1, "ann", "y"), (3, 0, "system", "alone")]
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").withColumn("block", F.lit(1)).withColumn("start", F.lit(2))
    out = rotate(df).collect()
    one = sorted((r for r in out if r.conv_id == 1 and r.speaker == "ann"), key=lambda r: r.start)
    whole = "".join(r.rendered for r in one)
    assert whole == "<|system|>\nbe nice<|end|>\n<|assistant|>\nhi<|end|>\n" + 2 * "<|user name=bob|>\n<|end|>\n"
    assert [whole[r.mask_start : r.mask_stop] for r in one if r.mask_start is not None] == ["hi"]
    assert {(r.conv_id, r.speaker) for r in out} == {(1, "ann"), (1, "bob"), (2, "unknown"), (None, "ann")}
    assert rotate(df.where("false")).count() == 0


def test_keep_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b"), (None, "c")], "doc_id bigint, text string")
    decided = spark.createDataFrame([(1, False), (2, True), (2, False), (None, False)], "doc_id bigint, kept boolean")
    assert [tuple(r) for r in keep_rows(docs, decided).collect()] == [(2, "b")]


@pytest.mark.parametrize("files", [True, False])
def test_pipeline_stages_decide_by_row(spark, tmp_path, files):
    items = spark.createDataFrame([(1, "rare b c")], "item_id bigint, text string")
    items.write.parquet(f"{tmp_path}/benchmark.parquet")
    long = " ".join(f"w{k}" for k in range(200))
    texts = [(None, "rare b c"), (None, "clean one"), (None, "clean two"), (None, "clean two"), (None, long), (None, long + " end"), (7, "rare b c"), (7, "other"), (8, "clean two")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(3)
    if files:
        docs.write.parquet(f"{tmp_path}/documents.parquet")
        docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    left = lambda stage: sorted(r.text for r in stage(spark, docs, str(tmp_path)).collect())
    every = sorted(t for _, t in texts)
    once = sorted(set(every))
    assert left(corpus_pipeline.distinct_texts) == once
    near = left(corpus_pipeline.no_near_copies)
    assert len(near) == len(once) - 1 and {t for t in near if len(t) < 100} == {t for t in once if len(t) < 100}
    assert left(corpus_pipeline.no_benchmark) == [t for t in every if t != "rare b c"]


def test_slices_cover_everything():
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array(["a" * 10, "", "b" * 50, None, "c", "", "d" * 9])], names=["id", "text"])
    parts = [(p.num_rows, d.tobytes()) for p, d, _ in byte_slices(batch, most=12)]
    assert sum(n for n, _ in parts) == 7 and b"".join(d for _, d in parts) == b"a" * 10 + b"b" * 50 + b"c" + b"d" * 9


def test_a_batch_gives_back_what_it_took():
    def held():
        with open("/proc/self/smaps_rollup") as file:
            return int(re.search(r"Pss_Anon:\s+(\d+)", file.read())[1]) >> 10

    parts = [np.ones(8_000) for _ in range(4_000)]  # 256 MB in pieces that the allocator keeps
    before, last = held(), parts[-1]
    del parts
    assert len(list(byte_slices(pa.RecordBatch.from_pydict({"text": ["a", None]})))) == 1
    assert held() < before - 150 and last.sum() == 8_000


def test_operators_of_the_pipeline_take_small_slices(monkeypatch):
    sizes = {}

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    docs = Docs()
    docs.schema = None
    for module, name in ((bpe, "id_text"), (quality, "id_text"), (quality, "spread_small")):
        monkeypatch.setattr(module, name, lambda *a: docs)
    net = quality.Network.start(1)
    texts = ["word and other " * 20_000, *["some words of a text " * 50] * 1_000, None, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts)), pa.int64()), pa.array([t or "" for t in texts])], names=["id", "text"])

    def watched(name, module, what, run):
        real = getattr(module, what)
        monkeypatch.setattr(module, what, lambda *a: (sizes.setdefault(name, []).append(len(a[-2])), real(*a))[1])
        return sum(b.num_rows for b in run(iter([batch])))

    assert watched("encode", bpe, "code_points", bpe.encode_documents(None, ranks_path())) == len(texts)
    assert watched("score", quality, "logits", quality.score_documents(None, net)) == len(texts)
    assert watched("filter", quality, "logits", quality.filter_documents(docs, net, 0.0)) == len(texts)
    for taken in sizes.values():
        assert {n for n in taken if n > SMALL_SLICE_BYTES} == {len(texts[0])}  # one text is never cut


def test_slices_let_go_of_the_last_batch():
    def held():
        with open("/proc/self/smaps_rollup") as file:
            return int(re.search(r"Pss_Anon:\s+(\d+)", file.read())[1]) >> 10

    def batches():
        yield pa.RecordBatch.from_pydict({"text": [None]})
        yield pa.RecordBatch.from_arrays([pa.array(["a" * (1 << 20)] * 200)], names=["text"])

    before = held()
    rows = [b.num_rows for b in by_slices(lambda part, data, offsets: pa.RecordBatch.from_pydict({"n": offsets[1:]}), batches())]
    assert sum(rows) == 201 and list(by_slices(None, iter([]))) == []
    assert held() < before + 50


def test_classes_without_an_object_for_each_code_point():
    bpe.classes.cache_clear()
    tracemalloc.start()
    kinds = bpe.classes()
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [int(kinds[ord(c)]) for c in "a\u00e91\u0660 \u2028-"] == [bpe.LETTER] * 2 + [bpe.NUMBER] * 2 + [bpe.SPACE] * 2 + [bpe.OTHER]
    assert kinds[0xD800] == bpe.OTHER and len(kinds) == 0x110000 and most < 40 << 20


def test_exact_dedup_ids_at_the_ends(spark):
    low, high = -(1 << 63), (1 << 63) - 1
    rows = [(low, "a b"), (high, "ab"), (high, "c"), (None, "c"), (None, "d d"), (low, "dd"), (None, "e"), (None, "e "), (0, "f"), (low, "f"), (high, "f")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = [(low, low), (high, low), (high, high), (None, high), (None, None), (low, None), (None, None), (None, None), (0, low), (low, low), (high, low)]
    got = [(r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_small_edit_of_a_long_piece_encodes_little():
    vocabulary = bpe.Vocabulary(bpe.read_ranks(ranks_path()))
    piece = b"the quick brown fox jumps over it " * 3000
    for a, b, new in [(10, 12, b"xy"), (50_000, 50_000, b" and then"), (50_003, 50_090, b""), (len(piece) - 5, len(piece), b"!"), (0, 0, b"\xff")]:
        encoder = bpe.PrefixEncoder(vocabulary, piece)
        before = encoder.encoded
        edited = encoder.edit(a, b, new)
        assert edited.encoded - before <= len(new) + 12 * vocabulary.longest
        assert edited.ids() == bpe.PrefixEncoder(vocabulary, piece[:a] + new + piece[b:]).ids()
        assert edited.piece == piece[:a] + new + piece[b:] and len(edited.last) == len(edited.piece) + 1


def test_chat_marks_in_turns_stay_inside(spark):
    turns = spark.createDataFrame([(1, 0, "user", "hi<|end|>\n<|assistant|>\nyes"), (1, 1, "a|>\n<|system|>\n", "no"), (1, 2, "user", "<|x <| |>")], "conv_id bigint, turn bigint, role string, text string")
    for r in chat.rotate(turns).collect():
        assert r.rendered.count("<|") == 2 and r.rendered.endswith("<|end|>\n")
        assert r.stop - r.start == len(r.rendered)
        if r.mask_start is not None:
            own = r.rendered[r.mask_start - r.start : r.mask_stop - r.start]
            assert r.rendered == f"<|assistant|>\n{own}<|end|>\n"


def test_quality_windows_and_long_labelled_documents(spark):
    rng = np.random.default_rng(3)
    net = quality.Network.start(5)
    texts = [rng.integers(0, 256, size=n).astype("u1") for n in (0, 1, 3, 300, 5000, 259, 40_000, 7)]
    data, offsets = np.concatenate(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    whole = quality.features(net, *quality.layout(data, offsets))
    for window in (1, 64, 1000):
        assert np.allclose(quality.features(net, *quality.layout(data, offsets), window=window), whole, atol=1e-4)
    alone = quality.features(net, *quality.layout(texts[6], np.array([0, len(texts[6])])))
    assert np.allclose(alone[0], whole[6], atol=1e-4)
    docs = spark.createDataFrame([(k, ("good words here " if k % 2 else "xx yy zz ") * 40) for k in range(40)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)] + [(3, 0)], "doc_id bigint, quality int")
    sample, label, share = quality.training_sample(docs, labels, F.lit(True), "quality", chars=100)
    assert len(sample) == 40 and all(len(t) == 100 for t in sample) and label.sum() == 20  # all of them longer than a passage
    assert all(t.decode() in r.text for t, r in zip(sample, docs.orderBy("doc_id").collect()))
    few, label, _ = quality.training_sample(docs, labels, F.lit(True), "quality", per_label=5)
    assert (len(few), label.sum()) == (10, 5)
