import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.functions import matrix, vectors as V
from corvane.functions.matrix import linear, linear_join, load_matrix
from corvane.operators import encode as N
from corvane.operators import gnn as P
from corvane.operators import graph as G
from corvane.operators.tokens import embed_text


def frame(spark, rows, cols="a array<double>, b array<double>"):
    return spark.createDataFrame(rows, cols)


def test_zero_vectors(spark):
    row = frame(spark, [([0.0, 0.0], [3.0, 4.0])]).select(
        V.l2_normalize(F.col("a")).alias("z"), V.l2_normalize(F.col("b")).alias("u"), V.cosine(F.col("a"), F.col("b")).alias("c")
    ).first()
    assert row.z == [0.0, 0.0] and row.u == pytest.approx([0.6, 0.8]) and row.c == 0.0


def test_layer_norm_scale_and_shift(spark):
    gamma, beta = F.array(F.lit(2.0), F.lit(2.0), F.lit(1.0)), F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))
    got = frame(spark, [([1.0, 2.0, 6.0], [])]).select(V.layer_norm(F.col("a"), gamma, beta)).first()[0]
    x = np.array([1.0, 2.0, 6.0])
    n = (x - x.mean()) / np.sqrt(x.var() + 1e-5)
    assert got == pytest.approx(list(n * [2, 2, 1] + [1, 0, 0]))


def test_linear_on_empty_frame_and_weight_table(spark):
    w = np.array([[1.0, 2.0], [0.0, -1.0], [1.0, 1.0]])
    table = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(3) for j in range(2)], "i int, j int, w double")
    assert (load_matrix(table) == w).all()
    df = frame(spark, [([1.0, 1.0], [])])
    assert df.select(linear(F.col("a"), w, np.array([0.0, 0.0, 1.0]), "relu")).first()[0] == [3.0, 0.0, 3.0]
    assert df.where("false").select(linear(F.col("a"), w)).collect() == []


def test_attention_with_projections(spark):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 8))
    proj = {n: rng.normal(size=(8, 8)) for n in ("q", "k", "v", "out")}
    got = frame(spark, [(a.tolist(), b.tolist())]).select(N.self_attention(F.col("a"), F.col("b"), 2, proj)).first()[0]
    x = np.stack([a, b])
    q, k, v = (x @ proj[n].T for n in ("q", "k", "v"))
    out = np.zeros((2, 8))
    for h in (slice(0, 4), slice(4, 8)):
        e = np.exp(q[:, h] @ k[:, h].T / 2.0)
        out[:, h] = e / e.sum(1, keepdims=True) @ v[:, h]
    assert got == pytest.approx(list((out @ proj["out"].T).mean(0)))


def test_unknown_methods():
    for call in (lambda: N.fuse("sum", None, None), lambda: N.pool_tokens(None, "median")):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("width", [None, 2])
def test_all_masked_pooling(spark, width):
    rows = [(1, 0, [1.0, 5.0], 0), (1, 1, [2.0, 9.0], 0), (2, 0, [1.0, 3.0], 1), (2, 1, [8.0, 0.0], 0)]
    tokens = spark.createDataFrame(rows, "doc_id long, pos int, vec array<double>, mask int")
    mean = {r.doc_id: r.vec for r in N.pool_tokens(tokens, "mean", width=width).collect()}
    assert mean[1] == [0.0, 0.0] and mean[2] == pytest.approx([-1.0, 1.0], abs=1e-4)
    top = {r.doc_id: r.vec for r in N.pool_tokens(tokens, "max", width=width).collect()}
    assert top[1] == [0.0, 0.0] and top[2] == pytest.approx([-1.0, 1.0], abs=1e-4)


def chain(spark, sizes):
    rows = [(d, i, "if_statement" if i % 2 else "line", max(i - 1, 0) if i else None, i, True, 1) for d, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "doc_id long, id int, type string, parent_id int, depth int, is_named boolean, child_count int")


def test_cap_cuts_edges_and_one_pass_equals_three(spark):
    nodes = chain(spark, {1: 7, 2: 1})
    got = sorted(tuple(r) for r in G.graph_edges(nodes, 5).collect())
    parts = [f(nodes, 5) for f in (G.tree_edges, G.sibling_edges, G.control_flow_edges)]
    assert got == sorted(tuple(r) for p in parts for r in p.collect())
    assert max(max(r[1], r[2]) for r in got) == 4 and not any(r[0] == 2 for r in got)


def test_empty_graph_and_batch_offsets(spark):
    nodes = chain(spark, {1: 3, 3: 2})
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long")
    feat = G.with_empty_graphs(G.node_features(nodes, G.node_type_vocab(nodes)), docs)
    assert [r.x for r in feat.where("doc_id = 2").collect()] == [[0.0] * 4]
    batches = docs.withColumn("batch_id", F.lit(0).cast("bigint"))
    stacked, edges = G.graph_batch(feat, G.tree_edges(nodes), batches)
    assert sorted(r.node for r in stacked.collect()) == list(range(6))
    assert {(r.src, r.dst) for r in edges.collect()} == {(0, 1), (1, 0), (1, 2), (2, 1), (4, 5), (5, 4)}


def test_attention_of_isolated_node_is_its_own_value(spark):
    nodes = spark.createDataFrame([(1, 0, [1.0, 2.0])], "doc_id long, id int, x array<double>")
    edges = spark.createDataFrame([], "doc_id long, src int, dst int")
    w = np.array([[1.0, 0.0], [0.0, 2.0]])
    out = P.gat_propagate(nodes, edges, w, np.ones((1, 2)), np.ones((1, 2))).first()
    assert out.h == pytest.approx([1.0, 4.0])
    assert P.gcn_propagate(nodes, edges, w).first().h == pytest.approx([1.0, 4.0])


def test_standardize_with_supplied_statistics(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "id long, x array<double>")
    got = P.batch_standardize(df, statistics=(np.array([0.0, 1.0]), np.array([4.0, 1.0])), eps=0.0).first().x
    assert got == pytest.approx([0.5, 1.0])


def test_product_by_blocks(spark):
    rng = np.random.default_rng(6)
    w, x = rng.normal(size=(23, 5)), rng.normal(size=(17, 5))
    w[4], w[:, 2], w[22] = 0.0, 0.0, 0.0  # rows, a column and the last row without weights
    w[22, 0] = 1.0
    table = spark.createDataFrame([(i, j, float(w[i, j])) for i in range(23) for j in range(5) if w[i, j]], "i int, j int, w double")
    df = spark.createDataFrame([(f"k{n}", [float(v) for v in row]) for n, row in enumerate(x)] + [("none", None)], "k string, x array<double>")
    for cells in (1, 12, 10**6):
        got = {r.k: r.y for r in linear_join(df, "k", "x", table, "y", block_cells=cells).collect()}
        assert set(got) == {f"k{n}" for n in range(17)} and np.allclose([got[f"k{n}"] for n in range(17)], x @ w.T)
    plan = linear_join(df, "k", "x", table, "y")._jdf.queryExecution().optimizedPlan().toString()
    assert "posexplode" not in plan.lower() and "Join" not in plan
    assert linear_join(df.where("false"), "k", "x", table, "y").count() == 0
    assert [r.y for r in linear_join(df.limit(1), "k", "x", table.where("false"), "y").collect()] == [[]]


def test_words_of_a_text_in_its_bytes(spark, monkeypatch):
    monkeypatch.setattr(matrix, "TEXT_SLICE", 40)
    texts = [None, "", " ", "one", "One two_2\tONE", "été naïve 12é34 😀x", "__ a" * 50, "\x00a\x00", "İI K", "a" * 100, "ends "]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").coalesce(1)
    got = df.select("id", F.lower("text").alias("low"), embed_text(F.col("text"), 16).alias("v")).collect()
    for row in got:
        want = np.zeros(16)
        for w in re.findall("[a-z0-9_]+", row.low or ""):
            h = hashlib.md5(w.encode()).hexdigest()
            want[int(h[:8], 16) % 16] += 1.0 if h[8] < "8" else -1.0
        assert np.allclose(row.v, want / (np.linalg.norm(want) or 1.0), atol=1e-12), row.id
    plan = df.select(embed_text(F.col("text"), 16))._jdf.queryExecution().executedPlan().toString()
    assert "split(" not in plan  # no array of words leaves the text
