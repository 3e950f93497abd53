import hashlib
import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import evaluation as E
from corvane.operators import search as S
from corvane.operators.blocks import TopK, block_join
from corvane.operators.clustering import ivf_train

GRID = {"broadcast_cells": 0, "query_rows": 7, "item_rows": 5}


def vectors(spark, mat, key, **cols):
    rows = [(i, [float(v) for v in m], *(int(c[i]) for c in cols.values())) for i, m in enumerate(mat)]
    return spark.createDataFrame(rows, f"{key} long, vec array<double>" + "".join(f", {c} long" for c in cols))


def brute(q, x, k, allowed=None):
    q, x = (m / np.linalg.norm(m, axis=1, keepdims=True) for m in (q, x))
    scores = np.round(q @ x.T, 9)
    out = {}
    for i, row in enumerate(scores):
        ids = [j for j in range(len(x)) if allowed is None or allowed(i, j)]
        out[i] = sorted(ids, key=lambda j: (-row[j], j))[:k]
    return out


def ids(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.mark.parametrize("blocks", [{}, GRID])
def test_topk_with_a_third_of_the_items_equal(spark, blocks):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    x[::3] = x[0]
    q = np.vstack([x[:3], rng.normal(size=(9, 4))])
    got = ids(S.topk_exact(vectors(spark, q, "query_id"), vectors(spark, x, "vec_id"), 8, **blocks))
    assert got == brute(q, x, 8)


def test_fewer_items_than_k_and_no_queries(spark):
    x = np.eye(3)
    items = vectors(spark, x, "vec_id")
    got = S.topk_exact(vectors(spark, x, "query_id"), items, 10)
    assert got.count() == 9 and got.agg(F.max("rank")).first()[0] == 3
    none = vectors(spark, x, "query_id").where("false")
    assert S.topk_exact(none, items, 3).count() == 0 and S.topk_exact(none, items, 3, **GRID).count() == 0


@pytest.mark.parametrize("blocks", [{}, GRID])
def test_hot_group_meets_only_itself(spark, blocks):
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(50, 3)), rng.normal(size=(40, 3))
    gx, gq = np.where(np.arange(50) < 30, 7, np.arange(50)), np.where(np.arange(40) < 25, 7, np.arange(40))
    hits = block_join(vectors(spark, q, "query_id", g=gq), vectors(spark, x, "vec_id", g=gx), TopK(4), group="g", **blocks)
    want = brute(q, x, 4, lambda i, j: gq[i] == gx[j])
    assert ids(S.rank_hits(hits, 4)) == {i: v for i, v in want.items() if v}


@pytest.mark.parametrize("blocks", [{}, GRID])
def test_l2_neighbours_with_copies(spark, blocks):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 5))
    x[10:25] = x[3]
    frame = vectors(spark, x, "vec_id")
    hits = block_join(frame.withColumnRenamed("vec_id", "query_id"), frame, TopK(6, "l2", True), unit=False, **blocks)
    got = ids(S.rank_hits(hits, 6, ascending=True))
    for i in range(40):
        d = np.round(np.linalg.norm(x - x[i], axis=1), 9)
        assert got[i] == sorted((j for j in range(40) if j != i), key=lambda j: (d[j], j))[:6]


def test_probing_every_cell_is_exact(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 4))
    items, queries = vectors(spark, x, "vec_id"), vectors(spark, x[:20], "query_id")
    cells = ivf_train(items, 6, 3)
    index = S.ivf_assign(items, cells)
    assert ids(S.ivf_search(queries, index, cells, 5, 6)) == ids(S.topk_exact(queries, items, 5)) == brute(x[:20], x, 5)
    assert len(ivf_train(vectors(spark, x[:3], "vec_id"), 100, 1)) == 3


def test_metadata_of_unknown_id_stays_empty(spark):
    hits = spark.createDataFrame([(1, 5, 1, 0.5), (1, 6, 2, 0.4)], "query_id long, vec_id long, rank int, score double")
    meta = spark.createDataFrame([(5, "c")], "vec_id long, code string")
    got = {r.vec_id: r.code for r in S.attach_metadata(hits, meta).collect()}
    assert got == {5: "c", 6: None}


def test_metrics_agree_with_ranked_lists_and_grow_with_k(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 6))
    q = x + rng.normal(size=x.shape)
    queries, codes = vectors(spark, q, "query_id"), vectors(spark, x, "vec_id")
    ranks = E.rank_of_match(queries, codes)
    want = brute(q, x, 60)
    assert {r.query_id: r["rank"] for r in ranks.collect()} == {i: want[i].index(i) + 1 for i in want}
    tall = {r.metric: r.value for r in E.rank_metrics(ranks).collect()}
    assert tall["recall@1"] <= tall["recall@5"] <= tall["recall@10"] <= tall["recall@20"]
    lists = spark.createDataFrame([(i, v, i) for i, v in want.items()], "query_id long, predictions array<long>, label long")
    assert {r.metric: r.value for r in E.ranked_list_metrics(lists).collect()} == pytest.approx(tall)


def test_absent_label_counts_zero(spark):
    lists = spark.createDataFrame([([1, 2], 9), ([9, 1], 9)], "predictions array<long>, label long")
    assert E.ranked_list_mrr(lists).first()[0] == 0.5 and E.ranked_list_ndcg(lists).first()[0] == 0.5
    assert {r.metric: r.value for r in E.ranked_list_metrics(lists).collect()}["recall@5"] == 0.5


def test_empty_validation_report(spark):
    losses = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 4.0)], "batch_id long, loss double")
    ranks = spark.createDataFrame([], "query_id long, rank long")
    got = {r.metric: r.value for r in E.validation_report(losses, ranks).collect()}
    assert got == {"loss": 3.0, "recall@1": 0.0, "mrr": 0.0, "ndcg": 0.0}


def test_cells_in_a_table_like_those_in_an_array(spark, tmp_path, monkeypatch):
    from corvane.operators.clustering import seed_rows
    from corvane.sources import index as I

    x = np.random.default_rng(8).normal(size=(150, 4))
    items = vectors(spark, x, "vec_id")
    cells = ivf_train(items, 12, 2)
    table = ivf_train(items, 12, 2, most_cells=0)
    rows = sorted(table.collect(), key=lambda r: r.cell)
    assert np.allclose([r.vec for r in rows], cells)
    near = {r.vec_id: r.cell for r in S.ivf_assign(items, table).collect()}
    assert near == {r.vec_id: r.cell for r in S.ivf_assign(items, cells).collect()}
    keys = sorted((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(150))
    for n in (0, 1, 7, 150, 900):
        assert sorted(r.vec_id for r in seed_rows(items, n).collect()) == sorted(i for _, i in keys[:n])
    twice = items.unionByName(items)  # ids that repeat: as many rows as asked for
    assert seed_rows(twice, 7).count() == 7
    monkeypatch.setattr(I, "MAX_BROADCAST_CELLS", 1)
    monkeypatch.setattr("corvane.operators.clustering.MAX_BROADCAST_CELLS", 1)
    index = I.VectorIndex.create(spark, str(tmp_path / "i"), I.IndexConfig(4, "IVF", 12, 12))
    monkeypatch.setattr(I, "ivf_train", lambda rows, n: ivf_train(rows, n, most_cells=1))
    index.add(items.withColumnRenamed("vec", "embedding"))
    index.add(items.limit(5).withColumnRenamed("vec", "embedding"))
    asked = vectors(spark, x[:6], "query_id")
    got = {r.query_id: r.vec_id for r in index.search(asked, 1).collect()}
    assert got == {k: k for k in range(6)} and index.vectors().count() == 155
