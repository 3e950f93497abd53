"""What grows with a table: copies of its rows in a grid, products of a task, joins by way of the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import blocks as B
from corvane.operators import cells as C
from corvane.operators import evaluation as E
from corvane.operators import graph as G
from corvane.operators import search as S
from corvane.plans.catalog import storage


def rows(spark, matrix, key):
    return spark.createDataFrame([(i, [float(v) for v in m]) for i, m in enumerate(matrix)], f"{key} bigint, vec array<double>")


def meetings():
    """A fold of one row per query and block or task that it meets."""

    class Meetings:
        schema = "grp bigint, query_id bigint, n bigint"

        def start(self, n):
            return np.zeros(n, bool)

        def fold(self, state, at, q, q_ids, own, x, x_ids):
            state[at] = True

        def emit(self, state, groups, q_ids):
            return [groups[state], q_ids[state], np.ones(int(state.sum()), "i8")]

    return Meetings()


@pytest.mark.parametrize("group", [None, "g"])
def test_copies_in_a_grid_are_bounded(spark, group):
    few = spark.range(400).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vec"), F.lit(3).alias("g"))
    met = B.block_join(few, few.withColumnRenamed("query_id", "vec_id"), meetings(), group=group, broadcast_cells=0, query_rows=10, item_rows=10)
    assert {r["count"] for r in met.groupBy("query_id").count().collect()} == {B.MAX_COPIES}


def test_one_file_of_items_is_spread_by_products(spark, monkeypatch):
    monkeypatch.setattr(B, "TASK_PAIRS", 10_000)
    monkeypatch.setattr(B, "BLOCK_BYTES", 1)
    few = spark.range(200).coalesce(1).select(F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("vec"))
    met = B.block_join(few, few.withColumnRenamed("query_id", "vec_id"), meetings())
    assert met.groupBy("query_id").count().agg(F.min("count")).first()[0] >= 4


def data(kind):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(900, 8))
    if kind == "copies":
        x[200:] = x[rng.integers(0, 30, size=700)]
    if kind == "far":
        x = x * 1e-3 + 1e3
    if kind == "huge":
        x = x * 1e18
    return x


@pytest.mark.parametrize("kind", ["noise", "copies", "far", "huge"])
@pytest.mark.parametrize("metric", ["ip", "l2"])
def test_short_products_lose_nothing(kind, metric):
    x = data(kind)
    if metric == "ip" and kind != "huge":
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
    n, ids = len(x), np.arange(len(x))[::-1].copy()
    fold = B.TopK(7, metric, exclude_self=True)
    state = fold.start(n)
    B._fold_groups(fold, state, (np.zeros(n, "i8"), ids, x, np.zeros(n)), (np.zeros(n, "i8"), ids, x, np.zeros(n)), 10**9)
    scores = np.round(x @ x.T, 9) + 0.0 if metric == "ip" else -np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(scores, -np.inf)
    want = np.array([ids[np.lexsort((ids, -row))[:7]] for row in scores])
    if kind != "huge":
        assert (state[1] == want).all()
    else:  # rounding at nine digits says nothing there
        assert np.isfinite(state[0]).all() and (state[1] == want).mean() > 0.99


def test_better_items_are_counted_with_repeated_ids():
    x = data("copies")
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.arange(len(x)) // 2
    own = np.round((x * np.roll(x, 1, axis=0)).sum(1), 3)
    fold = B.BetterCount()
    state = fold.start(len(x))
    B._fold_groups(fold, state, (np.zeros(len(x), "i8"), ids, x, own), (np.zeros(len(x), "i8"), ids, x, own), 10**9)
    scores, mark = np.round(x @ x.T, 9), own[:, None]
    ahead = (scores > mark) | ((scores == mark) & (ids[None] < ids[:, None]))
    assert (state[0] == (ahead & (ids[None] != ids[:, None])).sum(1)).all()


def test_queries_are_not_copied_to_very_many_cells(spark, monkeypatch):
    matrix = np.random.default_rng(4).normal(size=(240, 6))
    met, join = [], C.block_join

    def counted(queries, items, *args, **how):
        met.append(queries.count())
        return join(queries, items, *args, **how)

    monkeypatch.setattr(C, "block_join", counted)
    queries = rows(spark, matrix, "query_id")
    hits, looked = C.nearest_in_cells(queries, C.train_cells(rows(spark, matrix, "id"), 60), 3)
    found = {}
    for r in hits.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    d = np.round(np.sqrt(((matrix[:, None] - matrix[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    assert found == {i: [int(j) for j in np.lexsort((np.arange(240), d[i]))[:3]] for i in range(240)}
    assert looked.count() == looked.distinct().count() > sum(met)
    assert sum(met[1:]) <= C.MAX_COPIES * 240


def test_probing_all_cells_copies_no_query(spark):
    x = np.random.default_rng(0).normal(size=(50, 4))
    centroids = x[:6]
    index = S.ivf_assign(rows(spark, x, "vec_id"), centroids)
    hits = S.ivf_search(rows(spark, x, "query_id"), index, centroids, 5, 6)
    assert "Generate" not in hits._jdf.queryExecution().optimizedPlan().toString()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {(r.query_id, r["rank"]): r.vec_id for r in hits.collect()}
    for i, row in enumerate(np.round(unit @ unit.T, 9)):
        assert [got[i, k + 1] for k in range(5)] == sorted(range(50), key=lambda j: (-row[j], j))[:5]


def test_metrics_are_computed_once_for_all_writes(spark, monkeypatch):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    monkeypatch.setattr(storage, "ranks", lambda spark, d: spark.range(1, 5).select(F.col("id").alias("query_id"), F.col("id").alias("rank")).mapInArrow(counted, "query_id bigint, rank bigint"))
    assert storage.metrics(spark, "").count() == 12
    assert seen.value == 4


def test_stacked_graphs_are_not_joined_by_way_of_the_driver(spark):
    features = spark.range(40).select((F.col("id") % 5).alias("doc_id"), F.col("id"), F.array(F.lit(0.0)).alias("x"))
    edges = spark.range(40).select((F.col("id") % 5).alias("doc_id"), F.col("id").alias("src"), F.col("id").alias("dst"))
    batches = spark.range(5).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("batch_id"))
    for part in G.graph_batch(features, edges, batches):
        plan = part._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [doc_id" not in plan and "SortMergeJoin [doc_id" in plan
        assert part.count() == 40


def counted(q, q_ids, own, x, x_ids):
    fold = B.BetterCount()
    state = fold.start(len(q))
    B._fold_groups(fold, state, (np.zeros(len(q), "i8"), q_ids, q, own), (np.zeros(len(x), "i8"), x_ids, x, np.zeros(len(x))), 10**9)
    assert state[1].all()
    return state[0]


@pytest.mark.parametrize("kind", ["clusters", "noise", "copies", "one", "wide"])
def test_better_items_are_counted_in_leaves(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2700, 40 if kind == "wide" else 6))
    if kind == "clusters":
        x = rng.normal(size=(20, 6))[rng.integers(0, 20, size=2700)] + 0.01 * x
    if kind == "copies":
        x[300:] = x[rng.integers(0, 5, size=2400)]
    if kind == "one":
        x[:] = x[0]
    x[5] = x[2000] = 0.0
    x = B.unit_rows(x)
    x_ids = rng.permutation(2700)
    x_ids[:60] = x_ids[60:120]  # repeated
    q, q_ids = B.unit_rows(x[::3] + 0.3 * rng.normal(size=x[::3].shape)), x_ids[::3].copy()
    q[::9] = x[::27]  # queries that are items, and some without a direction
    q[::50] = 0.0
    own = (q * x[::3]).sum(1)
    own[1::70], own[2::70] = 5.0, -5.0  # all items are behind, or ahead
    got = counted(q, q_ids, own, x, x_ids)
    scores, mark = np.round(q @ x.T, 9) + 0.0, np.round(own, 9)[:, None]
    ahead = (scores > mark) | ((scores == mark) & (x_ids[None] < q_ids[:, None]))
    assert (got == (ahead & (x_ids[None] != q_ids[:, None])).sum(1)).all()


def test_odd_items_and_queries_are_counted_as_before(monkeypatch):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2500, 5))
    x[3], x[700, 2], x[900] = np.nan, np.inf, 1e17
    q, own = x[:400].copy(), rng.normal(size=400)
    own[7], own[8], q[9] = np.nan, 1e18, np.inf
    ids = np.arange(2500)
    with np.errstate(all="ignore"):
        got = counted(q, ids[:400], own, x, ids)
        monkeypatch.setattr(B, "MANY_ITEMS", 10**9)
        assert (got == counted(q, ids[:400], own, x, ids)).all()


def test_ranks_take_few_products(monkeypatch):
    rng = np.random.default_rng(10)
    x = B.unit_rows(rng.normal(size=(30, 8))[rng.integers(0, 30, size=6000)] + 0.02 * rng.normal(size=(6000, 8)))
    q = B.unit_rows(rng.normal(size=(500, 8)))
    taken, product, fold = [], np.matmul, B.BetterCount.fold
    monkeypatch.setattr(B.np, "matmul", lambda a, b, **how: taken.append(len(a) * b.shape[1]) or product(a, b, **how))
    monkeypatch.setattr(B.BetterCount, "fold", lambda self, state, at, q, q_ids, own, x, x_ids: taken.append((at.stop - at.start) * len(x)) or fold(self, state, at, q, q_ids, own, x, x_ids))
    got = counted(q, np.arange(500), (q * x[:500]).sum(1), x, np.arange(6000))
    assert sum(taken) < 0.5 * 500 * 6000
    scores = np.round(q @ x.T, 9)
    mark = np.round((q * x[:500]).sum(1), 9)[:, None]
    assert (got == (((scores > mark) | ((scores == mark) & (np.arange(6000) < np.arange(500)[:, None]))) & (np.arange(6000) != np.arange(500)[:, None])).sum(1)).all()


def test_ranks_of_many_codes_in_tasks_and_in_a_grid(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(2400, 6))
    q = x + rng.normal(size=x.shape)
    q[::7] = 0.0
    queries, codes = rows(spark, q, "query_id"), rows(spark, x, "vec_id").coalesce(1)
    s = np.round(B.unit_rows(q) @ B.unit_rows(x).T, 9) + 0.0
    i = np.arange(2400)
    want = 1 + ((s > s[i, i][:, None]) | ((s == s[i, i][:, None]) & (i < i[:, None]))).sum(1)
    for blocks in ({}, {"broadcast_cells": 0}):
        assert {r.query_id: r["rank"] for r in E.rank_of_match(queries, codes, **blocks).collect()} == dict(enumerate(want))
