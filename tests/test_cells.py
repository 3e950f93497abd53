"""Neighbours by cells against all pairs, labels in one scan, running aggregates over any keys."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.operators import cells as C
from corvane.operators import sampling as M
from corvane.operators.evaluation import best_epochs
from corvane.operators.positions import running
from corvane.operators.search import topk_labelled
from corvane.sources.index import INDEX_TYPES, IndexConfig, VectorIndex


def frame(spark, matrix, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(matrix)], "id bigint, vec array<double>")


def nearest(matrix, n):
    d = np.round(np.sqrt(((matrix[:, None, :] - matrix[None]) ** 2).sum(-1)), 9)
    np.fill_diagonal(d, np.inf)
    return {i: [int(j) for j in np.lexsort((np.arange(len(d)), d[i]))[:n] if np.isfinite(d[i, j])] for i in range(len(d))}


def ranked(hits):
    out = {}
    for r in hits.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def clustered(n=400, groups=20, seed=2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(scale=10, size=(groups, 6))
    return centres[rng.integers(groups, size=n)] + rng.normal(scale=0.3, size=(n, 6))


def test_cells_find_what_all_pairs_find_and_look_at_less(spark):
    matrix = clustered()
    matrix[100:120] = matrix[100]  # copies: ties by id
    found = C.train_cells(frame(spark, matrix), 20)
    hits, looked = C.nearest_in_cells(frame(spark, matrix).withColumnRenamed("id", "query_id"), found, 5)
    assert ranked(hits) == nearest(matrix, 5)
    compared = sum(int(found.sizes[r.cell]) for r in looked.collect())
    assert compared < 0.5 * len(matrix) ** 2
    assert looked.count() == looked.distinct().count()


@pytest.mark.parametrize("kind", ["noise", "line", "same"])
def test_cells_without_clusters(spark, kind):
    rng = np.random.default_rng(4)
    matrix = {"noise": rng.normal(size=(120, 4)), "line": np.arange(120.0)[:, None] * np.ones((1, 2)), "same": np.ones((60, 3))}[kind]
    found = C.train_cells(frame(spark, matrix), 9)
    hits, _ = C.nearest_in_cells(frame(spark, matrix).withColumnRenamed("id", "query_id"), found, 4)
    assert ranked(hits) == nearest(matrix, 4)


def test_cells_of_small_and_empty_caches(spark):
    few = frame(spark, np.eye(3))
    hits, _ = C.nearest_in_cells(few.withColumnRenamed("id", "query_id"), C.train_cells(few), 10)
    assert {k: sorted(v) for k, v in ranked(hits).items()} == {0: [1, 2], 1: [0, 2], 2: [0, 1]}
    none = few.where("false")
    assert C.nearest_in_cells(few.withColumnRenamed("id", "query_id"), C.train_cells(none), 2)[0].count() == 0
    anchors = spark.createDataFrame([(0,), (9,)], "anchor_id bigint")
    pool = spark.range(5).select("id")
    topped = M.hard_negatives(few, anchors, 3, pool, cells=2).groupBy("anchor_id").count().collect()
    assert {r.anchor_id: r["count"] for r in topped} == {0: 3, 9: 3}  # topped up at random


def test_seeds_follow_the_share(spark):
    rows = frame(spark, np.random.default_rng(0).normal(size=(3000, 2)))
    assert 20 < len(C.seeds(rows, 50)) < 90
    assert len(C.seeds(rows.limit(4), 50)) == 4


def test_labels_meet_their_own_or_all(spark):
    rng = np.random.default_rng(7)
    items = [(i, [float(v) for v in rng.normal(size=3)], ["a", "b", None][i % 3]) for i in range(60)]
    x = spark.createDataFrame(items, "vec_id bigint, vec array<double>, label string")
    q = spark.createDataFrame([(0, [1.0, 0.0, 0.0], "a"), (1, [0.0, 1.0, 0.0], None), (2, [0.0, 0.0, 1.0], "none such"), (3, [1.0, 1.0, 0.0], "b")], "query_id bigint, vec array<double>, label string")
    hits = topk_labelled(q, x, 4)
    unit = np.array([v for _, v, _ in items])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = {}
    for k, v, label in ((0, [1.0, 0, 0], "a"), (1, [0, 1.0, 0], None), (3, [1.0, 1.0, 0], "b")):
        s = unit @ (np.array(v) / np.linalg.norm(v))
        ids = [i for i, _, own in items if label is None or own == label]
        want[k] = sorted(ids, key=lambda i: -round(s[i], 9))[:4]
    assert ranked(hits) == want


@pytest.mark.parametrize("kind", INDEX_TYPES)
def test_labelled_search_reads_the_index_once(spark, tmp_path, kind):
    index = VectorIndex.create(spark, str(tmp_path / kind), IndexConfig(2, kind, 2, 2), "language string")
    index.add(spark.range(30).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("float"), F.lit(1.0).cast("float")).alias("embedding"), F.concat(F.lit("l"), F.col("id") % 3).alias("language")))
    asked = spark.createDataFrame([(0, [5.0, 1.0], "l1"), (1, [5.0, 1.0], None), (2, [9.0, 1.0], "l0"), (3, [5.0, 1.0], "l9")], "query_id bigint, vec array<double>, label string")
    hits = index.ranked(asked, 1, label="language")
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1 or kind == "HNSW"
    got = {r.query_id: r.row_id for r in hits.collect()}
    assert 3 not in got and got[0] % 3 == 1 and got[2] % 3 == 0
    if kind != "HNSW":
        assert got == {0: 4, 1: 5, 2: 9}


@pytest.mark.parametrize("how", ["sum", "min"])
def test_running_with_text_groups_over_many_partitions(spark, how):
    rng = np.random.default_rng(1)
    rows = [(g, f"{k:05}", float(v)) for g in ("run a", "run b", None, "x") for k, v in enumerate(rng.integers(0, 100, size=1 if g == "x" else 150))]
    df = spark.createDataFrame(rows, "run string, epoch string, loss double").repartition(7)
    got = {(r.run, r.epoch): r.out for r in running(df, "run", "epoch", "loss", how, "out").collect()}
    for g in {r[0] for r in rows}:
        acc = 0.0 if how == "sum" else np.inf
        for name, epoch, v in sorted((r for r in rows if r[0] == g), key=lambda r: r[1]):
            assert got[(name, epoch)] == acc
            acc = acc + v if how == "sum" else min(acc, v)


def test_best_epochs_of_named_runs(spark):
    rows = [("base", 1, 0.5), ("base", 2, 0.6), ("base", 3, 0.4), ("wide", 1, 0.4), ("wide", 2, 0.4)]
    got = best_epochs(spark.createDataFrame(rows, "run string, epoch int, loss double"))
    flag = [c for c in got.columns if c not in ("run", "epoch", "loss")][0]
    assert sorted((r.run, r.epoch) for r in got.where(F.col(flag)).collect()) == [("base", 1), ("base", 3), ("wide", 1)]


def test_many_small_groups_run_together(spark):
    df = spark.range(200_000).select((F.col("id") % 6_250).cast("string").alias("g"), F.col("id").alias("o"), F.lit(1.0).alias("v"))
    out = running(df, "g", "o", "v", "sum", "before")
    assert out.where(F.col("before") != F.floor(F.col("o") / 6_250)).count() == 0
