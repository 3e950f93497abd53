from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corvane.operators import losses as L
from corvane.operators import sampling as M
from corvane.operators.evaluation import best_epochs
from corvane.operators.positions import running, with_positions


def ids(spark, values, name="id"):
    return spark.createDataFrame([(v,) for v in values], f"{name} long")


def test_positions_are_dense_with_a_hot_key(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("k"), "id").repartition(7)
    rows = with_positions(df, "k", "id").orderBy("k", "id").collect()
    assert [r.position for r in rows] == list(range(3000))


@pytest.mark.parametrize("how", ["sum", "min"])
def test_running_with_a_group_over_many_partitions(spark, how):
    rng = np.random.default_rng(0)
    n = 2000
    pdf = pd.DataFrame({"g": np.where(np.arange(n) < 1200, 4, rng.integers(0, 9, n)), "o": np.arange(n), "v": rng.integers(0, 50, n) * 1.0})
    df = spark.createDataFrame(pdf.sample(frac=1, random_state=1)).repartition(9)
    got = running(df, "g", "o", "v", how, "r").orderBy("o").toPandas()["r"].to_numpy()
    if how == "sum":
        want = pdf.groupby("g")["v"].cumsum() - pdf["v"]
    else:
        want = pdf.groupby("g")["v"].transform(lambda s: s.cummin().shift(1)).fillna(np.inf)
    assert np.allclose(got, want.to_numpy())


def test_best_epochs_are_strict(spark):
    rows = [(0, 0, 3.0), (0, 1, 3.0), (0, 2, 2.0), (0, 3, 5.0), (1, 0, 9.0)]
    got = best_epochs(spark.createDataFrame(rows, "run long, epoch long, loss double"))
    assert [r.is_best for r in got.orderBy("run", "epoch").collect()] == [True, False, True, False, True]


def test_random_negatives_are_distinct_others(spark):
    pool = ids(spark, range(0, 60, 2))
    got = M.random_negatives(pool, ids(spark, range(0, 60, 2), "anchor_id"), 5).toPandas()
    assert (got.groupby("anchor_id").size() == 5).all() and not got.duplicated().any()
    assert (got.anchor_id != got.negative_id).all() and (got.negative_id % 2 == 0).all()


def test_random_negatives_take_all_when_few_and_none_when_alone(spark):
    got = M.random_negatives(ids(spark, [1, 2, 3]), ids(spark, [1, 2, 3, 7], "anchor_id"), 4).toPandas()
    assert Counter(got.anchor_id) == {1: 2, 2: 2, 3: 2, 7: 3}
    assert M.random_negatives(ids(spark, [1]), ids(spark, [1], "anchor_id"), 4).count() == 0


def test_random_negatives_are_spread_evenly(spark):
    got = M.random_negatives(ids(spark, range(20)), ids(spark, range(20), "anchor_id"), 10).toPandas()
    counts = got.negative_id.value_counts()
    assert len(counts) == 20 and counts.min() >= 3 and counts.max() <= 18


def test_hard_negatives_fall_back_to_random(spark):
    cache = spark.createDataFrame([(0, [0.0, 0.0]), (1, [1.0, 0.0]), (2, [5.0, 0.0])], "id long, vec array<double>")
    pool = ids(spark, range(10))
    got = M.hard_negatives(cache, ids(spark, [0, 9], "anchor_id"), 4, pool).toPandas()
    assert Counter(got.anchor_id) == {0: 4, 9: 4}
    assert set(got[got.anchor_id == 0].negative_id[:2]) <= set(range(1, 10)) and {1, 2} <= set(got[got.anchor_id == 0].negative_id)
    assert (got.anchor_id != got.negative_id).all()


def test_split_is_an_exact_partition(spark):
    for n in (0, 1, 9, 10, 237):
        got = Counter(r.split for r in M.split(spark.range(n), "id", 3).collect())
        assert (got["train"], got["val"]) == (int(0.8 * n), int(0.1 * n)) and sum(got.values()) == n
    with pytest.raises(ValueError):
        M.split(spark.range(3), "id", mode="other")


def test_mini_batches_keep_rows_and_end_short(spark):
    df = spark.range(70).withColumn("x", F.col("id") * 2)
    got = M.mini_batches(df, "id", 32, shuffle_seed=1).toPandas()
    assert Counter(got.batch_id) == {0: 32, 1: 32, 2: 6} and (got.x == 2 * got.id).all()


def test_roll_wraps_and_single_row_is_its_own_negative(spark):
    rows = spark.createDataFrame([(0, 1), (0, 5), (0, 9), (4, 2)], "batch_id long, id long")
    got = {r.id: r.negative_id for r in L.rolled_negatives(rows).collect()}
    assert got == {1: 9, 5: 1, 9: 5, 2: 2}


def unit(m):
    return m / np.linalg.norm(m, axis=-1, keepdims=True)


@pytest.mark.parametrize("blocks", [{}, {"broadcast_cells": 0, "query_rows": 3, "item_rows": 4}])
@pytest.mark.parametrize("target", ["first", "diagonal"])
def test_in_batch_softmax_with_a_hot_batch(spark, target, blocks):
    rng = np.random.default_rng(5)
    q, p = rng.normal(size=(2, 20, 4))
    batch = np.where(np.arange(20) < 14, 0, 1)
    rows = [(int(b), i, q[i].tolist(), p[i].tolist()) for i, b in enumerate(batch)]
    df = spark.createDataFrame(rows, "batch_id long, id long, query array<double>, positive array<double>")
    got = {r.batch_id: r.loss for r in L.infonce_in_batch(df, target, **blocks).collect()}
    for b in (0, 1):
        logits = unit(q[batch == b]) @ unit(p[batch == b]).T / 0.07
        lse = np.log(np.exp(logits - logits.max(1, keepdims=True)).sum(1)) + logits.max(1)
        picked = logits[:, 0] if target == "first" else np.diag(logits)
        assert got[b] == pytest.approx((lse - picked).mean())


def test_infonce_without_negatives_is_zero(spark):
    pairs = spark.createDataFrame([(1, [1.0, 0.0], [0.0, 1.0])], "query_id long, query array<double>, positive array<double>")
    none = spark.createDataFrame([], "query_id long, negative array<double>")
    assert L.infonce(pairs, none).first()[0] == pytest.approx(0.0)
