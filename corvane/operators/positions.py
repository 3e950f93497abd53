"""Dense positions and running aggregates over a total order, without a single-task window.

Rows are range-partitioned and sorted; each partition works on its own rows, and only one summary
row per partition goes through the driver to say what came before.  The ranged rows are written to
the checkpoint folder first: range bounds are sampled, so a recomputed range might differ.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from corvane.runtime import checkpoint

_ROW_BITS = 33  # monotonically_increasing_id keeps the partition above these bits


def with_positions(df: DataFrame, *order_by: str, name: str = "position") -> DataFrame:
    """Add the 0-based position in ``order_by`` order; end the order with a unique column."""
    ranged = checkpoint(
        df.repartitionByRange(*order_by)
        .sortWithinPartitions(*order_by)
        .withColumn("_row", F.monotonically_increasing_id())
    )
    part = F.shiftright("_row", _ROW_BITS)
    sizes = {r["part"]: r["n"] for r in ranged.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offsets = 0, []
    for key in sorted(sizes):
        offsets.append((key, before))
        before += sizes[key]
    # One row per partition, so its size is bounded by the partition count.
    table = df.sparkSession.createDataFrame(offsets, "_part bigint, _before bigint")
    local = F.col("_row").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    return (
        ranged.withColumn("_part", part.cast("bigint"))
        .join(F.broadcast(table), "_part")
        .withColumn(name, F.col("_before") + local)
        .drop("_row", "_part", "_before")
    )


_RUNNING = {"sum": (np.add, 0.0, "cumsum"), "min": (np.minimum, np.inf, "cummin")}


def running(df: DataFrame, group: str, order_by: str, value: str, how: str, name: str) -> DataFrame:
    """Per group, ``how`` ("sum" or "min") of ``value`` over the rows strictly before this one.

    The first row of a group gets the neutral element (0 or infinity).  Group and order may be of any type that sorts; null
    is a group of its own.  A group may span any number of partitions, so one group holding most rows is still spread over
    all tasks, and all groups of a batch are accumulated at once.
    """
    op, neutral, accumulate = _RUNNING[how]
    keys = df.select(group, order_by, F.col(value).cast("double").alias(value))

    def local(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, acc, opened = TaskContext.get().partitionId(), None, neutral, True
        for frame in frames:
            if frame.empty:
                continue
            code = pd.factorize(frame[group], use_na_sentinel=False)[0]
            segment = np.cumsum(np.diff(code, prepend=code[0]) != 0)
            values = frame[value].to_numpy()
            upto = getattr(pd.Series(values).groupby(segment), accumulate)().to_numpy()
            starts = np.flatnonzero(np.diff(segment, prepend=-1))
            before = np.empty(len(values))
            before[1:] = upto[:-1]
            before[starts] = neutral
            head = frame[group].iloc[0]
            goes_on = last is not None and (head == last[0] or (pd.isna(head) and pd.isna(last[0])))
            opened = last is None or (opened and goes_on)  # still the first group of this partition
            if goes_on:
                mine = segment == 0
                before[mine], upto[mine] = op(before[mine], acc), op(upto[mine], acc)
            last, acc = (frame[group].iloc[-1],), upto[-1]
            first = (segment == 0) & opened
            opened = opened and segment[-1] == 0
            yield frame.assign(_before=before, _after=upto, _part=part, _open=first)

    types = dict(keys.dtypes)
    schema = f"`{group}` {types[group]}, `{order_by}` {types[order_by]}, `{value}` double, _before double, _after double, _part int, _open boolean"
    ranged = checkpoint(
        keys.repartitionByRange(group, order_by).sortWithinPartitions(group, order_by).mapInPandas(local, schema)
    )
    ends = (
        ranged.groupBy("_part")
        .agg(
            F.min(F.struct(F.col(group).alias("g"))).alias("head"),
            F.max(F.struct(F.col(group).alias("g"), F.col(order_by).alias("o"), F.col("_after").alias("v"))).alias("tail"),
        )
        .orderBy("_part")
        .collect()
    )
    carry, carried_group, carried = [], None, neutral
    for row in ends:
        incoming = carried if carry and row["head"]["g"] == carried_group else neutral
        carry.append((row["_part"], float(incoming)))
        tail = row["tail"]
        carried = float(op(incoming, tail["v"])) if tail["g"] == row["head"]["g"] else tail["v"]
        carried_group = tail["g"]
    table = df.sparkSession.createDataFrame(carry, "_part int, _carry double")
    combine = F.least if how == "min" else (lambda a, b: a + b)
    total = F.when(F.col("_open"), combine(F.col("_before"), F.col("_carry"))).otherwise(F.col("_before"))
    return ranged.join(F.broadcast(table), "_part").select(group, order_by, value, total.alias(name))
