"""Contrastive losses of supplied vectors, as column expressions and partial aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from corvane.functions import vectors as V
from corvane.operators.blocks import LogSumExp, block_join
from corvane.operators.positions import with_positions
from corvane.runtime import shuffled

MARGIN, HARD_WEIGHT, TEMPERATURE = 0.5, 0.3, 0.07


def triplet_terms(triplets: DataFrame, margin: float = MARGIN) -> DataFrame:
    """Add ``loss`` to rows (anchor, positive, negative)."""
    gap = V.pairwise_distance(F.col("anchor"), F.col("positive")) - V.pairwise_distance(F.col("anchor"), F.col("negative"))
    return triplets.withColumn("loss", F.greatest(gap + margin, F.lit(0.0)))


def triplet_loss(triplets: DataFrame, margin: float = MARGIN) -> DataFrame:
    return triplet_terms(triplets, margin).agg(F.avg("loss").alias("loss"))


def triplet_loss_hard(
    pairs: DataFrame, negatives: DataFrame, margin: float = MARGIN, hard_weight: float = HARD_WEIGHT
) -> DataFrame:
    """Weighted hardest-negative and mean-negative loss.

    pairs(anchor_id, anchor, positive), negatives(anchor_id, negative).
    """
    far = negatives.join(shuffled(pairs.select("anchor_id", "anchor")), "anchor_id").select(
        "anchor_id", V.l2_distance(F.col("anchor"), F.col("negative")).alias("d")
    )
    stats = far.groupBy("anchor_id").agg(F.min("d").alias("near"), F.avg("d").alias("mean"))
    both = shuffled(stats).join(
        pairs.select("anchor_id", V.pairwise_distance(F.col("anchor"), F.col("positive")).alias("p")), "anchor_id"
    )

    def hinge(d: str):
        return F.greatest(F.col("p") - F.col(d) + margin, F.lit(0.0))

    return both.agg(F.avg(hard_weight * hinge("near") + (1.0 - hard_weight) * hinge("mean")).alias("loss"))


def infonce(pairs: DataFrame, negatives: DataFrame, temperature: float = TEMPERATURE) -> DataFrame:
    """Softmax loss of the positive among explicit negatives.

    pairs(query_id, query, positive), negatives(query_id, negative).
    """
    scored = negatives.join(shuffled(pairs.select("query_id", "query")), "query_id").select(
        "query_id", (V.cosine(F.col("query"), F.col("negative")) / temperature).alias("l")
    )
    # Two partial aggregations over narrow rows; the maximum keeps the exponentials in range.
    own = pairs.select("query_id", (V.cosine(F.col("query"), F.col("positive")) / temperature).alias("own"))
    top = scored.groupBy("query_id").agg(F.max("l").alias("top"))
    # greatest() skips the null of a query without negatives.
    peaks = own.join(shuffled(top), "query_id", "left").withColumn("peak", F.greatest("own", "top"))
    mass = (
        peaks.join(shuffled(scored), "query_id", "left")
        .groupBy("query_id", "own", "peak")
        .agg(F.coalesce(F.sum(F.exp(F.col("l") - F.col("peak"))), F.lit(0.0)).alias("m"))
    )
    loss = F.log(F.col("m") + F.exp(F.col("own") - F.col("peak"))) + F.col("peak") - F.col("own")
    return mass.agg(F.avg(loss).alias("loss"))


def infonce_in_batch(
    pairs: DataFrame, target: str = "first", temperature: float = TEMPERATURE, **blocks
) -> DataFrame:
    """(batch_id, loss): every other positive of the batch is a negative.

    pairs(batch_id, id, query, positive).  ``target`` "first" takes the batch's first positive as the
    right answer for every row, "diagonal" the row's own.  The batch products are never rows.
    """
    parts = block_join(
        pairs.select("batch_id", "id", F.col("query").alias("vec")),
        pairs.select("batch_id", "id", F.col("positive").alias("vec")),
        LogSumExp(temperature),
        query_key="id",
        item_key="id",
        group="batch_id",
        **blocks,
    )
    key = Window.partitionBy("grp", "query_id")
    shifted = parts.withColumn("top", F.max("peak").over(key))
    total = shifted.groupBy("grp", "query_id").agg(
        (F.log(F.sum(F.col("mass") * F.exp(F.col("peak") - F.col("top")))) + F.max("top")).alias("lse")
    )
    if target == "diagonal":
        right = pairs.select("batch_id", "id", V.cosine(F.col("query"), F.col("positive")).alias("s"))
    elif target == "first":
        first = pairs.groupBy("batch_id").agg(F.min_by("positive", "id").alias("first"))
        right = pairs.join(shuffled(first), "batch_id").select("batch_id", "id", V.cosine(F.col("query"), F.col("first")).alias("s"))
    else:
        raise ValueError(f"unknown target {target!r}")
    joined = total.withColumnsRenamed({"grp": "batch_id", "query_id": "id"}).join(shuffled(right), ["batch_id", "id"])
    return joined.groupBy("batch_id").agg(F.avg(F.col("lse") - F.col("s") / temperature).alias("loss"))


def combined_loss(
    triplets: DataFrame,
    margin: float = MARGIN,
    temperature: float = TEMPERATURE,
    triplet_weight: float = 0.5,
    infonce_weight: float = 0.5,
    target: str = "first",
) -> DataFrame:
    """(batch_id, total, triplet, infonce) of rows (batch_id, id, anchor, positive, negative)."""
    triplet = triplet_terms(triplets, margin).groupBy("batch_id").agg(F.avg("loss").alias("triplet"))
    pairs = triplets.select("batch_id", "id", F.col("anchor").alias("query"), "positive")
    contrast = infonce_in_batch(pairs, target, temperature).withColumnRenamed("loss", "infonce")
    total = triplet_weight * F.col("triplet") + infonce_weight * F.col("infonce")
    return triplet.join(contrast, "batch_id").select("batch_id", total.alias("total"), "triplet", "infonce")


def rolled_negatives(rows: DataFrame) -> DataFrame:
    """(batch_id, id, negative_id): the previous row of the batch, the last one for the first row.

    Works on ids alone; a batch is not gathered in one task, whatever its size.
    """
    placed = with_positions(rows.select("batch_id", "id"), "batch_id", "id")
    ends = placed.groupBy("batch_id").agg(F.min("position").alias("lo"), F.max("position").alias("hi"))
    wanted = F.when(F.col("position") == F.col("lo"), F.col("hi")).otherwise(F.col("position") - 1)
    left = placed.join(shuffled(ends), "batch_id").select("batch_id", "id", wanted.alias("position"))
    return left.join(shuffled(placed.select("position", F.col("id").alias("negative_id"))), "position").drop("position")


def epoch_loss(losses: DataFrame) -> DataFrame:
    """Mean of the batch means of rows (batch_id, loss): a short last batch weighs as much as a full one."""
    return losses.groupBy("batch_id").agg(F.avg("loss").alias("mean")).agg(F.avg("mean").alias("loss"))
