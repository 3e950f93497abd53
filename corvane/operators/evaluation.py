"""Retrieval metrics from one rank per query: nothing is ever sorted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions import vectors as V
from corvane.operators.blocks import BetterCount, block_join
from corvane.operators.positions import running
from corvane.runtime import shuffled

RECALL_K, NDCG_K = (1, 5, 10, 20), 10


def rank_of_match(queries: DataFrame, codes: DataFrame, group: str | None = None, **blocks) -> DataFrame:
    """(query_id, rank[, group]): rank of the code with the query's own id, by cosine.

    queries(query_id, vec), codes(vec_id, vec).  The rank is one plus the number of better codes;
    ties go to the lower id.  With ``group`` only codes of the query's own group compete.  A query without a
    code of its own has a null rank, which every metric counts as zero.
    """
    extra = [] if group is None else [group]
    q, x = queries.select("query_id", "vec", *extra), codes.select("vec_id", "vec", *extra)
    own = x.select(F.col("vec_id").alias("query_id"), F.col("vec").alias("match"))
    marked = q.join(shuffled(own), "query_id").withColumn("own", V.cosine(F.col("vec"), F.col("match"))).drop("match")
    parts = block_join(marked, x, BetterCount(), group=group, own="own", **blocks)
    ranks = parts.groupBy("grp", "query_id").agg((F.sum("better") + 1).alias("rank"))
    ranks = ranks.drop("grp") if group is None else ranks.withColumnRenamed("grp", group)
    missing = q.join(shuffled(own.select("query_id")), "query_id", "left_anti").select(*[c for c in ranks.columns if c != "rank"])
    return ranks.unionByName(missing.withColumn("rank", F.lit(None).cast("bigint")))


def _gain(rank: Column) -> Column:
    return F.when(rank <= NDCG_K, 1.0 / F.log2(rank + 1)).otherwise(0.0)


def recall_at_k(ranks: DataFrame, ks=RECALL_K) -> DataFrame:
    return ranks.agg(*_metric_columns(F.col("rank"), ks)[: len(ks)])


def mrr(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg(F.coalesce(1.0 / F.col("rank"), F.lit(0.0))).alias("mrr"))


def ndcg_at_10(ranks: DataFrame) -> DataFrame:
    return ranks.agg(F.avg(F.coalesce(_gain(F.col("rank")), F.lit(0.0))).alias("ndcg"))


def _metric_columns(rank: Column, ks) -> list[Column]:
    """All metrics of one rank column; a null rank (no match) counts as zero everywhere."""
    cols = [F.avg(F.coalesce((rank <= k).cast("double"), F.lit(0.0))).alias(f"recall@{k}") for k in ks]
    cols.append(F.avg(F.coalesce(1.0 / rank, F.lit(0.0))).alias("mrr"))
    cols.append(F.avg(F.coalesce(_gain(rank), F.lit(0.0))).alias("ndcg"))
    return cols


def _tall(wide: DataFrame, keys: list[str]) -> DataFrame:
    names = [c for c in wide.columns if c not in keys]
    return wide.unpivot(keys, names, "metric", "value")


def rank_metrics(ranks: DataFrame, ks=RECALL_K, group: str | None = None) -> DataFrame:
    """([group,] metric, value) with recall@k, mrr and ndcg from one pass over the ranks."""
    keys = [] if group is None else [group]
    return _tall(ranks.groupBy(*keys).agg(*_metric_columns(F.col("rank"), ks)), keys)


def _position(predictions: Column, label: Column) -> Column:
    return F.nullif(F.array_position(predictions, label), F.lit(0).cast("bigint"))


def ranked_list_metrics(lists: DataFrame, ks=RECALL_K) -> DataFrame:
    """(metric, value) of rows (predictions, label); a label not predicted counts as zero."""
    positions = lists.select(_position(F.col("predictions"), F.col("label")).alias("rank"))
    return rank_metrics(positions, ks)


def ranked_list_recall(lists: DataFrame, ks=RECALL_K) -> DataFrame:
    hit = [F.array_contains(F.slice("predictions", 1, k), F.col("label")).cast("double") for k in ks]
    return lists.agg(*[F.avg(h).alias(f"recall@{k}") for h, k in zip(hit, ks)])


def ranked_list_mrr(lists: DataFrame) -> DataFrame:
    position = _position(F.col("predictions"), F.col("label"))
    return lists.agg(F.avg(F.coalesce(1.0 / position, F.lit(0.0))).alias("mrr"))


def ranked_list_ndcg(lists: DataFrame, k: int = NDCG_K) -> DataFrame:
    position = _position(F.slice("predictions", 1, k), F.col("label"))
    return lists.agg(F.avg(F.coalesce(_gain(position), F.lit(0.0))).alias("ndcg"))


def evaluate_by_batch(
    queries: DataFrame, codes: DataFrame, ks=RECALL_K, return_embeddings: bool = False, **blocks
):
    """(batch_id, metric, value), each query ranked within its own batch.

    With ``return_embeddings`` the two vector frames come back next to the metrics.
    """
    ranks = rank_of_match(queries, codes, group="batch_id", **blocks)
    metrics = rank_metrics(ranks, ks, group="batch_id")
    return (metrics, codes, queries) if return_embeddings else metrics


def validation_report(batch_losses: DataFrame, ranks: DataFrame, ks=RECALL_K) -> DataFrame:
    """(metric, value): loss (mean of batch means) and all rank metrics over the whole set.

    An empty set reports 0 for recall@1, mrr and ndcg and has no other recall.
    """
    loss = batch_losses.groupBy("batch_id").agg(F.avg("loss").alias("m")).agg(F.avg("m").alias("value"))
    rows = loss.select(F.lit("loss").alias("metric"), "value")
    metrics = rank_metrics(ranks, ks)
    on_empty = F.col("metric").isin("recall@1", "mrr", "ndcg")
    filled = metrics.where(F.col("value").isNotNull() | on_empty).select("metric", F.coalesce("value", F.lit(0.0)).alias("value"))
    return rows.unionByName(filled)


def best_epochs(losses: DataFrame) -> DataFrame:
    """(run, epoch, loss, is_best): strictly below every earlier loss of the run."""
    seen = running(losses, "run", "epoch", "loss", "min", "best")
    return seen.select("run", "epoch", "loss", (F.col("loss") < F.col("best")).alias("is_best"))
