"""Rank-metric and validation queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.operators import evaluation as E
from corvane.operators.losses import triplet_terms
from corvane.operators.search import topk_exact
from corvane.plans.catalog.fixtures import SQL_PAIRS, aligned_pairs, r6, sql_r6, vectors
from corvane.plans.catalog.learning import SQL_ROLLED, SQL_TRIPLET_TERM, _rolled
from corvane.plans.catalog.search import SQL_EXACT, _queries

KS = E.RECALL_K


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    pairs = aligned_pairs(spark, d)
    return (
        pairs.select(F.col("id").alias("query_id"), F.col("query").alias("vec"), "batch_id"),
        pairs.select(F.col("id").alias("vec_id"), F.col("code").alias("vec"), "batch_id"),
    )


def ranks(spark, d, **blocks) -> DataFrame:
    return E.rank_of_match(*_sides(spark, d), **blocks)


_COS = "round(list_inner_product(a.query, b.code) / sqrt(list_inner_product(a.query, a.query) * list_inner_product(b.code, b.code)), 9)"


def sql_ranks(name: str, same_batch: bool = False) -> str:
    where = "ON a.batch_id = b.batch_id" if same_batch else "ON true"
    return f"""{name}_s AS (SELECT a.batch_id, a.id AS query_id, b.id AS vec_id, {_COS} AS s FROM pairs a JOIN pairs b {where}),
{name} AS (
  SELECT batch_id, query_id, rank FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM {name}_s) WHERE query_id = vec_id)"""


SQL_RANKS = f"{SQL_PAIRS}, {sql_ranks('rk')}"
_RECALL = [f"avg(CASE WHEN rank <= {k} THEN 1::DOUBLE ELSE 0 END)" for k in KS]
_MRR = "avg(coalesce(1::DOUBLE / rank, 0))"
_NDCG = "avg(CASE WHEN rank <= 10 THEN 1 / log2(rank + 1) ELSE 0 END::DOUBLE)"
_WIDE_RECALL = ", ".join(f'{sql_r6(e)} AS "recall@{k}"' for e, k in zip(_RECALL, KS))


def sql_tall(source: str, key: str = "") -> str:
    exprs = {**{f"recall@{k}": e for e, k in zip(_RECALL, KS)}, "mrr": _MRR, "ndcg": _NDCG}
    head, group = (f"{key}, ", f" GROUP BY {key}") if key else ("", "")
    return " UNION ALL ".join(
        f"SELECT {head}'{n}' AS metric, {sql_r6(e)} AS value FROM {source}{group}" for n, e in exprs.items()
    )


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def lists(spark, d) -> DataFrame:
    """Top 20 ids of every vector; the label is the neighbour one up, often absent."""
    hits = topk_exact(_queries(spark, d), vectors(spark, d), 20)
    rows = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id"))).alias("h"))
    label = F.when(F.col("query_id") % 3 == 0, F.col("query_id")).otherwise(F.expr("query_id + 1 - 10 * (query_id % 2)"))
    return rows.select("query_id", F.transform("h", lambda s: s["vec_id"]).alias("predictions"), label.alias("label"))


SQL_LISTS = f"""ex AS ({SQL_EXACT.replace('rank <= 10', 'rank <= 20')}),
lb AS (SELECT DISTINCT query_id, CASE WHEN query_id % 3 = 0 THEN query_id ELSE query_id + 1 - 10 * (query_id % 2) END AS label FROM ex),
pos AS (SELECT lb.query_id, ex.rank FROM lb LEFT JOIN ex ON ex.query_id = lb.query_id AND ex.vec_id = lb.label)"""


def by_batch(spark, d, **blocks):
    return _rounded(E.evaluate_by_batch(*_sides(spark, d), **blocks))


def report(spark, d):
    return _rounded(E.validation_report(triplet_terms(_rolled(spark, d)), ranks(spark, d)))


def epochs(spark, d) -> DataFrame:
    """A loss per (run, epoch): run = label, epoch = vec_id."""
    first = r6(F.abs(F.col("vec")[0]))
    return vectors(spark, d).select(F.col("label").cast("bigint").alias("run"), F.col("vec_id").alias("epoch"), first.alias("loss"))


SQL_EPOCHS = f"""ep AS (SELECT label::BIGINT AS run, vec_id AS epoch, {sql_r6('abs(embedding[1]::DOUBLE)')} AS loss FROM embeddings)"""

QUERIES = {
    "rank_of_match": (ranks, f"WITH {SQL_RANKS} SELECT query_id, rank FROM rk"),
    "rank_of_match_grid": (
        lambda spark, d: ranks(spark, d, broadcast_cells=0, query_rows=100, item_rows=90),
        f"WITH {SQL_RANKS} SELECT query_id, rank FROM rk",
    ),
    "recall_at_k": (
        lambda spark, d: _rounded(E.recall_at_k(ranks(spark, d))),
        f"WITH {SQL_RANKS} SELECT {_WIDE_RECALL} FROM rk",
    ),
    "mrr": (lambda spark, d: _rounded(E.mrr(ranks(spark, d))), f"WITH {SQL_RANKS} SELECT {sql_r6(_MRR)} AS mrr FROM rk"),
    "ndcg_at_10": (
        lambda spark, d: _rounded(E.ndcg_at_10(ranks(spark, d))),
        f"WITH {SQL_RANKS} SELECT {sql_r6(_NDCG)} AS ndcg FROM rk",
    ),
    "ranked_list_recall": (
        lambda spark, d: _rounded(E.ranked_list_recall(lists(spark, d))),
        f"WITH {SQL_LISTS} SELECT {_WIDE_RECALL} FROM pos",
    ),
    "ranked_list_mrr": (
        lambda spark, d: _rounded(E.ranked_list_mrr(lists(spark, d))),
        f"WITH {SQL_LISTS} SELECT {sql_r6(_MRR)} AS mrr FROM pos",
    ),
    "ranked_list_ndcg": (
        lambda spark, d: _rounded(E.ranked_list_ndcg(lists(spark, d))),
        f"WITH {SQL_LISTS} SELECT {sql_r6(_NDCG)} AS ndcg FROM pos",
    ),
    "ranked_list_metrics": (
        lambda spark, d: _rounded(E.ranked_list_metrics(lists(spark, d))),
        f"WITH {SQL_LISTS} {sql_tall('pos')}",
    ),
    "evaluate_by_batch": (
        by_batch,
        f"WITH {SQL_PAIRS}, {sql_ranks('rb', True)} {sql_tall('rb', 'batch_id')}",
    ),
    "evaluate_by_batch_grid": (
        lambda spark, d: by_batch(spark, d, broadcast_cells=0, query_rows=10, item_rows=8),
        f"WITH {SQL_PAIRS}, {sql_ranks('rb', True)} {sql_tall('rb', 'batch_id')}",
    ),
    "validation_report": (
        report,
        f"WITH {SQL_ROLLED}, {sql_ranks('rk')}, b AS (SELECT batch_id, avg({SQL_TRIPLET_TERM}) AS m FROM tri GROUP BY batch_id) "
        f"SELECT 'loss' AS metric, {sql_r6('avg(m)')} AS value FROM b UNION ALL {sql_tall('rk')}",
    ),
    "best_epochs": (
        lambda spark, d: E.best_epochs(epochs(spark, d)),
        f"WITH {SQL_EPOCHS} SELECT run, epoch, loss, loss < coalesce(min(loss) OVER (PARTITION BY run ORDER BY epoch "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'inf'::DOUBLE) AS is_best FROM ep",
    ),
}
