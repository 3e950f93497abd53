"""Record-level projections, filters and request checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import language_guard

# Defaults of a code record, of a result row and of a request.
RECORD_DEFAULTS = {"language": "python", "docstring": ""}
RESULT_DEFAULTS = {"code": "", "language": "unknown", "func_name": "", "docstring": ""}
DEFAULT_TOP_K, MAX_TOP_K = 10, 100


def fill_record_defaults(records: DataFrame) -> DataFrame:
    """Fill missing language and docstring; a record without code fails the job."""
    filled = {n: F.coalesce(F.col(n), F.lit(v)) for n, v in RECORD_DEFAULTS.items()}
    filled["code"] = F.coalesce(F.col("code"), F.raise_error(F.lit("record without code")).cast("string"))
    return records.withColumns(filled)


def project_results(hits: DataFrame, return_scores: bool = True) -> DataFrame:
    """Result rows: query_id, rank, the record's text columns with defaults, and the score."""
    cols: list[Column] = [F.col("query_id"), F.col("rank")]
    cols += [F.coalesce(F.col(n), F.lit(v)).alias(n) for n, v in RESULT_DEFAULTS.items()]
    return hits.select(*cols, *([F.col("score")] if return_scores else []))


def filter_language(frame: DataFrame, language: Column | str | None) -> DataFrame:
    """Keep one language.

    On ranked results ranks are not renumbered and fewer than k rows may be left; on an index,
    before ranking, the result is always filled up to k when enough vectors match.
    """
    if language is None:
        return frame
    value = F.lit(language) if isinstance(language, str) else language
    return frame.where(value.isNull() | (F.col("language") == value))


def validate_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) requests: a query is required, top_k defaults to 10 and lies in 1..100."""
    top_k = F.coalesce(F.col("top_k"), F.lit(DEFAULT_TOP_K)).cast("int")
    reason = F.when(F.col("query").isNull(), F.lit("query missing")).when(
        ~F.col("top_k").between(1, MAX_TOP_K), F.lit("top_k out of range")
    )
    checked = requests.withColumn("top_k", top_k).withColumn("reason", reason)
    return checked.where(F.col("reason").isNull()).drop("reason"), checked.where(F.col("reason").isNotNull())


def guarded_nodes_input(records: DataFrame) -> DataFrame:
    """Records whose language has rules; the others get no nodes and so an empty graph."""
    return records.where(language_guard(F.col("language")))


def embedding_dim(vectors: DataFrame, vec: str = "embedding") -> DataFrame:
    """Vector and its dimension, as the embed reply carries them."""
    return vectors.withColumn("dimension", F.size(vec).cast("bigint"))
