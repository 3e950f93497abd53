"""Reading code records, drawing sample corpora, writing splits and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.functions.hashing import md5_int, md5_key
from corvane.operators.positions import with_positions
from corvane.runtime import broadcast_checked, shuffled
from corvane.sources.json_ranges import read_json_records

RECORD_SCHEMA = "code string, docstring string, language string, func_name string"


def read_corpus(spark: SparkSession, path: str, schema: str = RECORD_SCHEMA, format: str = "json", mode: str = "FAILFAST", glob: str = "*.json") -> DataFrame:
    """Records of one JSON-array file, or of every ``*.json`` (``glob``) directly in a folder.

    Files of any format are read in parts by many tasks, a JSON array too (see ``json_ranges``).  A damaged
    file fails the read, unless ``mode`` says otherwise ("PERMISSIVE" gives null rows, "DROPMALFORMED" none).
    """
    reader = spark.read.schema(schema).option("mode", mode)
    if format == "parquet":
        return reader.parquet(path)
    if format not in ("json", "jsonl"):
        raise ValueError(f"unknown corpus format {format!r}")
    if format == "json":
        return read_json_records(spark, path, schema, mode, glob)
    return reader.option("pathGlobFilter", glob).json(path)


def sample_corpus(pool: DataFrame, n: int, key: str = "doc_id", seed=0) -> DataFrame:
    """``n`` rows (sample_id, pool columns) drawn with replacement from ``pool``."""
    placed = with_positions(pool.select(key), key)
    size = placed.count()
    if size == 0:
        raise ValueError("empty pool")
    draws = pool.sparkSession.range(n).select(
        F.col("id").alias("sample_id"), (md5_int(md5_key(seed, F.col("id"))) % size).alias("position")
    )
    chosen = shuffled(draws).join(broadcast_checked(placed), "position").drop("position")
    return shuffled(chosen).join(broadcast_checked(pool), key)


def write_splits(df: DataFrame, path: str) -> None:
    """One JSON folder per value of ``split``."""
    df.write.mode("overwrite").partitionBy("split").json(path)


def write_metrics(metrics: DataFrame, path: str, epoch: int) -> None:
    """Metrics (metric, value) of an epoch; writing an epoch again replaces it."""
    writer = metrics.withColumn("epoch", F.lit(epoch)).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy("epoch").json(path)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("metric string, value double, epoch int").json(path)
