"""Session-level helpers: lineage cuts, size checks, rounding."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

# Largest payload (in numbers) that is ever shipped whole to every executor: 8M doubles = 64 MB.
MAX_BROADCAST_CELLS = 8_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or a fresh one in local mode."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:  # set after the context's start
            sc.setCheckpointDir(configured)
        return configured
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="corvane-"))
    return sc.getCheckpointDir()


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/corvane-{uuid.uuid4().hex}/{name}"


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialize ``df`` in the shared checkpoint folder and cut its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def collect_bounded(df: DataFrame, max_rows: int) -> pa.Table | None:
    """Rows of ``df`` as an Arrow table, or None when there are more than ``max_rows``.

    Rows are counted first, which evaluates no column, and moved only when they fit.
    """
    return None if df.count() > max_rows else df.toArrow()


# A table that goes to every executor has at most so many bytes.
MAX_BROADCAST_BYTES = 64 << 20


def _row_bytes(df: DataFrame) -> Column:
    size = F.lit(16 + 8 * len(df.columns)).cast("bigint")
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(field.name), F.lit(0))
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = size + 8 * F.greatest(F.size(field.name), F.lit(0))
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = size + F.coalesce(F.octet_length(F.to_json(field.name)), F.lit(0))
    return size


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` with a hint that a join must not send it, nor what it meets, whole to every executor by way of the driver.

    Sizes are estimated from the files that were read: rows that are exploded, generated or encoded after that count for
    little, and a table that grows with the input would be taken for a small one.
    """
    return df.hint("merge")


def broadcast_checked(df: DataFrame, max_rows: int = 100_000) -> DataFrame:
    """``df`` with a broadcast hint when its rows and their bytes, measured, are within bounds; else unchanged."""
    n, size = df.agg(F.count(F.lit(1)), F.sum(_row_bytes(df))).first()
    return F.broadcast(df) if n <= max_rows and (size or 0) <= MAX_BROADCAST_BYTES else df


# A scan below this many bytes per core is spread over the cores before heavy per-row work.
SMALL_SCAN_BYTES_PER_CORE = 16_000_000


def spread_small(df: DataFrame) -> DataFrame:
    """Spread a small scan (one file, one row group) over all cores; larger inputs stay as they are."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if size < cores * SMALL_SCAN_BYTES_PER_CORE else df


def explode_once(array: Column) -> Column:
    """``explode`` that evaluates its argument once; an empty array gives one null row.

    The plain generator makes the optimizer add a "size > 0" filter below it, which would compute an
    expensive array (a split text, an Arrow function) a second time.
    """
    return F.explode_outer(array)
