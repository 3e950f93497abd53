"""What the operators of this package share: reading columns, scratch tables, text batches as arrays."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator
from itertools import starmap

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.runtime import scratch_path, spread_small

# A batch of texts is worked on in slices of about this many bytes, so that the arrays derived from
# it (several of 8 bytes a character) stay small.  A longer text is a slice of its own.
SLICE_BYTES = 1 << 21
# Where an operator derives 60 to 140 bytes from each and has little to set up for a slice.
SMALL_SLICE_BYTES = 1 << 18


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spread: bool = True) -> DataFrame:
    """Columns ``id`` (bigint) and ``text`` (null as empty) only, whatever else ``df`` has."""
    out = df.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return spread_small(out) if spread else out


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_mod(id_col: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % modulus


def large_binary(column: pa.Array) -> pa.LargeBinaryArray:
    """A text column as bytes with 64-bit offsets, starting at offset 0 of its own buffer."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_string() if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else pa.large_binary()
    return pc.cast(pc.cast(column, kind), pa.large_binary())


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it


def give_back() -> None:
    """Give the system what Arrow and the allocator hold on to: workers outlive their tasks, and lie beside the next stage's."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def byte_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of ``batch`` with the bytes of their texts as one array, and the offsets of each text."""
    values = large_binary(batch.column(batch.schema.get_field_index(column)))
    if not len(values):
        return
    offsets = np.frombuffer(values.buffers()[1], "i8")[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(values.buffers()[2] or b"", "u1")
    first = 0
    while first < len(values):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1)
        yield batch.slice(first, last - first), data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
    give_back()


def by_slices(work: Callable[..., pa.RecordBatch], batches: Iterator[pa.RecordBatch], most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """What ``work`` makes of every slice of the batches; nothing of the last one is held when memory is given back."""
    batch = None
    for batch in batches:
        yield from starmap(work, byte_slices(batch, most=most))
    del batch
    give_back()


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """UTF-8 bytes as code points, the texts' offsets in code points, and each code point's first byte (with the end)."""
    lead = (data & 0xC0) != 0x80
    first = np.append(np.flatnonzero(lead), len(data))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "u4")
    return points, np.searchsorted(first, offsets), first


def sha256_hex(parts: list[bytes]) -> list[str]:
    return [hashlib.sha256(p).hexdigest() for p in parts]

# A table up to this many bytes, measured, may go to every executor.
BROADCAST_BYTES = 16 << 20


def _row_size(df: DataFrame) -> Column:
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    texts += [F.coalesce(F.octet_length(F.to_json(c)), F.lit(0)) for c, kind in df.dtypes if kind.startswith(("array", "struct", "map"))]
    row = F.lit(16 + 8 * len(df.columns)).cast("bigint")
    for size in texts:
        row = row + size
    return row


def is_small(df: DataFrame) -> bool:
    """Whether the rows of ``df``, measured, take at most BROADCAST_BYTES."""
    return (df.agg(F.sum(_row_size(df))).first()[0] or 0) <= BROADCAST_BYTES


def broadcast_small(df: DataFrame) -> DataFrame:
    """``df`` with a broadcast hint if its rows, measured, take at most BROADCAST_BYTES; else as it is."""
    return F.broadcast(df) if is_small(df) else df


def join_counted(left: DataFrame, right: DataFrame, on: Column, count: str, most_bytes: int | None = None) -> DataFrame:
    """Inner join of ``left`` with ``right``, which has each key once and, in ``count``, how many rows of ``left`` have it.

    The most frequent keys, as many as fit into ``most_bytes`` (BROADCAST_BYTES), go to every task; only rows of rarer
    keys are shuffled.  So a key that most rows have is never gathered, and what is left over has few rows a key.
    ``left`` and ``right`` are read again: they should be stored.
    """
    level = F.ceil(F.log2(F.greatest(F.col(count), F.lit(1)))).cast("int")
    sizes = right.groupBy(level.alias("level")).agg(F.sum(_row_size(right)).alias("bytes")).orderBy(F.desc("level")).collect()  # 64 rows at most
    total, bound, all_fit = 0, None, True
    for row in sizes:
        total += row["bytes"]
        if total > (BROADCAST_BYTES if most_bytes is None else most_bytes):
            all_fit = False
            break
        bound = row["level"]
    if all_fit:
        return left.join(F.broadcast(right), on)
    if bound is None:
        return left.join(right, on)
    hot = F.broadcast(right.where(level >= bound))
    return left.join(hot, on).unionByName(left.join(hot, on, "left_anti").join(right.where(level < bound), on))


def keep_rows(docs: DataFrame, decided: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id ``decided`` (``doc_id, kept``, one row per row of ``docs``) keeps.

    Of rows that repeat an id and are not all kept, one stays.  The ids to drop are usually few, so that the
    documents themselves need not be shuffled.
    """
    by_id = decided.groupBy("doc_id").agg(F.count_if("kept").alias("kept"), F.count(F.lit(1)).alias("n")).where(F.col("kept") < F.col("n"))
    odd = stored(by_id.select(F.col("doc_id").alias("_id"), (F.col("kept") > 0).alias("_once")), "decided")
    same = F.col(id_col).eqNullSafe(F.col("_id"))
    out = docs.join(broadcast_small(odd), same, "left_anti")
    once = odd.where("_once")
    if once.isEmpty():
        return out
    return out.unionByName(docs.join(broadcast_small(once), same, "left_semi").dropDuplicates([id_col]))


ROW = "_row"


def named_rows(docs: DataFrame) -> DataFrame:
    """``docs`` with a bigint ROW that tells its rows apart and is the same whenever they are read.

    Of Parquet files it is the row's place (file and number in it); anything else is stored with numbers first.
    """
    spark = docs.sparkSession
    if docs._jdf.queryExecution().analyzed().nodeName() == "LogicalRelation":
        try:
            path, place = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_place")
            placed = docs.select("*", path, place)
        except AnalysisException:  # not of files, or of files without places
            return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "named")
        paths = sorted(r[0] for r in docs.select(path).distinct().collect())
        files = spark.createDataFrame([(p, k << 40) for k, p in enumerate(paths)], "_file string, _first bigint")
        named = spread_small(placed).join(broadcast_small(files), "_file")
        return named.select(*[F.col(f"`{c}`") for c in docs.columns], (F.col("_first") + F.col("_place")).alias(ROW))
    return stored(docs.withColumn(ROW, F.monotonically_increasing_id()), "named")


def keep_named(named: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``named_rows`` that ``decided`` (``row, kept``) does not drop, without ROW.

    The rows to drop are usually few, so that the documents themselves need not be shuffled.
    """
    gone = stored(decided.where(~F.col("kept")).select(F.col("row").alias(ROW)), "decided")
    return named.join(broadcast_small(gone), ROW, "left_anti").drop(ROW)
