"""Matrix functions on vector columns: Arrow batches in, one numpy product per batch, Arrow out.

Used where the work is a matrix product, which an interpreted higher-order function would do one
boxed number at a time.  All of them are narrow: no shuffle, no extra rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.runtime import MAX_BROADCAST_CELLS, collect_bounded


def to_matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Equal-length lists as a 2-D float64 array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        raise ValueError("vector column holds nulls")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype("f8", copy=False)
    if len(column) == 0:
        return flat.reshape(0, 0)
    if flat.size % len(column):
        raise ValueError("vectors differ in length")
    return flat.reshape(len(column), -1)


def unit_rows(matrix: np.ndarray) -> np.ndarray:
    """Rows of length one; a zero row stays zero."""
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return matrix / np.where(norm == 0.0, 1.0, norm)


def from_matrix(matrix: np.ndarray) -> pa.ListArray:
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype="i4") * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix, dtype="f8").ravel()))


def load_matrix(weights: DataFrame) -> np.ndarray | None:
    """A weight table ``(i, j, w)`` as an array, or None when it is empty or too large to ship whole."""
    table = collect_bounded(weights.select("i", "j", "w"), MAX_BROADCAST_CELLS)
    if table is None or not table.num_rows:
        return None
    i, j = (table.column(c).to_numpy().astype("i8") for c in ("i", "j"))
    out = np.zeros((i.max() + 1, j.max() + 1))
    out[i, j] = table.column("w").to_numpy()
    return out


_ACTIVATIONS = {
    None: lambda y: y,
    "relu": lambda y: np.maximum(y, 0.0),
    "sigmoid": lambda y: 1.0 / (1.0 + np.exp(-y)),
}


def linear(x: Column, weight: np.ndarray, bias: np.ndarray | None = None, activation: str | None = None) -> Column:
    """``activation(W x + b)`` with supplied weights."""
    transposed = np.ascontiguousarray(np.asarray(weight, dtype="f8").T)
    shift = 0.0 if bias is None else np.asarray(bias, dtype="f8")
    act = _ACTIVATIONS[activation]

    @F.arrow_udf("array<double>")
    def product(v: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], type=pa.list_(pa.float64()))
        return from_matrix(act(to_matrix(v) @ transposed + shift))

    return product(x)


# Numbers of one side in a product of a block of vectors and a block of weight rows.
BLOCK_CELLS = 4_000_000


def linear_join(df: DataFrame, key: str, x: str, weights: DataFrame, out: str, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """``W x`` for a weight table (i, j, w) too large to ship whole; inputs without a weight count as zero.

    Rows of W in blocks meet the vectors in blocks, one matrix product each.  A vector is copied once for every block of W, which
    is what it gives results for; no join looks at single components.  A null ``x`` gives no row.
    """
    shape = weights.agg(F.max("i").alias("i"), F.max("j").alias("j")).first()
    n_out, n_in = (shape["i"] if shape["i"] is not None else -1) + 1, (shape["j"] if shape["j"] is not None else -1) + 1
    rows = max(1, block_cells // max(n_in, 1))
    n_blocks = -(-n_out // rows)
    known = df.where(F.col(x).isNotNull())
    kind = df.schema[key].dataType.simpleString()
    if not n_blocks:
        return known.select(key, F.array().cast("array<double>").alias(out))
    n_groups = max(1, -(-known.count() // rows))
    packed = weights.groupBy(F.col("i").cast("bigint").alias("i")).agg(F.collect_list(F.struct(F.col("j").cast("bigint").alias("j"), F.col("w").cast("double").alias("w"))).alias("p"))
    packed = packed.select((F.col("i") / rows).cast("int").alias("b"), "i", F.col("p.j").alias("j"), F.col("p.w").alias("w"))
    packed = packed.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    vectors = known.select(F.col(key).alias("key"), F.col(x).alias("x"), F.pmod(F.xxhash64(key), F.lit(n_groups)).cast("int").alias("g"))
    vectors = vectors.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def product(left: pa.Table, right: pa.Table) -> pa.Table:
        given = to_matrix(left["x"]) if left.num_rows else np.zeros((0, 0))
        y = np.zeros((0, 1))
        if left.num_rows:
            first = left["b"][0].as_py() * rows
            last = min(first + rows, n_out)
            table = np.zeros((last - first, max(n_in, given.shape[1])))
            if right.num_rows:
                right = right.combine_chunks()
                lists = right["j"].combine_chunks()
                at = np.repeat(right["i"].to_numpy() - first, lists.value_lengths().to_numpy(zero_copy_only=False))
                table[at, lists.flatten().to_numpy()] = right["w"].combine_chunks().flatten().to_numpy()
            y = given @ table[:, : given.shape[1]].T
        return pa.table({"key": left["key"], "b": left["b"], "y": from_matrix(y)})

    parts = vectors.groupBy("g", "b").cogroup(packed.groupBy("g", "b")).applyInArrow(product, f"key {kind}, b int, y array<double>")
    return parts.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("b", "y"))).alias("p")).select(F.col("key").alias(key), F.flatten(F.col("p.y")).alias(out))


# A batch of texts is cut into words in slices of about this many bytes.
TEXT_SLICE = 4 << 20
_IN_WORD = np.zeros(256, bool)
_IN_WORD[list(b"abcdefghijklmnopqrstuvwxyz0123456789_")] = True


def _word_cells(data: np.ndarray, offsets: np.ndarray, dim: int) -> np.ndarray:
    """Signed words of each text by bucket; a word is a run of a-z, 0-9 and _, a longer byte of UTF-8 is no part of one."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros((n, dim))
    inside = _IN_WORD[data]
    change = np.append(True, inside[1:] != inside[:-1])
    first = offsets[:-1]
    change[first[first < len(data)]] = True
    begin = np.flatnonzero(change)
    # Words and what lies between them, as they stand; each distinct one is looked at once.
    runs = pa.Array.from_buffers(pa.large_binary(), len(begin), [None, pa.py_buffer(np.append(begin, len(data)).astype("i8")), pa.py_buffer(data)])
    flat = runs.dictionary_encode()
    digests = [hashlib.md5(w).hexdigest() if _IN_WORD[w[0]] else None for w in flat.dictionary.to_pylist()]
    bucket = np.array([int(h[:8], 16) % dim if h else 0 for h in digests], dtype="i8")
    sign = np.array([(1.0 if h[8] < "8" else -1.0) if h else 0.0 for h in digests])
    code = flat.indices.to_numpy(zero_copy_only=False)
    cell = (np.searchsorted(offsets, begin, "right") - 1) * dim + bucket[code]
    return np.bincount(cell, weights=sign[code], minlength=n * dim).reshape(n, dim)


def hash_scatter(text: Column, dim: int) -> Column:
    """Unit vector of the words of a lower-cased text: every word adds +-1 to its bucket.

    Bucket and sign come from the word's md5.  Words are cut in the bytes of a slice of texts and never made into rows or
    strings of their own: a slice hashes each distinct word once and scatters the dictionary codes.
    """

    @F.arrow_udf("array<double>")
    def scatter(batch: pa.Array) -> pa.Array:
        texts = batch.fill_null("").cast(pa.large_string())
        if not len(texts):
            return pa.array([], type=pa.list_(pa.float64()))
        offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", "u1")
        out, k = [], 0
        while k < len(texts):
            last = max(k + 1, int(np.searchsorted(offsets, offsets[k] + TEXT_SLICE, "right")) - 1)
            out.append(_word_cells(data[offsets[k] : offsets[last]], offsets[k : last + 1] - offsets[k], dim))
            k = last
        return from_matrix(unit_rows(np.concatenate(out)))

    return scatter(text)
