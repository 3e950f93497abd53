"""Exact and cell-pruned nearest neighbours, approximate neighbours, and result assembly."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions.matrix import to_matrix, unit_rows
from corvane.operators.blocks import TIE_DIGITS, TopK, block_join
from corvane.runtime import broadcast_checked, checkpoint, explode_once, shuffled


def rank_hits(hits: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """Merge partial hits (query_id, vec_id, score) into ranks 1..k; ties go to the lower id."""
    score = F.col("score").asc() if ascending else F.col("score").desc()
    order = Window.partitionBy("query_id").orderBy(score, "vec_id")
    ranked = hits.select("query_id", "vec_id", "score", F.row_number().over(order).alias("rank"))
    return ranked.where(F.col("rank") <= k)


def topk_exact(queries: DataFrame, items: DataFrame, k: int = 10, **blocks) -> DataFrame:
    """``k`` items of largest cosine per query.  queries(query_id, vec), items(vec_id, vec)."""
    return rank_hits(block_join(queries, items, TopK(k), **blocks), k)


def meet_by_label(queries: DataFrame, items: DataFrame, *by: str) -> tuple[DataFrame, DataFrame]:
    """Both sides with a ``meet`` column to group a ``block_join`` by: a query with a ``label`` meets the items of that
    label, one whose label is null meets all.

    The items are read once whatever labels are asked for; an item is there twice if queries of both kinds are.  ``by``
    names further columns that have to agree, such as a cell.
    """
    kinds = {r["named"] for r in queries.select(F.col("label").isNotNull().alias("named")).distinct().collect()}
    each = [F.concat(F.lit("="), F.col("label"))] * (True in kinds) + [F.lit("")] * (False in kinds)

    def key(label: Column) -> Column:
        return F.xxhash64(*by, label)

    wanted = F.when(F.col("label").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("label")))
    offered = F.array_compact(F.array(*each)) if each else F.array().cast("array<string>")
    return queries.withColumn("meet", key(wanted)), items.withColumn("_as", F.explode(offered)).withColumn("meet", key(F.col("_as"))).drop("_as")


def topk_labelled(queries: DataFrame, items: DataFrame, k: int = 10, **blocks) -> DataFrame:
    """``topk_exact`` among the items of each query's ``label``; see ``meet_by_label``."""
    q, x = meet_by_label(queries, items)
    return rank_hits(block_join(q, x, TopK(k), group="meet", **blocks), k)


def best_cells(x: Column, centroids: np.ndarray, n: int) -> Column:
    """The ``n`` cells of largest inner product, best first; ties go to the lower cell."""
    table = np.ascontiguousarray(centroids.T)
    n = min(n, len(centroids))

    @F.arrow_udf("array<int>")
    def pick(v: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], type=pa.list_(pa.int32()))
        scores = np.round(unit_rows(to_matrix(v)) @ table, TIE_DIGITS)
        cells = np.argsort(-scores, axis=1, kind="stable")[:, :n].astype("i4")
        offsets = pa.array(np.arange(len(cells) + 1, dtype="i4") * n)
        return pa.ListArray.from_arrays(offsets, pa.array(cells.ravel()))

    return pick(x)


def assign_cells(items: DataFrame, centroids: DataFrame, vec: str = "vec") -> DataFrame:
    """``ivf_assign`` with centroids(cell, vec) in a table of any size: blocks of vectors meet blocks of centroids."""
    items = checkpoint(items.withColumn("_n", F.monotonically_increasing_id()))
    best = _probe_table(items.select(F.col("_n").alias("query_id"), F.col(vec).alias("vec")), centroids, 1)
    return items.join(shuffled(best.select(F.col("query_id").alias("_n"), "cell")), "_n").drop("_n")


def _probe_table(queries: DataFrame, centroids: DataFrame, n: int) -> DataFrame:
    """(query_id, cell): the ``n`` cells of largest inner product, ties to the lower cell."""
    cells = centroids.select(F.col("cell").alias("vec_id"), "vec")
    return rank_hits(block_join(queries, cells, TopK(n)), n).select("query_id", F.col("vec_id").cast("int").alias("cell"))


def ivf_assign(items: DataFrame, centroids: np.ndarray | DataFrame, vec: str = "vec") -> DataFrame:
    """Add the cell whose centroid has the largest inner product with the vector."""
    if isinstance(centroids, DataFrame):
        return assign_cells(items, centroids, vec)
    return items.withColumn("cell", best_cells(F.col(vec), centroids, 1)[0])


# Probed cells become a literal filter of the scan up to this number, a semi-join beyond.
MAX_LITERAL_CELLS = 10_000


def ivf_search(
    queries: DataFrame, index: DataFrame, centroids: np.ndarray | DataFrame, k: int = 10, nprobe: int = 10, **blocks
) -> DataFrame:
    """Exact ranking within the ``nprobe`` best cells of each query.

    index(vec_id, vec, cell).  The probed cells become a literal filter, bounded
    by the number of centroids, so an index partitioned by cell is only read where it is needed.  If both sides have
    a ``label``, only items of the query's label are ranked, all of them for a null one.
    """
    labelled = "label" in queries.columns and "label" in index.columns
    asked = queries.select("query_id", "vec", *["label"] * labelled)
    if not isinstance(centroids, DataFrame) and nprobe >= len(centroids):
        # All cells are probed: the queries need not be copied to each of them.
        return (topk_labelled if labelled else topk_exact)(asked, index, k, **blocks)
    if isinstance(centroids, DataFrame):
        asked = checkpoint(asked)
        probes = checkpoint(asked.join(shuffled(_probe_table(asked.select("query_id", "vec"), centroids, nprobe)), "query_id"))
    else:
        probes = asked.withColumn("cell", explode_once(best_cells(F.col("vec"), centroids, nprobe)))
    if isinstance(centroids, DataFrame) or nprobe < len(centroids):
        wanted = probes.select("cell").distinct()
        few = [r["cell"] for r in wanted.limit(MAX_LITERAL_CELLS + 1).collect()]
        index = index.where(F.col("cell").isin(few)) if len(few) <= MAX_LITERAL_CELLS else index.join(wanted, "cell", "left_semi")
    if labelled:
        probes, index = meet_by_label(probes, index, "cell")
        return rank_hits(block_join(probes, index, TopK(k), group="meet", **blocks), k)
    hits = block_join(probes, index, TopK(k), group="cell", **blocks)
    return rank_hits(hits, k)


def hyperplanes(tables: int, bits: int, dim: int) -> np.ndarray:
    """Random +-1 normals (tables*bits, dim), from digests so that every run agrees."""
    digit = [
        hashlib.md5(f"{t}:{b}:{d}".encode()).hexdigest()[0] for t in range(tables) for b in range(bits) for d in range(dim)
    ]
    return np.where(np.array(digit) < "8", 1.0, -1.0).reshape(tables * bits, dim)


def signature_buckets(x: Column, tables: int, bits: int, dim: int) -> Column:
    """One bucket number per table: which side of each hyperplane the vector lies on."""
    normals = hyperplanes(tables, bits, dim).T
    weights = 2 ** np.arange(bits)

    @F.arrow_udf("array<bigint>")
    def bucket(v: pa.Array) -> pa.Array:
        n = len(v)
        if n == 0:
            return pa.array([], type=pa.list_(pa.int64()))
        side = (np.round(to_matrix(v) @ normals, TIE_DIGITS) >= 0.0).reshape(n, tables, bits)
        number = (side * weights).sum(axis=2) + np.arange(tables) * (1 << bits)
        offsets = pa.array(np.arange(n + 1, dtype="i4") * tables)
        return pa.ListArray.from_arrays(offsets, pa.array(number.astype("i8").ravel()))

    return bucket(x)


def topk_ann(
    queries: DataFrame, items: DataFrame, dim: int, k: int = 10, tables: int = 8, bits: int = 8, **blocks
) -> DataFrame:
    """Approximate neighbours: candidates share a hyperplane signature in some table, then exact rank.

    Buckets meet block by block, so a bucket full of copies costs matrix products, not pair rows.  If both sides have
    a ``label``, only items of the query's label are ranked, all of them for a null one.
    """
    labelled = "label" in queries.columns and "label" in items.columns

    def bucketed(df, key):
        return df.select(key, "vec", *["label"] * labelled).withColumn("bucket", explode_once(signature_buckets(F.col("vec"), tables, bits, dim)))

    q, x, group = bucketed(queries, "query_id"), bucketed(items, "vec_id"), "bucket"
    if labelled:
        (q, x), group = meet_by_label(q, x, "bucket"), "meet"
    hits = block_join(q, x, TopK(k), group=group, **blocks)
    # The same neighbour may turn up in several tables.
    once = hits.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return rank_hits(once, k)


def attach_metadata(hits: DataFrame, metadata: DataFrame, key: str = "vec_id") -> DataFrame:
    """Stored record of each hit; a hit without a record keeps empty columns.  ``key`` is unique in ``metadata``.

    Few distinct hit ids (checked) are sent to the metadata, which is then never shuffled.  The hits
    are small and used twice, so they are materialized once.
    """
    hits = checkpoint(hits)
    wanted = broadcast_checked(hits.select(key).distinct(), max_rows=1_000_000)
    return hits.join(shuffled(shuffled(metadata).join(wanted, key, "left_semi")), key, "left")
