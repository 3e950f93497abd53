"""Exact nearest neighbours by L2 that look only into cells which can hold one.

Vectors are dealt to the nearest of a few hundred centroids; a cell knows its radius.  A query first looks into the cells nearest
to it, until they hold enough vectors, which bounds the distance of its last neighbour.  Then, by the triangle
inequality, only cells whose centroid is nearer than that bound plus their radius can hold a better one.  A query that
would have to look into very many of them is compared with all vectors, block by block, instead of being copied to each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.matrix import to_matrix
from corvane.operators.blocks import MAX_COPIES, TopK, block_join
from corvane.operators.gnn import vector_sum
from corvane.operators.search import rank_hits
from corvane.runtime import MAX_BROADCAST_CELLS, checkpoint, shuffled

MAX_CELLS = 4096
# Distances are compared with this much room, relative and absolute, so that rounding hides no neighbour and no tie.
ROOM = 1e-7


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    square = (x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None, :] - 2.0 * (x @ centroids.T)
    return np.sqrt(np.maximum(square, 0.0))


def _lists(rows: list[np.ndarray | None]) -> pa.ListArray:
    held = [np.zeros(0, "i4") if r is None else r for r in rows]
    offsets = pa.array(np.concatenate([[0], np.cumsum([len(r) for r in held])]).astype("i4"))
    return pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([np.zeros(0, "i4"), *held]).astype("i4")), mask=pa.array([r is None for r in rows], pa.bool_()))


def _nearest(x: Column, centroids: np.ndarray) -> Column:
    """Cell and distance to its centroid; ties go to the lower cell."""

    @F.arrow_udf("struct<cell:int,away:double>")
    def pick(v: pa.Array) -> pa.Array:
        fields = ["cell", "away"]
        if len(v) == 0:
            return pa.StructArray.from_arrays([pa.array([], pa.int32()), pa.array([], pa.float64())], fields)
        d = _distances(to_matrix(v), centroids)
        cell = d.argmin(axis=1)
        return pa.StructArray.from_arrays([pa.array(cell.astype("i4")), pa.array(d[np.arange(len(d)), cell])], fields)

    return pick(x)


@dataclass
class Cells:
    """Centroids with the number of vectors and the radius of each, and the vectors ``id, vec, cell``."""

    centroids: np.ndarray
    sizes: np.ndarray
    radius: np.ndarray
    items: DataFrame


def seeds(items: DataFrame, cells: int) -> np.ndarray:
    """About ``cells`` vectors: those whose id's digest lies below a share of all digests.  No sort, no limit."""
    n = items.count()
    share = min(1.0, cells / max(n, 1))
    key = F.conv(F.substring(F.md5(F.col("id").cast("string")), 1, 12), 16, 10).cast("bigint")
    drawn = items.where(key < int(share * 16**12)) if share < 1 else items
    found = to_matrix(drawn.select("vec").toArrow()["vec"])
    return np.unique(found, axis=0) if found.size else found


def train_cells(items: DataFrame, cells: int | None = None, rounds: int = 3) -> Cells:
    """Cells of items(id, vec): by default about the square root of their number."""
    items = checkpoint(items.select("id", "vec"))
    head = items.limit(1).collect()
    if not head:
        return Cells(np.zeros((0, 0)), np.zeros(0, "i8"), np.zeros(0), items.withColumn("cell", F.lit(0)))
    width = max(1, len(head[0]["vec"]))
    wanted = cells or int(np.sqrt(items.count()))
    centroids = seeds(items, max(1, min(wanted, MAX_CELLS, MAX_BROADCAST_CELLS // width)))
    if not len(centroids):  # a small table none of whose digests is that low
        centroids = to_matrix(items.limit(1).select("vec").toArrow()["vec"])
    for _ in range(rounds):
        dealt = items.withColumn("cell", _nearest(F.col("vec"), centroids)["cell"])
        moved = centroids.copy()
        for row in dealt.groupBy("cell").agg(vector_sum("vec", width).alias("vec"), F.count(F.lit(1)).alias("n")).collect():  # one row a cell
            moved[row["cell"]] = np.array(row["vec"]) / row["n"]
        centroids = moved
    placed = checkpoint(items.withColumn("at", _nearest(F.col("vec"), centroids)).select("id", "vec", F.col("at.cell").alias("cell"), F.col("at.away").alias("away")))
    sizes, radius = np.zeros(len(centroids), "i8"), np.zeros(len(centroids))
    for row in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("away").alias("r")).collect():
        sizes[row["cell"]], radius[row["cell"]] = row["n"], row["r"]
    return Cells(centroids, sizes, radius, placed.drop("away"))


def _first_cells(vec: Column, cells: Cells, enough: int) -> Column:
    """The nearest cells that together hold ``enough`` vectors."""
    centroids, sizes = cells.centroids, cells.sizes

    @F.arrow_udf("array<int>")
    def pick(v: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], pa.list_(pa.int32()))
        order = np.argsort(_distances(to_matrix(v), centroids), axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        many = (held < enough).sum(axis=1) + 1
        return _lists([row[:n] for row, n in zip(order, many)])

    return pick(vec)


def _further_cells(vec: Column, bound: Column, cells: Cells, enough: int) -> Column:
    """Cells that may hold a vector within ``bound`` (null: any), but for those looked into first; null if they are more than
    MAX_COPIES."""
    centroids, sizes, radius = cells.centroids, cells.sizes, cells.radius

    @F.arrow_udf("array<int>")
    def pick(v: pa.Array, limit: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], pa.list_(pa.int32()))
        d = _distances(to_matrix(v), centroids)
        order = np.argsort(d, axis=1, kind="stable")
        held = np.cumsum(sizes[order], axis=1)
        many = (held < enough).sum(axis=1) + 1
        most = limit.fill_null(np.inf).to_numpy(zero_copy_only=False)
        near = (d - radius[None, :] <= (most + ROOM * (1.0 + np.where(np.isinf(most), 0.0, most)))[:, None]) & (sizes > 0)[None, :]
        out = []
        for row, (cells_by, n) in zip(near, zip(order, many)):
            row[cells_by[:n]] = False
            out.append(np.flatnonzero(row) if np.count_nonzero(row) <= MAX_COPIES else None)
        return _lists(out)

    return pick(vec, bound)


def nearest_in_cells(queries: DataFrame, cells: Cells, n: int, exclude_self: bool = True, **blocks) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score, rank): the ``n`` nearest by L2 of queries(query_id, vec), as all against all would find them, and
    (query_id, cell): the cells looked into.  A query without as many neighbours gets all there are."""
    fold = TopK(n, "l2", exclude_self=exclude_self)
    enough = n + (1 if exclude_self else 0)

    def look(probes: DataFrame) -> DataFrame:
        wanted = [r["cell"] for r in probes.select("cell").distinct().collect()]  # at most MAX_CELLS
        items = cells.items if len(wanted) == len(cells.centroids) else cells.items.where(F.col("cell").isin(wanted))
        return checkpoint(block_join(probes, items, fold, query_key="query_id", item_key="id", group="cell", unit=False, **blocks).select("query_id", "vec_id", "score"))

    queries = checkpoint(queries.select("query_id", "vec"))
    if not len(cells.centroids):
        none = queries.where("false")
        return rank_hits(none.select("query_id", F.col("query_id").alias("vec_id"), F.lit(0.0).alias("score")), n), none.select("query_id", F.lit(0).alias("cell"))
    first = queries.withColumn("cell", F.explode(_first_cells(F.col("vec"), cells, enough)))
    found = look(first)
    best = rank_hits(found, n, ascending=True).groupBy("query_id").agg(F.max("score").alias("last"), F.count(F.lit(1)).alias("have"))
    bounded = queries.join(shuffled(best), "query_id", "left").withColumn("bound", F.when(F.col("have") >= n, F.col("last")))
    bounded = checkpoint(bounded.select("query_id", "vec", _further_cells(F.col("vec"), F.col("bound"), cells, enough).alias("cells")))
    looked = first.select("query_id", "cell")
    # Rows of one id rank together, so all of them go the way that one of them has to.
    wide = bounded.where(F.col("cells").isNull()).select("query_id").distinct()
    if not wide.isEmpty():
        found, looked = (df.join(shuffled(wide), "query_id", "left_anti") for df in (found, looked))
        broad, bounded = (bounded.join(shuffled(wide), "query_id", how) for how in ("left_semi", "left_anti"))
        looked = looked.unionByName(broad.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(len(cells.centroids) - 1))).alias("cell")))
        found = found.unionByName(block_join(broad, cells.items, fold, query_key="query_id", item_key="id", unit=False, **blocks).select("query_id", "vec_id", "score"))
        found = checkpoint(found)
    second = bounded.select("query_id", "vec", F.explode("cells").alias("cell"))
    looked = looked.unionByName(second.select("query_id", "cell"))
    if not second.isEmpty():
        found = found.unionByName(look(second))
    return rank_hits(found, n, ascending=True), looked
