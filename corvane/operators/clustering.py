"""Training the cells of an inverted-file index."""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F

from corvane.functions import vectors as V
from corvane.functions.matrix import to_matrix, unit_rows
from corvane.operators.gnn import vector_sum
from corvane.operators.search import assign_cells, ivf_assign
from corvane.runtime import MAX_BROADCAST_CELLS, checkpoint

# Hex digits of the ids' digests that a counting pass looks at.
_DEPTHS = (4, 8, 32)


def _key_of_rank(keys: DataFrame, rank: int) -> tuple[str | None, int]:
    """The key (32 hex digits) at ``rank`` in order, and how many rows of that key come before it; None beyond the end.

    Every pass counts by a longer prefix, only below the prefix found: at most 16 ** 4 counts reach the driver.
    """
    prefix = ""
    for depth in _DEPTHS:
        counts = keys.where(F.startswith("key", F.lit(prefix))).groupBy(F.substring("key", 1, depth).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        for row in sorted(counts, key=lambda r: r["p"]):
            if rank < row["n"]:
                prefix = row["p"]
                break
            rank -= row["n"]
        else:
            return None, 0
    return prefix, rank


def seed_rows(items: DataFrame, n: int) -> DataFrame:
    """The ``n`` rows of smallest md5(vec_id), all if there are fewer: a filter by the digest at the boundary, no sort."""
    keyed = items.withColumn("key", F.md5(F.col("vec_id").cast("string")))
    bound, more = _key_of_rank(keyed.select("key"), n)
    if bound is None:
        return keyed
    below = keyed.where(F.col("key") < bound)
    return below.unionByName(keyed.where(F.col("key") == bound).limit(more)) if more else below


def ivf_train(
    items: DataFrame, nlist: int = 100, iterations: int = 10, method: str = "lloyd", seed: int = 0, most_cells: int = MAX_BROADCAST_CELLS
) -> np.ndarray | DataFrame:
    """Unit centroids of items(vec_id, vec); at most ``nlist``, fewer for fewer vectors.

    "lloyd" starts from the vectors of smallest md5(id), so every engine gives the same cells: each round is one assignment and one
    partially aggregated sum per cell.  Up to ``most_cells`` numbers the centroids are an array (cells, dim) that goes
    to every task; more of them are a stored table (cell, vec), met block by block.  "kmeans" is Spark ML's clustering with
    cosine distance, whose start is random.
    """
    unit = items.select("vec_id", V.l2_normalize(F.col("vec")).alias("vec"))
    if method == "kmeans":
        model = KMeans(k=nlist, distanceMeasure="cosine", seed=seed, maxIter=iterations).fit(
            unit.select(array_to_vector("vec").alias("features"))
        )
        return unit_rows(np.array(model.clusterCenters()))
    if method != "lloyd":
        raise ValueError(f"unknown training method {method!r}")
    head = unit.select(F.size("vec").alias("width")).first()
    if head is not None and min(nlist, items.count()) * head["width"] > most_cells:
        return _train_table(checkpoint(unit), nlist, iterations, head["width"])
    seeds = seed_rows(unit, nlist).select("key", "vec_id", "vec").toArrow().sort_by([("key", "ascending"), ("vec_id", "ascending")])
    centroids = unit_rows(to_matrix(seeds["vec"]))
    for _ in range(iterations):
        sums = ivf_assign(unit, centroids).groupBy("cell").agg(vector_sum("vec", centroids.shape[1]).alias("vec"))
        moved = centroids.copy()
        for row in sums.collect():  # one row per cell
            moved[row["cell"]] = row["vec"]
        centroids = unit_rows(moved)
    return centroids


def _train_table(unit: DataFrame, nlist: int, iterations: int, width: int) -> DataFrame:
    """The same rounds with the centroids in a table."""
    from corvane.operators.positions import with_positions

    seeds = with_positions(seed_rows(unit, nlist), "key", "vec_id", name="cell")
    centroids = checkpoint(seeds.select(F.col("cell").cast("int").alias("cell"), "vec"))
    for _ in range(iterations):
        sums = assign_cells(unit, centroids).groupBy("cell").agg(vector_sum("vec", width).alias("moved"))
        rows = centroids.join(sums, "cell", "left")
        centroids = checkpoint(rows.select("cell", V.l2_normalize(F.coalesce("moved", "vec")).alias("vec")))
    return centroids
