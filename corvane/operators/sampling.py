"""Negative sampling, splitting and batching: reproducible, and linear in the number of rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.hashing import md5_int, md5_key
from corvane.functions.vectors import let
from corvane.operators.blocks import TopK, block_join
from corvane.operators.cells import nearest_in_cells, train_cells
from corvane.operators.positions import with_positions
from corvane.operators.search import rank_hits
from corvane.runtime import checkpoint, explode_once, shuffled

NUM_NEGATIVES, HARD_RATIO = 4, 0.5


def _draws(anchor: Column, others: Column, n: int, seed) -> Column:
    """min(n, others) distinct positions below ``others``, each subset equally likely.

    Step s draws below ``others - k + s + 1``; a position drawn before is replaced by the step's
    upper end, which no earlier step could reach.
    """
    k = F.least(F.lit(n).cast("bigint"), others)

    def step(taken: Column, s: Column) -> Column:
        return let(
            lambda b: F.concat(
                taken, F.array(F.when(F.array_contains(taken, b["t"]), b["end"]).otherwise(b["t"]))
            ),
            end=others - k + s,
            t=md5_int(md5_key(seed, anchor, s)) % (others - k + s + 1),
        )

    empty = F.array().cast("array<bigint>")
    return F.when(k > 0, F.aggregate(F.sequence(F.lit(0).cast("bigint"), k - 1), empty, step)).otherwise(empty)


def random_negatives(pool: DataFrame, anchors: DataFrame, n: int, seed=0) -> DataFrame:
    """(anchor_id, negative_id): ``n`` distinct pool ids other than the anchor, all if there are fewer.

    pool(id), anchors(anchor_id).  Positions are drawn in the anchor's own row and looked up by an
    equi-join on the pool's dense positions: rows grow with n per anchor, never with the pool.
    """
    placed = with_positions(pool.select("id"), "id")
    size = placed.count()
    mine = anchors.select("anchor_id").join(shuffled(placed.withColumnsRenamed({"id": "anchor_id", "position": "own"})), "anchor_id", "left")
    others = F.when(F.col("own").isNull(), F.lit(size)).otherwise(F.lit(size - 1)).cast("bigint")
    drawn = mine.select("anchor_id", "own", explode_once(_draws(F.col("anchor_id"), others, n, seed)).alias("p"))
    drawn = drawn.where(F.col("p").isNotNull())
    past_own = F.when(F.col("p") >= F.col("own"), F.col("p") + 1).otherwise(F.col("p"))
    return drawn.select("anchor_id", past_own.alias("position")).join(
        shuffled(placed.withColumnRenamed("id", "negative_id")), "position"
    ).select("anchor_id", "negative_id")


# From so many cached vectors on, neighbours are looked for in cells instead of among all.
CELLS_FROM = 50_000


def hard_negatives(
    cache: DataFrame, anchors: DataFrame, n: int, pool: DataFrame | None = None, seed=0, cells: int | None = None, **blocks
) -> DataFrame:
    """(anchor_id, negative_id): the ``n`` nearest cached vectors by L2, the anchor excluded.

    cache(id, vec), anchors(anchor_id).  With ``pool(id)``, anchors that are not cached or find fewer
    than ``n`` neighbours are topped up by random negatives.  ``cells`` is the number of cells a large cache is
    looked through by (0: all against all); the neighbours are the same.
    """
    queries = anchors.join(shuffled(cache.select(F.col("id").alias("anchor_id"), "vec")), "anchor_id")
    if cells or (cells is None and cache.count() >= CELLS_FROM):
        ranked, _ = nearest_in_cells(queries.withColumnRenamed("anchor_id", "query_id"), train_cells(cache, cells), n, **blocks)
    else:
        hits = block_join(queries, cache, TopK(n, "l2", exclude_self=True), query_key="anchor_id", item_key="id", unit=False, **blocks)
        ranked = rank_hits(hits, n, ascending=True)
    found = ranked.select(F.col("query_id").alias("anchor_id"), F.col("vec_id").alias("negative_id"))
    if pool is None:
        return found
    found = checkpoint(found)
    counts = found.groupBy("anchor_id").agg(F.count(F.lit(1)).alias("have"))
    short = anchors.join(shuffled(counts), "anchor_id", "left").select("anchor_id", F.coalesce("have", F.lit(0)).alias("have"))
    short = checkpoint(short.where(F.col("have") < n))
    if short.isEmpty():
        return found
    extra = random_negatives(pool, short.select("anchor_id"), n, seed).join(shuffled(short), "anchor_id")
    # Of at most n draws per anchor keep the first n - have; their order is the draw's own hash.
    ranked = extra.groupBy("anchor_id", "have").agg(
        F.array_sort(F.collect_list(F.struct(md5_key(seed, F.col("anchor_id"), F.col("negative_id")).alias("h"), "negative_id"))).alias("c")
    )
    topped = ranked.select("anchor_id", F.explode(F.slice("c", F.lit(1), F.lit(n) - F.col("have"))).alias("e"))
    return found.unionByName(topped.select("anchor_id", "e.negative_id"))


def sample_triplets(
    pool: DataFrame,
    anchors: DataFrame,
    cache: DataFrame | None = None,
    num_negatives: int = NUM_NEGATIVES,
    hard_ratio: float = HARD_RATIO,
    seed=0,
) -> DataFrame:
    """(anchor_id, positive_id, negative_id, kind); without a cache all negatives are random.

    A vector may come up both as a hard and as a random negative.
    """
    hard = int(num_negatives * hard_ratio) if cache is not None else 0
    rows = random_negatives(pool, anchors, num_negatives - hard, seed).withColumn("kind", F.lit("random"))
    if hard:
        rows = hard_negatives(cache, anchors, hard, pool, seed).withColumn("kind", F.lit("hard")).unionByName(rows)
    return rows.select("anchor_id", F.col("anchor_id").alias("positive_id"), "negative_id", "kind")


def single_triplet(pool: DataFrame, anchors: DataFrame, seed=0) -> DataFrame:
    """One uniform negative per anchor; the positive is the anchor itself."""
    rows = random_negatives(pool, anchors, 1, seed)
    return rows.select("anchor_id", F.col("anchor_id").alias("positive_id"), "negative_id")


SPLITS = ("train", "val", "test")
_LEVEL = 4  # hex digits looked at per counting pass


def _boundaries(keys: DataFrame, shares: tuple[float, float]) -> list[str]:
    """First key behind int(share_1 n) rows, and behind int(share_2 n) more, in key order.

    Three counting passes serve both: each looks four digits deeper, only below the prefixes that
    hold a boundary, and brings at most 2 * 16^4 counts to the driver (the last a handful of keys).
    """

    def counts(frame: DataFrame, name: Column) -> dict[str, int]:
        rows = frame.groupBy(name.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
        return {r["p"]: r["n"] for r in rows}

    level = counts(keys, F.substring("key", 1, _LEVEL))
    n = sum(level.values())
    first = int(shares[0] * n)
    ranks = {i: r for i, r in enumerate((first, first + int(shares[1] * n))) if r < n}
    prefixes = dict.fromkeys(ranks, "")
    for depth in (_LEVEL, 2 * _LEVEL, 32):
        if depth > _LEVEL:
            held = F.substring("key", 1, len(next(iter(prefixes.values()), ""))).isin(*set(prefixes.values()))
            level = counts(keys.where(held), F.substring("key", 1, depth)) if prefixes else {}
        for i, rank in ranks.items():
            for name in sorted(p for p in level if p.startswith(prefixes[i])):
                if rank < level[name]:
                    prefixes[i], ranks[i] = name, rank
                    break
                rank -= level[name]
    return [prefixes.get(i, "g") for i in range(2)]  # "g" sorts behind every hex digest


def split(df: DataFrame, key: str, seed=0, mode: str = "exact", train: float = 0.8, val: float = 0.1) -> DataFrame:
    """Add ``split`` after a reproducible shuffle.

    "exact": the first int(train*n) rows in md5 order, the next int(val*n), the rest.  Only the two
    boundary keys are looked up; assigning rows is then a comparison, without a shuffle.  Rows with equal
    keys share a side, so counts are exact for unique keys only.
    "hash": fixed shares of the key space, no counting at all.
    """
    if min(train, val) < 0 or train + val > 1 + 1e-9:
        raise ValueError("shares must not be negative, nor add up to more than 1")
    shuffled = md5_key(seed, F.col(key))
    if mode == "hash":
        places = [int(share * 16**8 + 1e-3) for share in (train, train + val)]
        bounds = [f"{place:08x}" if place < 16**8 else "g" for place in places]
    elif mode == "exact":
        bounds = _boundaries(df.select(shuffled.alias("key")), (train, val))
    else:
        raise ValueError(f"unknown split mode {mode!r}")
    name = F.when(shuffled < bounds[0], SPLITS[0]).when(shuffled < bounds[1], SPLITS[1]).otherwise(SPLITS[2])
    return df.withColumn("split", name)


def mini_batches(df: DataFrame, key: str, size: int = 32, shuffle_seed=None) -> DataFrame:
    """Add ``batch_id`` (position div size), in key order or shuffled; the last batch may be short.

    Only keys are put in order and written out; the rows join them once.
    """
    keys = df.select(key)
    if shuffle_seed is None:
        placed = with_positions(keys, key)
    else:
        placed = with_positions(keys.withColumn("_shuffle", md5_key(shuffle_seed, F.col(key))), "_shuffle", key)
    batches = placed.select(key, F.floor(F.col("position") / size).alias("batch_id"))
    return batches if df.columns == [key] else df.join(shuffled(batches), key)


def write_embedding_cache(cache: DataFrame, path: str) -> None:
    """Replace the snapshot of cached vectors (id, vec) that hard negatives are drawn from."""
    cache.select("id", "vec").write.mode("overwrite").parquet(path)


def read_embedding_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("id bigint, vec array<double>").parquet(path)
