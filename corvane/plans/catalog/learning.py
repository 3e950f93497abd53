"""Loss, sampling, splitting and batching queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.operators import losses as L
from corvane.operators import sampling as M
from corvane.plans.catalog.fixtures import SQL_E, SQL_PAIRS, aligned_pairs, r6, sql_r6, table, vectors
from corvane.runtime import shuffled

SEED, N_NEG = 7, 4


# --- losses ------------------------------------------------------------------------------------


def _neighbours(spark, d, name="anchor_id"):
    """vec_id + 1 .. + 4 (mod n) as negatives of every vector."""
    vecs = vectors(spark, d)
    n = vecs.count()
    steps = F.explode(F.sequence(F.lit(1), F.lit(N_NEG)))
    links = vecs.select(F.col("vec_id").alias(name), steps.alias("s")).withColumn("vec_id", (F.col(name) + F.col("s")) % n)
    return links.join(shuffled(vecs), "vec_id").select(name, F.col("vec").alias("negative"))


def _rolled(spark, d):
    """Triplets of the mini-batches: the negative is the batch's previous code."""
    pairs = aligned_pairs(spark, d)
    rolled = L.rolled_negatives(pairs.select("batch_id", "id"))
    negatives = pairs.select(F.col("id").alias("negative_id"), F.col("code").alias("negative"))
    return pairs.join(shuffled(rolled), ["batch_id", "id"]).join(shuffled(negatives), "negative_id").select(
        "batch_id", "id", F.col("query").alias("anchor"), F.col("code").alias("positive"), "negative"
    )


SQL_ROLLED = f"""{SQL_PAIRS},
roll AS (
  SELECT batch_id, id, coalesce(lag(id) OVER (PARTITION BY batch_id ORDER BY id),
         last_value(id) OVER (PARTITION BY batch_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS negative_id
  FROM pairs),
tri AS (SELECT p.batch_id, p.id, p.query AS anchor, p.code AS positive, n.code AS negative
        FROM pairs p JOIN roll USING (batch_id, id) JOIN pairs n ON n.id = roll.negative_id)"""


def _eps(a: str, b: str) -> str:
    return f"list_distance(list_transform({a}, lambda x: x + 1e-6::DOUBLE), {b})"


SQL_TRIPLET_TERM = f"greatest({_eps('anchor', 'positive')} - {_eps('anchor', 'negative')} + 0.5::DOUBLE, 0::DOUBLE)"


def triplet(spark, d):
    return L.triplet_loss(_rolled(spark, d)).select(r6(F.col("loss")).alias("loss"))


def triplet_hard(spark, d):
    pairs = aligned_pairs(spark, d).select(F.col("id").alias("anchor_id"), F.col("query").alias("anchor"), F.col("code").alias("positive"))
    return L.triplet_loss_hard(pairs, _neighbours(spark, d)).select(r6(F.col("loss")).alias("loss"))


_SQL_NEGATIVES = f"""neg AS (SELECT a.vec_id AS id, b.v AS negative FROM e a CROSS JOIN range(1, {N_NEG + 1}) r(s)
  JOIN e b ON b.vec_id = (a.vec_id + s) % (SELECT count(*) FROM e))"""
SQL_HARD = f"""WITH {SQL_PAIRS}, {_SQL_NEGATIVES},
st AS (SELECT id, any_value({_eps('query', 'code')}) AS p, min(list_distance(query, negative)) AS lo, avg(list_distance(query, negative)) AS mean
       FROM pairs JOIN neg USING (id) GROUP BY id)
SELECT {sql_r6('avg(0.3::DOUBLE * greatest(p - lo + 0.5::DOUBLE, 0) + 0.7::DOUBLE * greatest(p - mean + 0.5::DOUBLE, 0))')} AS loss FROM st"""


def contrast(spark, d):
    pairs = aligned_pairs(spark, d).select(F.col("id").alias("query_id"), "query", F.col("code").alias("positive"))
    return L.infonce(pairs, _neighbours(spark, d, "query_id")).select(r6(F.col("loss")).alias("loss"))


def _cos(a: str, b: str) -> str:
    return f"list_inner_product({a}, {b}) / sqrt(list_inner_product({a}, {a}) * list_inner_product({b}, {b})) / 0.07::DOUBLE"


SQL_INFONCE = f"""WITH {SQL_PAIRS}, {_SQL_NEGATIVES},
lg AS (SELECT id, {_cos('query', 'negative')} AS l, false AS own FROM pairs JOIN neg USING (id)
       UNION ALL SELECT id, {_cos('query', 'code')}, true FROM pairs),
t AS (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM lg),
q AS (SELECT id, ln(sum(exp(l - top))) + max(top) - max(l) FILTER (WHERE own) AS loss FROM t GROUP BY id)
SELECT {sql_r6('avg(loss)')} AS loss FROM q"""


def in_batch(target, **blocks):
    def query(spark, d):
        pairs = aligned_pairs(spark, d).select("batch_id", "id", "query", F.col("code").alias("positive"))
        return L.infonce_in_batch(pairs, target, **blocks).select("batch_id", r6(F.col("loss")).alias("loss"))

    return query


def sql_in_batch(target: str) -> str:
    """CTEs ending in ``ib(batch_id, loss)``."""
    own = "b.id = a.id" if target == "diagonal" else "b.id = a.batch_id * 32"
    return f"""lg AS (
  SELECT a.batch_id, a.id, {_cos('a.query', 'b.code')} AS l, {own} AS own FROM pairs a JOIN pairs b ON a.batch_id = b.batch_id),
t AS (SELECT *, max(l) OVER (PARTITION BY id) AS top FROM lg),
q AS (SELECT batch_id, id, ln(sum(exp(l - top))) + max(top) - max(l) FILTER (WHERE own) AS loss FROM t GROUP BY ALL),
ib AS (SELECT batch_id, avg(loss) AS loss FROM q GROUP BY batch_id)"""


def combined(spark, d):
    out = L.combined_loss(_rolled(spark, d))
    return out.select("batch_id", *[r6(F.col(c)).alias(c) for c in ("total", "triplet", "infonce")])


SQL_COMBINED = f"""WITH {SQL_ROLLED}, {sql_in_batch('first')},
tl AS (SELECT batch_id, avg({SQL_TRIPLET_TERM}) AS triplet FROM tri GROUP BY batch_id)
SELECT batch_id, {sql_r6('0.5::DOUBLE * triplet + 0.5::DOUBLE * loss')} AS total, {sql_r6('triplet')} AS triplet, {sql_r6('loss')} AS infonce
FROM tl JOIN ib USING (batch_id)"""


def epoch(spark, d):
    return L.epoch_loss(L.triplet_terms(_rolled(spark, d))).select(r6(F.col("loss")).alias("loss"))


# --- sampling ----------------------------------------------------------------------------------


def _pool(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"))


def _anchors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("anchor_id"))


def _cache(spark, d):
    return vectors(spark, d).select(F.col("vec_id").alias("id"), "vec")


def sql_random(name: str, n: int, seed: int = SEED, source: str = "embeddings", key: str = "vec_id") -> str:
    """CTE ``name(anchor_id, negative_id)``: the draws of the sampler, one step per column."""
    steps, seen = [], []
    for s in range(n):
        draw = f"('0x' || substr(md5('{seed}:' || anchor_id || ':{s}'), 1, 15))::BIGINT % (m - {n} + {s} + 1)"
        earlier = f"list_contains([{', '.join(seen)}], t{s})" if seen else "false"
        steps.append(f"{draw} AS t{s}, CASE WHEN {earlier} THEN m - {n} + {s} ELSE t{s} END AS p{s}")
        seen.append(f"p{s}")
    return f"""{name}_pos AS (SELECT {key} AS vec_id, row_number() OVER (ORDER BY {key}) - 1 AS position FROM {source}),
{name} AS (
  SELECT anchor_id, x.vec_id AS negative_id FROM (
    SELECT anchor_id, CASE WHEN p >= own THEN p + 1 ELSE p END AS position FROM (
      SELECT anchor_id, own, unnest([{', '.join(seen)}]) AS p FROM (
        SELECT anchor_id, own, {', '.join(steps)} FROM (
          SELECT vec_id AS anchor_id, position AS own, (SELECT count(*) FROM {source}) - 1 AS m FROM {name}_pos))))
  JOIN {name}_pos x USING (position))"""


def sql_hard(name: str, n: int) -> str:
    return f"""{name} AS (
  SELECT anchor_id, negative_id FROM (
    SELECT a.vec_id AS anchor_id, b.vec_id AS negative_id,
           row_number() OVER (PARTITION BY a.vec_id ORDER BY round(list_distance(a.v, b.v), 9), b.vec_id) AS r
    FROM e a JOIN e b ON a.vec_id <> b.vec_id) WHERE r <= {n})"""


def random_rows(spark, d):
    return M.random_negatives(_pool(spark, d), _anchors(spark, d), N_NEG, SEED)


def hard_rows(**blocks):
    return lambda spark, d: M.hard_negatives(_cache(spark, d), _anchors(spark, d), 2, _pool(spark, d), SEED, **blocks)


def triplets(cached: bool):
    def query(spark, d):
        return M.sample_triplets(_pool(spark, d), _anchors(spark, d), _cache(spark, d) if cached else None, seed=SEED)

    return query


def split_rows(mode, *shares):
    return lambda spark, d: M.split(table(spark, d, "documents"), "doc_id", SEED, mode, *shares).select("doc_id", "split")


_KEY = f"md5('{SEED}:' || doc_id)"
SQL_SPLIT_EXACT = f"""SELECT doc_id, CASE WHEN r < floor(0.8::DOUBLE * n) THEN 'train'
  WHEN r < floor(0.8::DOUBLE * n) + floor(0.1::DOUBLE * n) THEN 'val' ELSE 'test' END AS split
FROM (SELECT doc_id, row_number() OVER (ORDER BY {_KEY}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)"""
SQL_SPLIT_HASH = f"""SELECT doc_id, CASE WHEN {_KEY} < 'cccccccc' THEN 'train' WHEN {_KEY} < 'e6666666' THEN 'val' ELSE 'test' END AS split
FROM documents"""


def batches(size, seed):
    return lambda spark, d: M.mini_batches(table(spark, d, "documents").select("doc_id"), "doc_id", size, seed)


QUERIES = {
    "triplet_loss": (triplet, f"WITH {SQL_ROLLED} SELECT {sql_r6(f'avg({SQL_TRIPLET_TERM})')} AS loss FROM tri"),
    "triplet_loss_hard": (triplet_hard, SQL_HARD),
    "infonce": (contrast, SQL_INFONCE),
    "infonce_in_batch_first": (
        in_batch("first"),
        f"WITH {SQL_PAIRS}, {sql_in_batch('first')} SELECT batch_id, {sql_r6('loss')} AS loss FROM ib",
    ),
    "infonce_in_batch_diagonal": (
        in_batch("diagonal"),
        f"WITH {SQL_PAIRS}, {sql_in_batch('diagonal')} SELECT batch_id, {sql_r6('loss')} AS loss FROM ib",
    ),
    "infonce_in_batch_grid": (
        in_batch("diagonal", broadcast_cells=0, query_rows=10, item_rows=12),
        f"WITH {SQL_PAIRS}, {sql_in_batch('diagonal')} SELECT batch_id, {sql_r6('loss')} AS loss FROM ib",
    ),
    "combined_loss": (combined, SQL_COMBINED),
    "rolled_negatives": (
        lambda spark, d: L.rolled_negatives(aligned_pairs(spark, d)),
        f"WITH {SQL_ROLLED} SELECT batch_id, id, negative_id FROM roll",
    ),
    "epoch_loss": (
        epoch,
        f"WITH {SQL_ROLLED}, b AS (SELECT batch_id, avg({SQL_TRIPLET_TERM}) AS m FROM tri GROUP BY batch_id) "
        f"SELECT {sql_r6('avg(m)')} AS loss FROM b",
    ),
    "random_negatives": (random_rows, f"WITH {sql_random('rnd', N_NEG)} SELECT * FROM rnd"),
    "hard_negatives": (hard_rows(), f"WITH {SQL_E}, {sql_hard('hard', 2)} SELECT * FROM hard"),
    "hard_negatives_cells": (hard_rows(cells=16), f"WITH {SQL_E}, {sql_hard('hard', 2)} SELECT * FROM hard"),
    "hard_negatives_grid": (
        hard_rows(broadcast_cells=0, query_rows=100, item_rows=128),
        f"WITH {SQL_E}, {sql_hard('hard', 2)} SELECT * FROM hard",
    ),
    "sample_triplets": (
        triplets(True),
        f"WITH {SQL_E}, {sql_hard('hard', 2)}, {sql_random('rnd', 2)} "
        "SELECT anchor_id, anchor_id AS positive_id, negative_id, 'hard' AS kind FROM hard "
        "UNION ALL SELECT anchor_id, anchor_id, negative_id, 'random' FROM rnd",
    ),
    "sample_triplets_no_cache": (
        triplets(False),
        f"WITH {sql_random('rnd', N_NEG)} SELECT anchor_id, anchor_id AS positive_id, negative_id, 'random' AS kind FROM rnd",
    ),
    "single_triplet": (
        lambda spark, d: M.single_triplet(_pool(spark, d), _anchors(spark, d), SEED),
        f"WITH {sql_random('rnd', 1)} SELECT anchor_id, anchor_id AS positive_id, negative_id FROM rnd",
    ),
    "split_exact": (split_rows("exact"), SQL_SPLIT_EXACT),
    "split_hash": (split_rows("hash"), SQL_SPLIT_HASH),
    "split_hash_two_way": (split_rows("hash", 0.9, 0.1), f"SELECT doc_id, CASE WHEN {_KEY} < 'e6666666' THEN 'train' ELSE 'val' END AS split FROM documents"),
    "mini_batches": (
        batches(64, None),
        "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS batch_id FROM documents",
    ),
    "mini_batches_shuffled": (
        batches(32, SEED),
        f"SELECT doc_id, (row_number() OVER (ORDER BY {_KEY}, doc_id) - 1) // 32 AS batch_id FROM documents",
    ),
}
