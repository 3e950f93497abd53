"""Vector function, pooling and fusion queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from corvane.functions import vectors as V
from corvane.functions.matrix import linear, linear_join
from corvane.functions.text import words
from corvane.operators import encode as N
from corvane.operators.gnn import batch_standardize
from corvane.operators.records import embedding_dim
from corvane.plans.catalog.fixtures import (
    SQL_E,
    SQL_PAIRS,
    SQL_UNIT,
    aligned_pairs,
    long_form,
    r6,
    sql_layer_norm,
    sql_linear,
    sql_long,
    sql_r6,
    sql_w,
    table,
    vectors,
    weight,
)

OUT, TOKEN_DIM, HEADS, D = 16, 8, 8, 64
_E_LONG = f"{SQL_E}, {sql_long('x', 'e', 'vec_id', 'v')}"


def _each(fn):
    return lambda spark, d: long_form(vectors(spark, d).select("vec_id", fn(F.col("vec")).alias("vec")), "vec_id")


def _long_sql(ctes: str, source: str, key: str = "vec_id") -> str:
    return f"WITH {ctes} SELECT {key}, d AS dim, {sql_r6('x')} AS value FROM {source}"


def _weight_table(spark):
    """The weight formula as a table (i, j, w)."""
    ids = spark.range(OUT * D).select((F.col("id") % OUT).cast("int").alias("i"), F.expr(f"CAST(id div {OUT} AS INT)").alias("j"))
    return ids.withColumn("w", ((F.col("i") * 7 + F.col("j") * 3) % 11 - 5) / F.lit(11.0))


def _pairwise(spark, d):
    p, (a, b) = aligned_pairs(spark, d), (F.col("query"), F.col("code"))
    return p.select(
        "id",
        r6(V.inner_product(a, b)).alias("inner_product"),
        r6(V.cosine(a, b)).alias("cosine"),
        r6(V.l2_distance(a, b)).alias("l2_distance"),
        r6(V.pairwise_distance(a, b)).alias("pairwise_distance"),
    )


SQL_PAIRWISE = f"""WITH {SQL_PAIRS}
SELECT id, {sql_r6('list_inner_product(query, code)')} AS inner_product,
  {sql_r6('list_inner_product(query, code) / sqrt(list_inner_product(query, query) * list_inner_product(code, code))')} AS cosine,
  {sql_r6('list_distance(query, code)')} AS l2_distance,
  {sql_r6('list_distance(list_transform(query, lambda x: x + 1e-6::DOUBLE), code)')} AS pairwise_distance
FROM pairs"""


def dimension(spark, d):
    return long_form(embedding_dim(table(spark, d, "embeddings")).select("vec_id", "dimension", F.col("embedding").cast("array<double>").alias("embedding")), ["vec_id", "dimension"], "embedding")


def token_vectors(spark, d):
    """Word positions of the documents with 8-d vectors from the word's digest; the digest also says which words are masked."""
    docs = table(spark, d, "documents").select("doc_id", F.posexplode(words(F.col("text"))).alias("pos", "w"))
    digest = F.md5("w")
    parts = [(F.ascii(F.substring(digest, k + 1, 1)) - 72) / F.lit(32.0) for k in range(TOKEN_DIM)]
    return docs.select(
        "doc_id", "pos", F.array(*parts).alias("vec"), (F.substring(digest, 32, 1) < "c").cast("int").alias("mask")
    )


SQL_TOKENS = f"""l AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: w <> '') AS ws FROM documents),
f AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM l),
tv AS (
  SELECT doc_id, pos, CASE WHEN substr(md5(w), 32, 1) < 'c' THEN 1 ELSE 0 END AS mask, k AS d,
         (ascii(substr(md5(w), k + 1, 1)) - 72)::DOUBLE / 32 AS x
  FROM f, range({TOKEN_DIM}) g(k))"""
_POOL_SQL = {
    "cls": "SELECT doc_id, d, x FROM tv WHERE pos = 0",
    "mean": "SELECT doc_id, d, sum(x * mask) / greatest(sum(mask), 1e-9::DOUBLE) AS x FROM tv GROUP BY ALL",
    "max": "SELECT doc_id, d, max(CASE WHEN mask = 0 THEN -1e9::DOUBLE ELSE x END) AS x FROM tv GROUP BY ALL",
}


def _pool(kind, width=TOKEN_DIM):
    return (
        lambda spark, d: long_form(N.pool_tokens(token_vectors(spark, d), kind, width=width), "doc_id"),
        _long_sql(f"{SQL_TOKENS}, p AS ({_POOL_SQL[kind]}), {sql_layer_norm('n', 'p', 'doc_id')}", "n", "doc_id"),
    )


def user_model(spark, d):
    """A stand-in for a user's encoder: batches of texts in, [characters, words] out."""

    def build():
        def predict(texts: np.ndarray) -> np.ndarray:
            return np.array([[len(t), len(t.split())] for t in texts.astype(str)], dtype="f8")

        return predict

    model = N.embed_batch(build, batch_size=32)
    return long_form(table(spark, d, "benchmark").select("item_id", model(F.col("text")).alias("vec")), "item_id")


def _fused(fn):
    return lambda spark, d: long_form(
        aligned_pairs(spark, d).select("id", fn(F.col("query"), F.col("code")).alias("vec")), "id"
    )


_AB = f"""{SQL_PAIRS}, ab AS (SELECT id, list_concat(query, code) AS v, query, code FROM pairs),
{sql_long('x2', 'ab', 'id', 'v')}, {sql_long('xa', 'ab', 'id', 'query')}, {sql_long('xb', 'ab', 'id', 'code')}"""
SQL_FUSE_CONCAT = _long_sql(
    f"{_AB}, {sql_linear('y', 'x2', 'id', OUT, activation='relu')}, {sql_layer_norm('z', 'y', 'id')}", "z", "id"
)
SQL_FUSE_GATED = _long_sql(
    f"""{_AB},
g AS (SELECT id, 1 / (1 + exp(-sum(x * {sql_w('0', 'd', 2)}))) AS g FROM x2 GROUP BY id),
m AS (SELECT xa.id, xa.d, g * xa.x + (1 - g) * xb.x AS x FROM xa JOIN xb USING (id, d) JOIN g USING (id)),
{sql_linear('y', 'm', 'id', OUT)}, {sql_layer_norm('z', 'y', 'id')}""",
    "z",
    "id",
)
SQL_FUSE_ATTENTION = _long_sql(
    f"""{_AB},
s AS (
  SELECT a.id, a.d // {D // HEADS} AS h, sum(a.x * a.x) / sqrt({D // HEADS}::DOUBLE) AS aa,
         sum(a.x * b.x) / sqrt({D // HEADS}::DOUBLE) AS ab, sum(b.x * b.x) / sqrt({D // HEADS}::DOUBLE) AS bb
  FROM xa a JOIN xb b USING (id, d) GROUP BY ALL),
p AS (SELECT id, h, 1 / (1 + exp(ab - aa)) AS pa, 1 / (1 + exp(bb - ab)) AS pb FROM s),
m AS (
  SELECT a.id, a.d, (pa * a.x + (1 - pa) * b.x + pb * a.x + (1 - pb) * b.x) / 2 AS x
  FROM xa a JOIN xb b USING (id, d) JOIN p ON p.id = a.id AND p.h = a.d // {D // HEADS}),
{sql_linear('y', 'm', 'id', OUT)}, {sql_layer_norm('z', 'y', 'id')}""",
    "z",
    "id",
)

QUERIES = {
    "l2_normalize": (_each(V.l2_normalize), _long_sql(f"{SQL_UNIT}, {sql_long('x', 'u', 'vec_id', 'v')}", "x")),
    "vector_products": (_pairwise, SQL_PAIRWISE),
    "layer_norm": (_each(V.layer_norm), _long_sql(f"{_E_LONG}, {sql_layer_norm('n', 'x', 'vec_id')}", "n")),
    "linear_relu": (
        _each(lambda v: linear(v, weight(OUT, D), activation="relu")),
        _long_sql(f"{_E_LONG}, {sql_linear('y', 'x', 'vec_id', OUT, activation='relu')}", "y"),
    ),
    "linear_join": (
        lambda spark, d: long_form(linear_join(vectors(spark, d), "vec_id", "vec", _weight_table(spark), "vec"), "vec_id"),
        _long_sql(f"{_E_LONG}, {sql_linear('y', 'x', 'vec_id', OUT)}", "y"),
    ),
    "embedding_dim": (
        dimension,
        f"WITH {sql_long('x', 'embeddings', 'vec_id, len(embedding)::BIGINT AS dimension', 'embedding::DOUBLE[]')} SELECT vec_id, dimension, d AS dim, {sql_r6('x')} AS value FROM x",
    ),
    "pool_tokens_cls": _pool("cls"),
    "pool_tokens_mean": _pool("mean"),
    "pool_tokens_max": _pool("max"),
    "pool_tokens_mean_wide": _pool("mean", None),
    "pool_tokens_max_wide": _pool("max", None),
    "embed_batch": (
        user_model,
        "SELECT item_id, d AS dim, (CASE d WHEN 0 THEN length(text) "
        r"ELSE len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) END)::DOUBLE AS value "
        "FROM benchmark, range(2) r(d)",
    ),
    "batch_standardize": (
        lambda spark, d: long_form(batch_standardize(vectors(spark, d), "vec"), "vec_id"),
        f"WITH {_E_LONG}, n AS (SELECT vec_id, d, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5::DOUBLE) AS x "
        f"FROM x WINDOW w AS (PARTITION BY d)) SELECT vec_id, d AS dim, {sql_r6('x')} AS value FROM n",
    ),
    "fuse_concat": (_fused(lambda a, b: N.fuse("concat", a, b, weight=weight(OUT, 2 * D))), SQL_FUSE_CONCAT),
    "fuse_attention": (
        _fused(lambda a, b: N.fuse("attention", a, b, weight=weight(OUT, D), heads=HEADS)),
        SQL_FUSE_ATTENTION,
    ),
    "fuse_gated": (
        _fused(lambda a, b: N.fuse("gated", a, b, gate=weight(1, 2 * D, 2), weight=weight(OUT, D))),
        SQL_FUSE_GATED,
    ),
}
