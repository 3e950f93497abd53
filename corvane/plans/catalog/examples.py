"""Training examples, triplets of them, and validation over encoded pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from corvane.functions.text import preprocess
from corvane.operators import evaluation as E
from corvane.operators.losses import rolled_negatives, triplet_terms
from corvane.operators.tokens import embed_text, token_vocab
from corvane.plans.catalog.evaluation import _rounded, sql_tall
from corvane.plans.catalog.fixtures import code_records, sql_embed, sql_r6, sql_words
from corvane.plans.catalog.graphs import _SQL_Z, DIM, FUSED, SQL_CODE_GRAPH, fitted_encoder
from corvane.plans.catalog.learning import SEED, sql_random
from corvane.plans.catalog.text import sql_remove_comments, sql_whitespace
from corvane.plans.encoder import first_seen_types
from corvane.plans.examples import joined_text, training_examples, triplet_examples
from corvane.runtime import checkpoint, shuffled

LENGTH, BATCH = 24, 32


def examples(spark, d, **how) -> DataFrame:
    records = code_records(spark, d)
    both = F.concat_ws(" ", preprocess(F.col("code"), F.col("language")), "docstring")
    vocab = checkpoint(token_vocab(records.select("doc_id", both.alias("text"))))
    types = [r["type"] for r in first_seen_types(records).orderBy("type_id").collect()]  # kinds of lines
    return training_examples(records, vocab, types, LENGTH, **how)


def _shown(example: str = "") -> list:
    """The columns of an example as texts."""
    c = lambda name: F.col(f"{example}.{name}" if example else name)
    edges = F.array_sort(F.zip_with(c("graph.src"), c("graph.dst"), lambda a, b: a * 1000 + b))
    texts = [joined_text(c(n)).alias(n) for n in ("code_input_ids", "code_attention_mask", "query_input_ids", "query_attention_mask")]
    return [*texts, joined_text(c("graph.features")).alias("features"), joined_text(edges).alias("edges")]


def flat_examples(**how):
    return lambda spark, d: examples(spark, d, **how).select("doc_id", "language", *_shown())


def _sql_ids(name: str, source: str, text: str) -> str:
    return f"""{name}_l AS (SELECT doc_id, list_filter(string_split_regex(lower({text}), '[^a-z0-9_]+'), lambda w: w <> '')[1:{LENGTH}] AS ws FROM {source}),
{name}_f AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM {name}_l),
{name}_i AS (SELECT doc_id, list(coalesce(token_id, 1) ORDER BY pos) AS ids FROM {name}_f LEFT JOIN words ON w = token GROUP BY doc_id),
{name} AS (
  SELECT l.doc_id, array_to_string(list_concat(coalesce(ids, []), list_transform(range({LENGTH} - len(ws)), lambda z: 0::BIGINT)), ',') AS ids,
         array_to_string(list_concat(list_transform(range(len(ws)), lambda z: 1), list_transform(range({LENGTH} - len(ws)), lambda z: 0)), ',') AS mask
  FROM {name}_l l LEFT JOIN {name}_i i USING (doc_id))"""


SQL_EXAMPLES = f"""{SQL_CODE_GRAPH},
texts AS (SELECT doc_id, language, {sql_whitespace(sql_remove_comments())} AS clean, docstring FROM code_fixture),
both_texts AS (SELECT doc_id, clean || ' ' || docstring AS text FROM texts),
{sql_words('tok', 'both_texts', 'doc_id', 'text')},
words AS (SELECT w AS token, row_number() OVER (ORDER BY n DESC, w) + 1 AS token_id FROM (SELECT w, count(*) AS n FROM tok GROUP BY w)),
{_sql_ids('cd', 'texts', 'clean')}, {_sql_ids('qd', 'texts', 'docstring')},
nf AS (SELECT doc_id, string_agg(array_to_string(list_transform(x, lambda v: v::BIGINT), ','), ',' ORDER BY id) AS features FROM feat GROUP BY doc_id),
ef AS (SELECT doc_id, string_agg((src * 1000 + dst)::VARCHAR, ',' ORDER BY src * 1000 + dst) AS edges FROM edges GROUP BY doc_id),
ex AS (
  SELECT t.doc_id, language, cd.ids AS code_input_ids, cd.mask AS code_attention_mask, qd.ids AS query_input_ids, qd.mask AS query_attention_mask,
         features, coalesce(edges, '') AS edges
  FROM texts t JOIN cd USING (doc_id) JOIN qd USING (doc_id) JOIN nf USING (doc_id) LEFT JOIN ef USING (doc_id))"""


def triplets(spark, d) -> DataFrame:
    rows = triplet_examples(checkpoint(examples(spark, d)), SEED)
    return rows.select("doc_id", F.col("positive.doc_id").alias("positive_id"), F.col("negative.doc_id").alias("negative_id"), *[c.alias(f"anchor_{n}") for c, n in zip(_shown("anchor"), _TEXTS)], *[c.alias(f"negative_{n}") for c, n in zip(_shown("negative"), _TEXTS)])


_TEXTS = ("code_input_ids", "code_attention_mask", "query_input_ids", "query_attention_mask", "features", "edges")


def encoded_report(spark, d) -> DataFrame:
    """Docstrings against encoded code: loss with rolled negatives, and all rank metrics."""
    rows = checkpoint(fitted_encoder(spark, d).encode(code_records(spark, d).select("doc_id", "code", "language", "docstring")))
    rows = rows.select("doc_id", F.col("vec").alias("code"), embed_text(F.col("docstring"), DIM).alias("query"))
    rolled = rolled_negatives(rows.select(F.expr(f"doc_id div {BATCH}").alias("batch_id"), F.col("doc_id").alias("id")))
    side = rolled.join(shuffled(rows.withColumnRenamed("doc_id", "id")), "id").join(shuffled(rows.select(F.col("doc_id").alias("negative_id"), F.col("code").alias("negative"))), "negative_id")
    losses = triplet_terms(side.select("batch_id", F.col("query").alias("anchor"), F.col("code").alias("positive"), "negative"))
    ranks = E.rank_of_match(rows.select(F.col("doc_id").alias("query_id"), F.col("query").alias("vec")), rows.select(F.col("doc_id").alias("vec_id"), F.col("code").alias("vec")))
    return _rounded(E.validation_report(losses, ranks))


SQL_ENCODED_REPORT = f"""{_SQL_Z},
doc_texts AS (SELECT doc_id, docstring FROM code_fixture),
{sql_embed('qv', 'doc_texts', 'doc_id', 'docstring', DIM)},
cv AS (SELECT doc_id, list(x ORDER BY d) AS code FROM z WHERE doc_id >= 0 GROUP BY doc_id),
qs AS (SELECT doc_id, list(x ORDER BY d) AS query FROM qv GROUP BY doc_id),
prs AS (SELECT doc_id AS id, doc_id // {BATCH} AS batch_id, query, code FROM cv JOIN qs USING (doc_id)),
sims AS (
  SELECT a.id AS query_id, b.id AS vec_id,
         round(list_inner_product(a.query, b.code) / coalesce(nullif(sqrt(list_inner_product(a.query, a.query) * list_inner_product(b.code, b.code)), 0), 1), 9) AS s
  FROM prs a CROSS JOIN prs b),
rk AS (SELECT query_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM sims) WHERE query_id = vec_id),
rolled AS (
  SELECT batch_id, id, coalesce(lag(id) OVER (PARTITION BY batch_id ORDER BY id),
         last_value(id) OVER (PARTITION BY batch_id ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS negative_id FROM prs),
gap AS (
  SELECT r.batch_id, greatest(list_distance(a.query, list_transform(a.code, lambda v: v - 1e-6::DOUBLE)) - list_distance(a.query, list_transform(n.code, lambda v: v - 1e-6::DOUBLE)) + 0.5::DOUBLE, 0) AS l
  FROM rolled r JOIN prs a ON a.id = r.id JOIN prs n ON n.id = r.negative_id),
b AS (SELECT batch_id, avg(l) AS m FROM gap GROUP BY batch_id)
SELECT 'loss' AS metric, {sql_r6('avg(m)')} AS value FROM b UNION ALL {sql_tall('rk')}"""

assert FUSED == DIM  # text queries are searched among fused vectors

QUERIES = {
    "training_examples": (flat_examples(), f"WITH {SQL_EXAMPLES} SELECT * FROM ex"),
    "training_examples_join": (flat_examples(shipped=10), f"WITH {SQL_EXAMPLES} SELECT * FROM ex"),
    "triplet_examples": (
        triplets,
        f"WITH {SQL_EXAMPLES}, {sql_random('tr', 1, SEED, 'ex', 'doc_id')} SELECT a.doc_id, a.doc_id AS positive_id, n.doc_id AS negative_id, "
        + ", ".join(f"a.{c} AS anchor_{c}, n.{c} AS negative_{c}" for c in _TEXTS)
        + " FROM tr JOIN ex a ON a.doc_id = tr.anchor_id JOIN ex n ON n.doc_id = tr.negative_id",
    ),
    "validation_report_encoded": (encoded_report, SQL_ENCODED_REPORT),
}
