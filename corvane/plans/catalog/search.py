"""Nearest-neighbour, index-cell and end-to-end search queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.operators import records as R
from corvane.operators import search as S
from corvane.operators.clustering import ivf_train
from corvane.operators.tokens import embed_text
from corvane.plans.catalog.fixtures import (
    SQL_CODE,

    SQL_UNIT,
    code_records,
    long_form,
    sql_embed,
    sql_r6,
    table,
    vectors,
)
from corvane.plans.catalog.text import sql_remove_comments, sql_whitespace
from corvane.plans.retrieval import embed_code, search
from corvane.runtime import scratch_path, shuffled
from corvane.sources.index import IndexConfig, VectorIndex

K, NLIST, NPROBE, ROUNDS, TABLES, BITS, DIM = 10, 20, 4, 2, 4, 6, 64


def _queries(spark, d):
    return vectors(spark, d).select(F.col("vec_id").alias("query_id"), "vec")


def _ranked(df: DataFrame) -> DataFrame:
    return df.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), "score")


def exact(spark, d):
    return _ranked(S.topk_exact(_queries(spark, d), vectors(spark, d), K))


def exact_grid(spark, d):
    """The same search with neither side shipped whole."""
    blocks = {"broadcast_cells": 0, "query_rows": 128, "item_rows": 200}
    return _ranked(S.topk_exact(_queries(spark, d), vectors(spark, d), K, **blocks))


def sql_rank(pairs: str, k: int = K) -> str:
    """Top-k of the CTE ``pairs(query_id, vec_id, s)``; scores tie at nine digits."""
    return f"""SELECT query_id, vec_id, rank, round(s, 9) + 0.0::DOUBLE AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS rank FROM {pairs}) WHERE rank <= {k}"""


_DOT = "list_inner_product(a.v, b.v)"
SQL_EXACT = f"""WITH {SQL_UNIT},
p AS (SELECT a.vec_id AS query_id, b.vec_id, {_DOT} AS s FROM u a CROSS JOIN u b) {sql_rank('p')}"""


def _round_sql(k: int) -> str:
    """One assignment and one update: cells c<k-1> -> c<k>."""
    prev, now = f"c{k - 1}", f"c{k}"
    return f"""a{k} AS (
  SELECT vec_id, cell FROM (
    SELECT u.vec_id, c.cell, row_number() OVER (PARTITION BY u.vec_id ORDER BY round(list_inner_product(u.v, c.v), 9) DESC, c.cell) AS r
    FROM u CROSS JOIN {prev} c) WHERE r = 1),
m{k} AS (SELECT cell, d, sum(x) AS x FROM a{k} JOIN ul USING (vec_id) GROUP BY ALL),
s{k} AS (SELECT cell, list(x ORDER BY d) AS v FROM m{k} GROUP BY cell),
{now} AS (
  SELECT cell, list_transform(v, lambda x: x / n) AS v FROM (
    SELECT p.cell, coalesce(s.v, p.v) AS v, sqrt(list_inner_product(coalesce(s.v, p.v), coalesce(s.v, p.v))) AS n
    FROM {prev} p LEFT JOIN s{k} s ON s.cell = p.cell))"""


SQL_CELLS = f"""{SQL_UNIT},
ul AS (SELECT vec_id, generate_subscripts(v, 1) AS d, unnest(v) AS x FROM u),
c0 AS (SELECT row_number() OVER (ORDER BY md5(vec_id::VARCHAR), vec_id) - 1 AS cell, v
       FROM (SELECT * FROM u ORDER BY md5(vec_id::VARCHAR), vec_id LIMIT {NLIST})),
{', '.join(_round_sql(k + 1) for k in range(ROUNDS))},
cells AS (SELECT cell, v FROM c{ROUNDS}),
{_round_sql(ROUNDS + 1).split('m3 AS')[0].strip().rstrip(',')}"""
SQL_ASSIGNED = f"a{ROUNDS + 1}"


def trained(spark, d):
    return ivf_train(vectors(spark, d), NLIST, ROUNDS)


def centroids(spark, d):
    cells = trained(spark, d)
    rows = [(i, [float(x) for x in row]) for i, row in enumerate(cells)]
    return long_form(spark.createDataFrame(rows, "cell bigint, vec array<double>"), "cell")


def table_cells(spark, d):
    """The same cells, kept in a table as if there were too many to go to every task."""
    cells = ivf_train(vectors(spark, d), NLIST, ROUNDS, most_cells=0)
    return long_form(cells.select(F.col("cell").cast("bigint").alias("cell"), "vec"), "cell")


def kmeans_cells(spark, d):
    """Cells of Spark ML's clustering; sizes depend on its random start."""
    cells = ivf_train(vectors(spark, d), NLIST, 10, method="kmeans", seed=1)
    return S.ivf_assign(vectors(spark, d), cells).groupBy("cell").agg(F.count(F.lit(1)).alias("vectors"))


def _unit_vectors(spark, d):
    from corvane.functions.vectors import l2_normalize

    return vectors(spark, d).select("vec_id", l2_normalize(F.col("vec")).alias("vec"))


def assigned(spark, d):
    rows = S.ivf_assign(_unit_vectors(spark, d), trained(spark, d))
    return rows.select("vec_id", F.col("cell").cast("bigint").alias("cell"))


def probed(spark, d, most_cells=8_000_000, **blocks):
    cells = ivf_train(vectors(spark, d), NLIST, ROUNDS, most_cells=most_cells)
    index = S.ivf_assign(_unit_vectors(spark, d), cells)
    return _ranked(S.ivf_search(_queries(spark, d), index, cells, K, NPROBE, **blocks))


SQL_PROBED = f"""WITH {SQL_CELLS},
probe AS (
  SELECT query_id, cell FROM (
    SELECT u.vec_id AS query_id, c.cell, row_number() OVER (PARTITION BY u.vec_id ORDER BY round(list_inner_product(u.v, c.v), 9) DESC, c.cell) AS r
    FROM u CROSS JOIN cells c) WHERE r <= {NPROBE}),
p AS (SELECT probe.query_id, b.vec_id, {_DOT} AS s
      FROM probe JOIN {SQL_ASSIGNED} x USING (cell) JOIN u a ON a.vec_id = query_id JOIN u b ON b.vec_id = x.vec_id)
{sql_rank('p')}"""


def approximate(spark, d, **blocks):
    return _ranked(S.topk_ann(_queries(spark, d), vectors(spark, d), DIM, K, TABLES, BITS, **blocks))


SQL_ANN = f"""WITH {SQL_UNIT},
ul AS (SELECT vec_id, generate_subscripts(v, 1) - 1 AS d, unnest(v) AS x FROM u),
side AS (
  SELECT vec_id, t, b, round(sum(CASE WHEN substr(md5(t || ':' || b || ':' || d), 1, 1) < '8' THEN x ELSE -x END), 9) >= 0 AS up
  FROM ul, range({TABLES}) r(t), range({BITS}) s(b) GROUP BY vec_id, t, b),
sig AS (SELECT vec_id, t, sum(CASE WHEN up THEN 1 << b ELSE 0 END) AS bucket FROM side GROUP BY vec_id, t),
cand AS (SELECT DISTINCT q.vec_id AS query_id, x.vec_id FROM sig q JOIN sig x USING (t, bucket)),
p AS (SELECT query_id, c.vec_id, {_DOT} AS s FROM cand c JOIN u a ON a.vec_id = query_id JOIN u b ON b.vec_id = c.vec_id)
{sql_rank('p')}"""


def metadata_of_hits(spark, d):
    """Hits of the embedding search with the labels of their vectors; half the ids have no record."""
    records = table(spark, d, "labels").select(F.col("doc_id").alias("vec_id"), "quality")
    hits = S.topk_exact(_queries(spark, d), vectors(spark, d), K)
    return S.attach_metadata(hits, records).select("query_id", "vec_id", "quality")


# --- text search -------------------------------------------------------------------------------


def _text_queries(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), embed_text(F.col("text"), DIM).alias("vec"))


def documents(spark, d):
    """Ten best documents for every benchmark text."""
    docs = table(spark, d, "documents")
    items = docs.select(F.col("doc_id").alias("vec_id"), embed_text(F.col("text"), DIM).alias("vec"))
    hits = S.topk_exact(_text_queries(spark, d), items, K)
    found = S.attach_metadata(hits, docs.select(F.col("doc_id").alias("vec_id"), "lang", "source", "n_chars"))
    return found.select(
        "query_id", F.col("rank").cast("bigint").alias("rank"), "vec_id", "score", "lang", "source", "n_chars"
    )


SQL_DOCUMENTS = f"""WITH {sql_embed('x', 'documents', 'doc_id', 'text', DIM)}, {sql_embed('q', 'benchmark', 'item_id', 'text', DIM)},
p AS (SELECT item_id AS query_id, doc_id AS vec_id, sum(q.x * x.x) AS s FROM q JOIN x USING (d) GROUP BY ALL)
SELECT query_id, rank, vec_id, score, lang, source, n_chars FROM ({sql_rank('p')}) JOIN documents ON doc_id = vec_id"""


def code_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark text as a request, with varying top_k and language."""
    rows = table(spark, sf_dir, "benchmark").selectExpr(
        "item_id AS query_id",
        "concat(text, ' return size price total ', CAST(item_id AS STRING)) AS query",
        "CAST(CASE WHEN item_id % 4 = 0 THEN NULL ELSE item_id % 4 * 5 END AS INT) AS top_k",
        "CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'python' ELSE 'java' END AS language",
    )
    return R.validate_requests(rows)[0]


def code_index(spark, d, index_type="Flat") -> VectorIndex:
    """The code records as a stored index."""
    config = IndexConfig(DIM, index_type, NLIST, NLIST)
    index = VectorIndex.create(
        spark, scratch_path(spark, "index"), config, "code string, docstring string, language string, func_name string"
    )
    records = code_records(spark, d)
    index.add(records.join(shuffled(embed_code(records, DIM)), "doc_id").withColumnsRenamed({"doc_id": "vec_id", "vec": "embedding"}))
    return index


def searched(mode="post", scores=True, index_type="Flat"):
    def query(spark, d):
        out = search(code_requests(spark, d), code_index(spark, d, index_type), scores, mode)
        cols = ["query_id", F.col("rank").cast("bigint").alias("rank"), "language", "func_name", "docstring", F.md5("code").alias("code_md5")]
        return out.select(*cols, *(["score"] if scores else []))

    return query


def sql_searched(mode: str = "post", scores: bool = True) -> str:
    pre = "JOIN req USING (query_id) JOIN code_fixture USING (doc_id) WHERE want IS NULL OR want = language" if mode == "pre" else ""
    post = "AND (want IS NULL OR want = language)" if mode == "post" else ""
    score = ", round(s, 9) + 0.0::DOUBLE AS score" if scores else ""
    return f"""WITH {SQL_CODE},
kept AS (SELECT doc_id, {sql_whitespace(sql_remove_comments())} AS clean FROM code_fixture),
req AS (SELECT item_id AS query_id, concat(text, ' return size price total ', item_id::VARCHAR) AS query,
          CASE WHEN item_id % 4 = 0 THEN 10 ELSE item_id % 4 * 5 END AS top_k,
          CASE item_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'python' ELSE 'java' END AS want FROM benchmark),
{sql_embed('x', 'kept', 'doc_id', 'clean', DIM)}, {sql_embed('q', 'req', 'query_id', 'query', DIM)},
p AS (SELECT query_id, doc_id, sum(q.x * x.x::FLOAT::DOUBLE) AS s FROM q JOIN x USING (d) GROUP BY ALL),
ranked AS (SELECT query_id, doc_id, s, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, doc_id) AS rank FROM p {pre})
SELECT query_id, rank, language, func_name, docstring, md5(code) AS code_md5{score}
FROM ranked JOIN req USING (query_id) JOIN code_fixture USING (doc_id) WHERE rank <= top_k {post}"""


QUERIES = {
    "topk_exact": (exact, SQL_EXACT),
    "topk_exact_grid": (exact_grid, SQL_EXACT),
    "ivf_train": (
        centroids,
        f"WITH {SQL_CELLS} SELECT cell, generate_subscripts(v, 1) - 1 AS dim, unnest(list_transform(v, lambda x: {sql_r6('x')})) AS value FROM cells",
    ),
    "ivf_train_kmeans": (kmeans_cells, None),
    "ivf_train_table": (
        table_cells,
        f"WITH {SQL_CELLS} SELECT cell, generate_subscripts(v, 1) - 1 AS dim, unnest(list_transform(v, lambda x: {sql_r6('x')})) AS value FROM cells",
    ),
    "ivf_search_table": (lambda spark, d: probed(spark, d, most_cells=0), SQL_PROBED),
    "ivf_assign": (assigned, f"WITH {SQL_CELLS} SELECT vec_id, cell FROM {SQL_ASSIGNED}"),
    "ivf_search": (probed, SQL_PROBED),
    "ivf_search_grid": (lambda spark, d: probed(spark, d, broadcast_cells=0, query_rows=16, item_rows=16), SQL_PROBED),
    "topk_ann": (approximate, SQL_ANN),
    "attach_metadata": (
        metadata_of_hits,
        f"SELECT query_id, vec_id, quality FROM ({SQL_EXACT}) LEFT JOIN labels ON doc_id = vec_id",
    ),
    "search_documents": (documents, SQL_DOCUMENTS),
    "search": (searched(), sql_searched()),
    "search_ivf": (searched(index_type="IVF"), sql_searched()),
    "filter_language": (
        lambda spark, d: R.filter_language(documents(spark, d).withColumnRenamed("lang", "language"), "en"),
        f"SELECT * RENAME (lang AS language) FROM ({SQL_DOCUMENTS}) WHERE lang = 'en'",
    ),
    "filter_language_pre": (searched("pre"), sql_searched("pre")),
    "project_results": (searched(scores=False), sql_searched(scores=False)),
}
