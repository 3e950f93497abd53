"""Record and text queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as X
from corvane.operators import records as R
from corvane.operators.tokens import embed_text, encode_tokens, token_vocab
from corvane.plans.catalog.fixtures import (
    SQL_CODE,
    SQL_RAW_CODE,
    code_records,
    long_form,
    raw_code,
    sql_embed,
    sql_r6,
    sql_words,
    table,
)

LENGTH, DIM = 512, 64


def _lit(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _rr(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {_lit(pattern)}, {_lit(replacement)}, 'g')"


def sql_remove_comments(code: str = "code", language: str = "language") -> str:
    python = _rr(_rr(_rr(code, "(?m)#.*?$", ""), '(?s)""".*?"""', ""), "(?s)'''.*?'''", "")
    c_style = _rr(_rr(code, "(?m)//.*?$", ""), r"(?s)/\*.*?\*/", "")
    return f"CASE WHEN {language} = 'python' THEN {python} WHEN {language} IN ('javascript', 'java') THEN {c_style} ELSE {code} END"


def sql_strip(text: str) -> str:
    return _rr(text, rf"\A{X.SPACE}+|{X.SPACE}+\z", "")


def sql_whitespace(code: str = "code") -> str:
    return sql_strip(_rr(_rr(code, "[ \t]+", " "), rf"\n{X.SPACE}*\n", "\n\n"))


def sql_strings(code: str = "code") -> str:
    return _rr(_rr(code, '"[^"]*"', '"STRING"'), "'[^']*'", "'STRING'")


def sql_numbers(code: str = "code") -> str:
    return _rr(code, r"\b\d+\.?\d*\b", "NUM")


def _on_code(fn):
    return lambda spark, d: code_records(spark, d).select("doc_id", fn(F.col("code"), F.col("language")).alias("code"))


def _code_sql(expr: str) -> str:
    return f"WITH {SQL_CODE} SELECT doc_id, {expr} AS code FROM code_fixture"


def _pages(spark, d):
    return table(spark, d, "pages").select("page_id", F.col("html").alias("code"), F.lit("javascript").alias("language"))


SQL_PAGES = "p AS (SELECT page_id, html AS code, 'javascript' AS language FROM pages)"


def fill_defaults(spark, d):
    return code_records(spark, d).select("doc_id", "code", "docstring", "language", "func_name")


def language_guard(spark, d):
    docs = table(spark, d, "documents").withColumnsRenamed({"text": "code", "lang": "language"})
    return docs.select(
        "doc_id",
        X.remove_comments(F.col("code"), F.col("language")).alias("code"),
        X.function_signature(F.col("code"), F.col("language")).alias("signature"),
        X.language_guard(F.col("language")).alias("supported"),
    )


def requests(spark, d, rejected=False):
    """Requests from the benchmark texts: some without a query, some with a bad or missing top_k."""
    rows = table(spark, d, "benchmark").selectExpr(
        "item_id AS query_id",
        "CASE WHEN item_id % 9 = 4 THEN NULL ELSE text END AS query",
        "CAST(CASE WHEN item_id % 5 = 0 THEN NULL ELSE (item_id % 11) * 12 END AS INT) AS top_k",
    )
    return R.validate_requests(rows)[1 if rejected else 0]


_SQL_REQUESTS = """r AS (
  SELECT item_id AS query_id, CASE WHEN item_id % 9 = 4 THEN NULL ELSE text END AS query,
         CASE WHEN item_id % 5 = 0 THEN NULL ELSE (item_id % 11) * 12 END AS top_k FROM benchmark)"""


def node_texts(spark, d):
    return table(spark, d, "documents").select("doc_id", X.node_text(F.col("text")).alias("text"))


def vocabulary(spark, d):
    return token_vocab(table(spark, d, "documents"))


SQL_VOCAB = f"""{sql_words('t', 'documents', 'doc_id', 'text')},
vocab AS (
  SELECT w AS token, row_number() OVER (ORDER BY n DESC, w) + 1 AS token_id, n
  FROM (SELECT w, count(*) AS n FROM t GROUP BY w ))"""


def token_ids(spark, d, **how):
    docs = table(spark, d, "documents")
    rows = encode_tokens(docs, token_vocab(docs), LENGTH, **how)

    def joined(c):
        return F.array_join(F.transform(c, lambda v: v.cast("string")), ",")

    return rows.select("doc_id", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


SQL_TOKEN_IDS = f"""WITH {SQL_VOCAB},
lists AS (
  SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z0-9_]+'), lambda w: w <> '')[1:{LENGTH}] AS ws FROM documents),
flat AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM lists),
ids AS (
  SELECT doc_id, list(coalesce(token_id, 1) ORDER BY pos) AS ids FROM flat LEFT JOIN vocab ON w = token GROUP BY doc_id),
full_ids AS (SELECT l.doc_id, coalesce(ids, []) AS ids, len(l.ws) AS n FROM lists l LEFT JOIN ids USING (doc_id))
SELECT doc_id,
  array_to_string(list_concat(ids, list_transform(range({LENGTH} - n), lambda z: 0::BIGINT)), ',') AS input_ids,
  array_to_string(list_concat(list_transform(range(n), lambda z: 1), list_transform(range({LENGTH} - n), lambda z: 0)), ',')
    AS attention_mask
FROM full_ids"""


def text_embedding(spark, d):
    docs = table(spark, d, "documents")
    return long_form(docs.select("doc_id", embed_text(F.col("text"), DIM).alias("vec")), "doc_id")


_SIGNATURE_SQL = (
    "CASE language "
    + " ".join(f"WHEN '{k}' THEN regexp_extract(code, {_lit(v.replace('(?U)', ''))}, 0)" for k, v in X.SIGNATURE_PATTERNS.items())
    + " ELSE '' END"
)

QUERIES = {
    "fill_record_defaults": (
        fill_defaults,
        f"WITH {SQL_CODE} SELECT doc_id, code, docstring, language, func_name FROM code_fixture",
    ),
    "language_guard": (
        language_guard,
        "SELECT doc_id, text AS code, '' AS signature, false AS supported FROM documents",
    ),
    "validate_requests": (
        requests,
        f"WITH {_SQL_REQUESTS} SELECT query_id, query, coalesce(top_k, 10)::INT AS top_k FROM r "
        "WHERE query IS NOT NULL AND coalesce(top_k, 10) BETWEEN 1 AND 100",
    ),
    "rejected_requests": (
        lambda spark, d: requests(spark, d, rejected=True),
        f"WITH {_SQL_REQUESTS} SELECT query_id, query, coalesce(top_k, 10)::INT AS top_k, "
        "CASE WHEN query IS NULL THEN 'query missing' ELSE 'top_k out of range' END AS reason FROM r "
        "WHERE query IS NULL OR coalesce(top_k, 10) NOT BETWEEN 1 AND 100",
    ),
    "remove_comments": (_on_code(X.remove_comments), _code_sql(sql_remove_comments())),
    "remove_comments_pages": (
        lambda spark, d: _pages(spark, d).select("page_id", X.remove_comments(F.col("code"), F.col("language")).alias("code")),
        f"WITH {SQL_PAGES} SELECT page_id, {sql_remove_comments()} AS code FROM p",
    ),
    "normalize_whitespace": (_on_code(lambda c, _: X.normalize_whitespace(c)), _code_sql(sql_whitespace())),
    "normalize_whitespace_documents": (
        lambda spark, d: table(spark, d, "documents").select("doc_id", X.normalize_whitespace(F.col("text")).alias("text")),
        f"SELECT doc_id, {sql_whitespace('text')} AS text FROM documents",
    ),
    "remove_empty_lines": (
        _on_code(lambda c, _: X.remove_empty_lines(c)),
        _code_sql(f"array_to_string(list_filter(string_split(code, chr(10)), lambda l: regexp_matches(l, {_lit(X.NON_SPACE)})), chr(10))"),
    ),
    "normalize_strings": (_on_code(lambda c, _: X.normalize_strings(c)), _code_sql(sql_strings())),
    "normalize_numbers": (_on_code(lambda c, _: X.normalize_numbers(c)), _code_sql(sql_numbers())),
    "preprocess": (_on_code(X.preprocess), _code_sql(sql_whitespace(sql_remove_comments()))),
    "preprocess_all_steps": (
        _on_code(lambda c, lang: X.preprocess(c, lang, strings=True, numbers=True)),
        _code_sql(sql_numbers(sql_strings(sql_whitespace(sql_remove_comments())))),
    ),
    "preprocess_pages": (
        lambda spark, d: _pages(spark, d).select("page_id", X.preprocess(F.col("code"), F.col("language")).alias("code")),
        f"WITH {SQL_PAGES} SELECT page_id, {sql_whitespace(sql_remove_comments())} AS code FROM p",
    ),
    "extract_function_signature": (_on_code(X.function_signature), _code_sql(_SIGNATURE_SQL)),
    "node_text": (node_texts, "SELECT doc_id, substr(text, 1, 100) AS text FROM documents"),
    "token_vocab": (vocabulary, f"WITH {SQL_VOCAB} SELECT token, token_id, n FROM vocab"),
    "encode_tokens": (token_ids, SQL_TOKEN_IDS),
    "encode_tokens_join": (lambda spark, d: token_ids(spark, d, shipped=100), SQL_TOKEN_IDS),
    "embed_text": (
        text_embedding,
        f"WITH {sql_embed('x', 'documents', 'doc_id', 'text', DIM)} SELECT doc_id, d AS dim, {sql_r6('x')} AS value FROM x",
    ),
}
