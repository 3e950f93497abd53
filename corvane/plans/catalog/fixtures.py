"""Inputs the registered queries derive from the given tables, on Spark and as SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from corvane.functions.vectors import doubles
from corvane.runtime import shuffled, spread_small


# Tables whose rows are parsed, split or hashed.
TEXT_TABLES = ("documents", "pages", "part")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_small(df) if name in TEXT_TABLES else df


def r6(x: Column) -> Column:
    return F.round(x, 6)


def sql_r6(x: str) -> str:
    """Rounded, with minus zero turned into zero."""
    return f"(round({x}, 6) + 0.0::DOUBLE)"


def long_form(df: DataFrame, key: str | list[str], vec: str = "vec") -> DataFrame:
    """Vectors as rows (key, dim, value), rounded."""
    keys = [key] if isinstance(key, str) else key
    flat = df.select(*keys, F.posexplode_outer(vec).alias("dim", "value"))
    return flat.select(*keys, F.col("dim").cast("bigint").alias("dim"), r6(F.col("value")).alias("value"))


# --- code records, templated from part ---------------------------------------------------------

_NL, _Q, _TAB = "chr(10)", "chr(39)", "chr(9)"


def _lines(*lines: str) -> str:
    """SQL text of lines; ``{x}`` splices an SQL expression, ``~`` stands for a single quote."""
    parts = []
    for line in lines:
        for i, piece in enumerate(line.replace("}", "{").split("{")):
            if i % 2:
                parts.append(f"CAST({piece} AS VARCHAR(20))" if piece.startswith("p_") else piece)
            else:
                for j, text in enumerate(piece.split("~")):
                    if j:
                        parts.append(_Q)
                    if text:
                        parts.append(f"'{text}'")
        parts.append(_NL)
    return "concat(" + ", ".join(parts[:-1]) + ")"


_OPEN, _CLOSE = "chr(123)", "chr(125)"
_LONG = "repeat(concat('    size = size + 1', chr(10)), CASE WHEN p_partkey % 500 = 9 THEN 520 ELSE p_size % 5 END)"

_PYTHON = _lines(
    "# build {p_name} no {p_partkey}",
    "def make_{p_partkey}(size, price):",
    '    """About {p_name}.',
    "",
    '    second line"""',
    "{" + _LONG + "}    total = size * {p_size} + {p_partkey}.25",
    "    if total > 10.5:",
    "        for i in range(3):",
    "            total += i  # add",
    "",
    "{" + _TAB + "} ",
    '        label = "{p_brand} text"',
    "    elif size == 0:",
    "        return ~none~",
    "    return total",
)
_JAVASCRIPT = _lines(
    "// {p_name}",
    "function make{p_partkey}(size) {" + _OPEN + "}",
    "    /* block",
    "       comment */",
    '    const url = "http://x.example/{p_partkey}";',
    "{" + _LONG + "}    if (size > {p_size}) {" + _OPEN + "}",
    "        return ~big~;",
    "    {" + _CLOSE + "}",
    "",
    "",
    "    for (let i = 0; i < 3; i++) {" + _OPEN + "}",
    "        size += i;",
    "    {" + _CLOSE + "}",
    "    return size;",
    "{" + _CLOSE + "}",
)
_JAVA = _lines(
    "public class Part{p_partkey} {" + _OPEN + "}",
    "    // {p_name}",
    "    public static int price(int[] a) {" + _OPEN + "}",
    "        int n = {p_size};",
    "        while (n > 0) {" + _OPEN + "}",
    "            n = n - 1;",
    "        {" + _CLOSE + "}",
    "{" + _LONG + "}{" + _TAB + "}return n * 2.5;",
    "    {" + _CLOSE + "}",
    "{" + _CLOSE + "}",
)

# Plain SQL that both engines read alike.
CODE_COLUMNS = {
    "doc_id": "p_partkey",
    "code": f"CASE p_partkey % 3 WHEN 0 THEN {_PYTHON} WHEN 1 THEN {_JAVASCRIPT} ELSE {_JAVA} END",
    "docstring": "CASE WHEN p_partkey % 7 = 3 THEN NULL ELSE concat('Compute ', p_name, ' of ', p_type) END",
    "language": "CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_partkey % 10 = 0 THEN NULL ELSE 'python' END "
    "WHEN 1 THEN 'javascript' ELSE 'java' END",
    "func_name": "CASE p_partkey % 3 WHEN 0 THEN concat('make_', CAST(p_partkey AS VARCHAR(20))) "
    "WHEN 1 THEN concat('make', CAST(p_partkey AS VARCHAR(20))) ELSE 'price' END",
}
_CODE_SELECT = ", ".join(f"{v} AS {k}" for k, v in CODE_COLUMNS.items())
SQL_RAW_CODE = f"raw_code AS (SELECT {_CODE_SELECT} FROM part)"
SQL_CODE = f"""{SQL_RAW_CODE},
code_fixture AS (
  SELECT doc_id, code, coalesce(docstring, '') AS docstring, coalesce(language, 'python') AS language, func_name
  FROM raw_code)"""


def raw_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").selectExpr(*[f"{v} AS {k}" for k, v in CODE_COLUMNS.items()])


def code_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corvane.operators.records import fill_record_defaults

    return fill_record_defaults(raw_code(spark, sf_dir))


# --- vectors -----------------------------------------------------------------------------------

SQL_E = "e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
SQL_UNIT = f"""{SQL_E},
u AS (SELECT vec_id, label,
        list_transform(v, lambda x: x / (CASE WHEN n = 0 THEN 1 ELSE n END)) AS v
      FROM (SELECT *, sqrt(list_inner_product(v, v)) AS n FROM e))"""
# Aligned pairs: code vector e[i], query vector e[i] + 0.8 * e[(i + 1) mod n].
SQL_PAIRS = f"""{SQL_E},
pairs AS (
  SELECT a.vec_id AS id, a.label, a.vec_id // 32 AS batch_id, a.v AS code,
         list_transform(list_zip(a.v, b.v), lambda z: z[1] + 0.8::DOUBLE * z[2]) AS query
  FROM e a JOIN e b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM e))"""


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", doubles(F.col("embedding")).alias("vec"), "label")


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, batch_id, code, query)."""
    a = vectors(spark, sf_dir)
    n = a.count()
    nxt = a.select(F.pmod(F.col("vec_id") - 1, F.lit(n)).alias("vec_id"), F.col("vec").alias("nxt"))
    return a.join(shuffled(nxt), "vec_id").select(
        F.col("vec_id").alias("id"),
        "label",
        F.expr("vec_id div 32").alias("batch_id"),
        F.col("vec").alias("code"),
        F.zip_with("vec", "nxt", lambda x, y: x + y * 0.8).alias("query"),
    )


# --- weights -----------------------------------------------------------------------------------


def weight(rows: int, cols: int, shift: int = 0) -> np.ndarray:
    i, j = np.indices((rows, cols))
    return ((i * 7 + j * 3 + shift) % 11 - 5) / 11.0


def sql_w(i: str, j: str, shift: int = 0) -> str:
    return f"(CAST((({i}) * 7 + ({j}) * 3 + {shift}) % 11 - 5 AS DOUBLE) / 11)"


def sql_long(name: str, source: str, keys: str, vec: str) -> str:
    """CTE ``name(keys, d, x)`` with one row per vector component."""
    return f"{name} AS (SELECT {keys}, generate_subscripts({vec}, 1) - 1 AS d, unnest({vec}) AS x FROM {source})"


def sql_layer_norm(name: str, source: str, key: str) -> str:
    return f"""{name} AS (
  SELECT {key}, d, (x - avg(x) OVER w) / sqrt(var_pop(x) OVER w + 1e-5::DOUBLE) AS x
  FROM {source} WINDOW w AS (PARTITION BY {key}))"""


def sql_linear(name: str, source: str, keys: str, rows: int, shift: int = 0, activation: str = "") -> str:
    """CTE for ``W x`` over long vectors, weights by formula."""
    value = f"sum(x * {sql_w('i', 'd', shift)})"
    if activation == "relu":
        value = f"greatest({value}, 0::DOUBLE)"
    return f"""{name} AS (
  SELECT {keys}, i AS d, {value} AS x FROM {source}, range({rows}) r(i) GROUP BY {keys}, i)"""


# --- text --------------------------------------------------------------------------------------


def sql_words(name: str, source: str, key: str, text: str) -> str:
    return f"""{name} AS (
  SELECT {key}, w FROM (
    SELECT {key}, unnest(string_split_regex(lower({text}), '[^a-z0-9_]+')) AS w FROM {source}) WHERE w <> '')"""


def sql_embed(name: str, source: str, key: str, text: str, dim: int) -> str:
    """CTEs ending in ``name({key}, d, x)``: dense hashed text embedding in long form."""
    return f"""{sql_words(name + '_w', source, key, text)},
{name}_s AS (
  SELECT {key}, ('0x' || substr(md5(w), 1, 8))::BIGINT % {dim} AS d,
         sum(CASE WHEN substr(md5(w), 9, 1) < '8' THEN 1 ELSE -1 END)::DOUBLE AS x
  FROM {name}_w GROUP BY ALL),
{name} AS (
  SELECT k.{key}, g.d, coalesce(s.x, 0) / coalesce(n.n, 1) AS x
  FROM {source} k CROSS JOIN range({dim}) g(d)
  LEFT JOIN {name}_s s ON s.{key} = k.{key} AND s.d = g.d
  LEFT JOIN (SELECT {key}, nullif(sqrt(sum(x * x)), 0) AS n FROM {name}_s GROUP BY ALL) n ON n.{key} = k.{key})"""
