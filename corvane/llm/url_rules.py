"""Verdicts on URLs from rules on hosts and paths; DataFrame functions only.

A rule ``(host, path, verdict)`` fits the URLs of its host and of all its subdomains whose path starts with the
rule's.  A URL is not compared with the rules: it is expanded into the expressions (host suffix + path prefix) that a
rule could have, each is hashed, and the first bits of the hash are equi-joined with those of the rules' expressions.
What meets is confirmed on the full digest, and of the rules that fit a URL the one that takes precedence is kept.

Which expressions a rule could have is known from the rules' shapes, a few distinct numbers: how many labels the host has, and
where the path ends (at its n-th slash, or after n characters where it ends elsewhere).  So a URL gives at most one
expression a shape, however long it is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import broadcast_small, is_small, stored
from corvane.runtime import spread_small

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Hex digits of the digest that are joined on; the rest is compared afterwards.
PREFIX_DIGITS = 8
# Parts of a joined key, so that an expression that a third of all URLs have meets its rule in many tasks.
SALTS = 32


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")


def host(url: Column) -> Column:
    """What stands after the first ``://`` up to a slash, question mark, hash or the end, A to Z lower-cased."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), _UPPER, _LOWER), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, up to a question mark, hash or the end."""
    return F.coalesce(F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1), F.lit(""))


def _count(text: Column, char: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, PREFIX_DIGITS)


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules ``host, path, verdict`` with their expression, digest, shape and precedence.

    Hosts are lower-cased (A to Z), a null path is empty; rules without a host or a verdict fit nothing.  Of
    rules with the same host and path a blocking one stands.
    """
    rows = rules.select(
        F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict")
    ).where((F.col("host") != "") & F.col("verdict").isNotNull())
    # "block" comes after "allow": the greatest verdict is the stricter one.
    rows = rows.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    at_slash = F.endswith(F.col("path"), F.lit("/"))
    # No host has a slash, and every path begins where its host ends: the place of the cut tells equal texts apart.
    expression = F.concat_ws(" ", F.length("host"), F.concat("host", "path"))
    return rows.select(
        F.concat("host", "path").alias("rule"),
        "verdict",
        F.length(F.concat("host", "path")).alias("long"),
        F.length("host").alias("host_long"),
        (_count(F.col("host"), ".") + 1).alias("labels"),
        at_slash.alias("at_slash"),
        F.when(at_slash, _count(F.col("path"), "/")).otherwise(F.length("path")).alias("stop"),
        F.sha2(expression, 256).alias("digest"),
    ).withColumn("prefix", _prefix(F.col("digest")))


def expressions(host_col: Column, path_col: Column, shapes: list[tuple[int, bool, int]]) -> Column:
    """The digests of all expressions of a URL that a rule of one of ``shapes`` could have; without any, an empty array."""
    out = []
    for labels, at_slash, stop in shapes:
        suffix = F.substring_index(host_col, ".", -labels)
        cut = F.concat(F.substring_index(path_col, "/", stop), F.lit("/")) if at_slash else F.substring(path_col, 1, stop)
        fits = (_count(host_col, ".") + 1 >= labels) & (host_col != "") & ((_count(path_col, "/") if at_slash else F.length(path_col)) >= stop)
        out.append(F.when(fits, F.sha2(F.concat_ws(" ", F.length(suffix), F.concat(suffix, cut)), 256)))
    return F.array_compact(F.array(*out)) if out else F.array().cast("array<string>")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row of ``pages``: ``page_id, url, host, path, rule, verdict``.

    Of the rules that fit, the longest stands (host and path together, then the longer host); a URL that none
    fits has a null rule and the verdict ``default``.  A null URL, or one without ``://``, has an empty host and path and is
    fitted by nothing.  Rows that repeat an id or a URL are judged each; without rules every verdict is ``default``.
    """
    known = stored(rule_table(rules), "rules")
    shapes = sorted(tuple(r) for r in known.select("labels", "at_slash", "stop").distinct().collect())  # distinct small numbers
    url = F.col(url_col).cast("string")
    rows = spread_small(pages.select(F.col(id_col).cast("bigint").alias("page_id"), url.alias("url")))
    rows = rows.select("page_id", "url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row"))
    asked = rows.select("*", F.explode_outer(expressions(F.col("host"), F.col("path"), shapes)).alias("asked"))
    asked = asked.withColumn("prefix", _prefix(F.col("asked")))
    answers = known.select("prefix", "digest", F.struct("long", "host_long", "rule", "verdict").alias("fit"))
    if is_small(answers):
        met = asked.join(F.broadcast(answers), "prefix", "left")
    else:
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
        met = asked.withColumn("salt", (F.col("row") % SALTS).cast("int")).join(answers.withColumn("salt", salts), ["prefix", "salt"], "left")
    # The digest decides; one of the row's expressions that met nothing keeps the row.
    best = F.max(F.when(F.col("asked") == F.col("digest"), F.col("fit")))
    judged = met.groupBy("row", "page_id", "url", "host", "path").agg(best.alias("fit"))
    return judged.select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.coalesce(F.col("fit.verdict"), F.lit(default)).alias("verdict"))


def keep_allowed(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages``, with their columns, whose URL is not blocked.

    The distinct URLs are judged; those to drop are usually few, so that the pages themselves need not be shuffled.
    """
    urls = pages.select(F.col(url_col).cast("string").alias("url")).distinct().withColumn("page_id", F.lit(None).cast("bigint"))
    blocked = stored(judge(urls, rules, default=default).where(F.col("verdict") == "block").select(F.col("url").alias("_blocked")), "blocked")
    return pages.join(broadcast_small(blocked), F.col(url_col).cast("string").eqNullSafe(F.col("_blocked")), "left_anti")
