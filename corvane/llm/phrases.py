"""Benchmark decontamination over a stored positional inverted index; DataFrame functions only.

``build_index`` writes postings (term, document, position) as segments: every part covers its own documents and deals its
postings by a hash of the term into buckets, which are folders.  Nothing is shuffled, and the postings of
a frequent term lie in as many files as there are parts.  How often each term occurs is kept beside them.  A
look-up reads the buckets of the terms asked for.  A phrase is looked up from its rarest terms on: the list of the
rarest, shifted by the term's offset, gives possible starts; the shifted list of the second rarest is intersected with
them; what is left is small, and asks for the other terms at fixed places of few documents.  With ``slop`` a term may
stand that many places beside its own.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from corvane.llm.common import broadcast_small, stored
from corvane.runtime import scratch_path, spread_small

# What a word is, after lower-casing A to Z.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NO_ID = -(1 << 62)
# Folders of the postings by hash of the term; each part of the documents has a file in every one, all open at a time.
BUCKETS = 16
_DOCUMENTS = -1  # the folder of the documents themselves
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"
# Bytes that each open file may hold back: small, since a task has one for every bucket.
_BUFFERS = {"parquet.block.size": 4 << 20, "parquet.page.size": 128 << 10, "parquet.dictionary.page.size": 256 << 10}


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), F.lit(WORD), F.lit(0))


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


@dataclass
class Index:
    """``postings`` (bucket, term, doc, pos), ``counts`` (term, count), ``documents`` (doc, id, n_words)."""

    postings: DataFrame
    counts: DataFrame
    documents: DataFrame

    def of(self, terms: DataFrame) -> DataFrame:
        """The buckets of the postings that hold the ``term`` of ``terms``; others are not read."""
        wanted = [r["b"] for r in terms.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # at most BUCKETS
        return self.postings.where(F.col("bucket").isin(wanted)).drop("bucket")


def _write_buckets(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """``rows`` into a folder for each ``bucket``, with a writer open for each."""
    before = spark.conf.get(_WRITERS, None)
    spark.conf.set(_WRITERS, str(BUCKETS + 1))
    try:
        writer = rows.write.partitionBy("bucket")
        for name, size in _BUFFERS.items():
            writer = writer.option(name, size)
        writer.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_WRITERS)
        else:
            spark.conf.set(_WRITERS, before)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> Index:
    """The index of ``docs``.

    ``doc`` is ``row`` (a bigint); by default it is the id, and documents without one get negative numbers.  Ids that
    repeat need a ``row``, so that their documents stay apart.
    """
    spark = docs.sparkSession
    key = F.col(id_col).cast("bigint")
    doc = F.coalesce(key, F.lit(_NO_ID) + F.monotonically_increasing_id()) if row is None else row
    rows = spread_small(docs.select(doc.alias("doc"), key.alias("id"), F.col(text_col).alias("text")))
    # The empty term stands for the document and holds its length.
    rows = rows.select("doc", "id", F.concat(words(F.col("text")), F.array(F.lit(""))).alias("words"))
    rows = rows.select("doc", "id", F.posexplode_outer("words").alias("pos", "term"))
    is_doc = F.col("term") == ""
    path = scratch_path(spark, "postings")
    _write_buckets(spark, rows.select("doc", F.when(is_doc, F.col("id")).alias("id"), "pos", "term", F.when(is_doc, F.lit(_DOCUMENTS)).otherwise(_bucket(F.col("term"))).alias("bucket")), path)
    index = spark.read.schema("doc bigint, id bigint, pos int, term string, bucket int").parquet(path)
    postings = index.where(F.col("bucket") != _DOCUMENTS).drop("id")
    counts = stored(postings.groupBy("term").agg(F.count(F.lit(1)).alias("count")), "counts")
    return Index(postings, counts, index.where(F.col("bucket") == _DOCUMENTS).select("doc", "id", F.col("pos").cast("bigint").alias("n_words")))


def phrases(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``phrase, words``, and ``phrase, item_id`` of the items they come from.

    Items without words have no window.
    """
    rows = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("all")).where(F.size("all") > 0)
    last = F.greatest(F.size("all") - WINDOW, F.lit(0))
    cut = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(F.col("all"), i + 1, WINDOW))
    cut = rows.select("item_id", F.explode_outer(cut).alias("words")).withColumn("phrase", F.concat_ws(" ", "words"))
    distinct = stored(cut.groupBy("phrase").agg(F.first("words").alias("words")).select(F.monotonically_increasing_id().alias("id"), "phrase", "words"), "phrases")
    owners = stored(cut.select("phrase", "item_id").join(distinct.select("phrase", "id"), "phrase").select(F.col("id").alias("phrase"), "item_id").distinct(), "owners")
    return distinct.select(F.col("id").alias("phrase"), "words"), owners


def _near(start: Column, slop: int) -> Column:
    return F.explode_outer(F.array(*[start + d for d in range(-slop, slop + 1)])) if slop else start


def matches(index: Index, wanted: DataFrame, slop: int = 0) -> DataFrame:
    """Occurrences ``phrase, doc, start, n``: all words of the phrase in order.

    ``slop`` 0 finds exact phrases.  Above it finds proximity matches: counted from the rarest word, every other word
    stands at most ``slop`` places from where the phrase has it.
    """
    terms = wanted.select("phrase", F.size("words").alias("n"), F.posexplode("words").alias("off", "term"))
    distinct = broadcast_small(stored(terms.select("term").distinct(), "terms"))
    counts = broadcast_small(stored(index.counts.join(distinct, "term"), "term_counts"))
    # A phrase with a word that no document has is out; the others have their words ranked by rarity.
    order = Window.partitionBy("phrase").orderBy("count", "off")
    ranked = terms.join(counts, "term").withColumn("found", F.count(F.lit(1)).over(Window.partitionBy("phrase"))).where(F.col("found") == F.col("n"))
    ranked = stored(ranked.withColumn("rank", F.row_number().over(order)).drop("found", "count"), "ranked")

    def shifted(rank: int) -> DataFrame:
        lists = ranked.where(F.col("rank") == rank).select("phrase", "n", "off", "term")
        return index.of(lists).join(broadcast_small(lists), "term").select("phrase", "n", "doc", (F.col("pos") - F.col("off")).alias("start"))

    first = shifted(1).where(F.col("start") >= -slop).distinct()
    single = first.where(F.col("n") == 1)
    second = shifted(2).select("phrase", "doc", F.col("start").alias("at")).distinct()
    asked = first.where(F.col("n") > 1).select("phrase", "n", "doc", "start", _near(F.col("start"), slop).alias("at"))
    left = stored(asked.join(second, ["phrase", "doc", "at"], "left_semi").select("phrase", "n", "doc", "start").distinct(), "left")

    # The other terms, at the places that are left to ask for.
    rest = ranked.where(F.col("rank") > 2).groupBy("phrase").agg(F.collect_list(F.struct("off", "term")).alias("rest"))  # a window's length
    asked = (
        left.where(F.col("n") > 2)
        .join(broadcast_small(stored(rest.select("phrase", F.explode("rest").alias("r")).select("phrase", "r.off", "r.term"), "rest")), "phrase")
        .select("phrase", "n", "doc", "start", "off", "term", _near(F.col("start") + F.col("off"), slop).alias("pos"))
    )
    docs = broadcast_small(left.where(F.col("n") > 2).select("doc").distinct())
    have = index.of(ranked.where(F.col("rank") > 2)).join(distinct, "term", "left_semi").join(docs, "doc", "left_semi").select("doc", "pos", "term")
    full = (
        asked.join(have, ["doc", "pos", "term"], "left_semi")
        .groupBy("phrase", "n", "doc", "start")
        .agg(F.countDistinct("off").alias("hits") if slop else F.count(F.lit(1)).alias("hits"))
        .where(F.col("hits") == F.col("n") - 2)
    )
    columns = ["phrase", "doc", "start", "n"]
    return single.select(columns).unionByName(left.where(F.col("n") == 2).select(columns)).unionByName(full.select(columns))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing; rows that repeat an id are told
    apart.  A word in several occurrences is one hit.  ``row_col`` names a bigint that tells the rows apart; it is
    returned as ``row``.
    """
    index = build_index(docs, id_col, text_col, F.col(row_col) if row_col else F.monotonically_increasing_id())
    wanted, owners = phrases(items)
    found = stored(matches(index, wanted), "matches")
    # Words covered, from occurrences in order of their start: each adds what lies beyond all ends before it.
    before = Window.partitionBy("doc").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    spans = found.select("doc", "start", (F.col("start") + F.col("n")).alias("stop"), "n").distinct()
    spans = spans.withColumn("reached", F.coalesce(F.max("stop").over(before), F.lit(0)))
    hits = spans.groupBy("doc").agg(F.sum(F.greatest(F.lit(0), F.col("stop") - F.greatest("start", "reached"))).cast("bigint").alias("n_hit"))
    listed = found.select("phrase", "doc").distinct().join(broadcast_small(owners), "phrase").select("doc", F.col("item_id").cast("string").alias("item")).distinct()
    listed = listed.groupBy("doc").agg(F.count(F.lit(1)).alias("n_items"), F.concat_ws(",", F.array_sort(F.collect_list("item"))).alias("items"))
    hits = hits.join(listed, "doc")
    return index.documents.join(hits, "doc", "left").select(
        F.col("id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("bigint").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("bigint").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        *([F.col("doc").alias("row")] if row_col else []),
    )
