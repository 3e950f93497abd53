"""From raw documents to token ids: quality, exact and near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each result as Parquet to the shared
folder and hands it to the next.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from corvane.llm import quality
from corvane.llm.bpe import encode_documents
from corvane.llm.common import ROW, crc_mod, keep_named, named_rows, stored, table
from corvane.llm.exact_dedup import exact_dedup
from corvane.llm.minhash import near_duplicates
from corvane.llm.phrases import decontaminate
from corvane.llm.queries import ranks_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labelled ones outside the held-out fifth, does not reject."""
    sample = quality.training_sample(docs, table(spark, sf_dir, "labels"), crc_mod(F.col("id"), 5) != 0, "quality")
    return quality.filter_documents(docs, quality.train(*sample))


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The longest document, then the one with the smallest id, of each group of equal texts."""
    docs = named_rows(docs)
    return keep_named(docs, exact_dedup(docs, row_col=ROW))


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies."""
    docs = named_rows(docs)
    return keep_named(docs, near_duplicates(docs, row_col=ROW))


def no_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    docs = named_rows(docs)
    found = decontaminate(docs, table(spark, sf_dir, "benchmark"), row_col=ROW)
    return keep_named(docs, found.select("row", (~F.col("contaminated")).alias("kept")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded bytes of every document that is left."""
    return encode_documents(docs, ranks_path()).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", distinct_texts),
    ("near dedup", no_near_copies),
    ("benchmark decontamination", no_benchmark),
    ("byte-level BPE", token_ids),
]

# The network of the first stage is beyond SQL; tests/llm holds the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "_"))
    return docs
