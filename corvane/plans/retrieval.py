"""End-to-end plans: encode code records, search an index with text queries."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from corvane.functions import vectors as V
from corvane.functions.matrix import linear
from corvane.functions.text import preprocess
from corvane.operators import graph as G
from corvane.operators.encode import fuse
from corvane.operators.gnn import Layer
from corvane.operators.graph_blocks import OutlineReader, fit_statistics, graph_vectors
from corvane.operators.outline import OUTLINE_COLUMNS, outlined, with_outline
from corvane.operators.records import RESULT_DEFAULTS, filter_language, project_results
from corvane.operators.search import attach_metadata
from corvane.operators.tokens import embed_text
from corvane.runtime import checkpoint, collect_bounded
from corvane.sources.index import VectorIndex


# Node types are kinds of lines: a vocabulary of more is a mistake.
MAX_TYPES = 100_000


@dataclass
class EncoderWeights:
    """Supplied weights of the code encoder.

    projection (hidden, 4), types: frame (type_id, vec), output (dim, 2*node width).
    """

    projection: np.ndarray
    types: DataFrame
    layers: list[Layer]
    output: np.ndarray
    fusion: str = "concat"
    fusion_weights: dict = field(default_factory=dict)


def embed_code(records: DataFrame, dim: int) -> DataFrame:
    """(doc_id, vec): text embedding of the cleaned code."""
    return records.select("doc_id", embed_text(preprocess(F.col("code"), F.col("language")), dim).alias("vec"))


def outline_reader(weights: EncoderWeights, vocab: DataFrame) -> OutlineReader:
    """How packed outlines are read, with the types' vectors in order of their ids; types without a vector are unknown."""
    rows = collect_bounded(vocab.select("type", "type_id").join(weights.types, "type_id"), MAX_TYPES)
    if rows is None:
        raise ValueError(f"more than {MAX_TYPES} node types")
    rows = sorted(zip(rows["type_id"].to_pylist(), rows["type"].to_pylist(), rows["vec"].to_pylist()))
    vectors = np.array([r[2] for r in rows], "f8").reshape(len(rows), weights.projection.shape[0])
    return OutlineReader([r[1] for r in rows], vectors, weights.projection)


def with_code_vector(records: DataFrame, weights: EncoderWeights, reader: OutlineReader, statistics: list, dim: int, max_nodes: int | None = G.MAX_NODES) -> DataFrame:
    """``records`` with ``vec``, the fused text and graph vector of their code, by frozen statistics.

    Narrow: everything happens in the record's own row, so a record gets the same vector alone and in any table.
    """
    rows = with_outline(records.withColumn("_a", embed_text(preprocess(F.col("code"), F.col("language")), dim)), max_nodes)
    rows = rows.withColumn("_g", graph_vectors(reader, weights.layers, statistics)(*[F.col(c) for c in reader.columns])).drop(*reader.columns)
    graph = V.layer_norm(linear(F.col("_g"), weights.output, activation="relu"))
    return rows.withColumn("_b", graph).withColumn("vec", fuse(weights.fusion, F.col("_a"), F.col("_b"), **weights.fusion_weights)).drop("_a", "_g", "_b")


def code_statistics(records: DataFrame, weights: EncoderWeights, reader: OutlineReader, max_nodes: int | None = G.MAX_NODES) -> list:
    """Mean and variance of every layer over the outlines of ``records``; each code is parsed once, and not again where its outline is there."""
    packed = outlined(records, max_nodes).select(*reader.columns)
    if not set(OUTLINE_COLUMNS) <= set(records.columns):
        packed = checkpoint(packed)
    return fit_statistics(packed, reader, weights.layers)


def encode_code(
    records: DataFrame, weights: EncoderWeights, vocab: DataFrame, dim: int, max_nodes: int | None = G.MAX_NODES, statistics: list | None = None
) -> DataFrame:
    """(doc_id, vec): text and graph embeddings of each record, fused; None lifts the cap on a graph's nodes.

    Layers are standardized by ``statistics`` or, without them, by those of ``records`` themselves.
    """
    reader = outline_reader(weights, vocab)
    if statistics is None:
        statistics = code_statistics(records, weights, reader, max_nodes)
    return with_code_vector(records.select("doc_id", "code", "language"), weights, reader, statistics, dim, max_nodes).select("doc_id", "vec")


def search(requests: DataFrame, index: VectorIndex, return_scores: bool = True, language_mode: str = "post") -> DataFrame:
    """Ranked records for requests(query_id, query, top_k, language), all valid.

    A request's language is matched after ranking ("post": ranks stay, fewer than top_k rows may be
    left) or before it ("pre": only records of that language are ranked; one index scan whatever languages
    are asked for).
    """
    if language_mode not in ("post", "pre"):
        raise ValueError(f"unknown language mode {language_mode!r}")
    requests = checkpoint(requests)
    k = requests.agg(F.max("top_k")).first()[0] or 0
    vec = embed_text(F.col("query"), index.config.embedding_dim)
    queries = requests.select("query_id", F.col("language").alias("label"), vec.alias("vec"))
    hits = index.search(queries, k, label="language" if language_mode == "pre" else None)
    wanted = hits.join(requests.select("query_id", "top_k", F.col("language").alias("want")), "query_id")
    kept = attach_metadata(wanted.where(F.col("rank") <= F.col("top_k")), index.metadata().drop("vec_id"), "row_id")
    if language_mode == "post":
        # The filter sees the record's language with its default, as the result shows it.
        shown = kept.withColumn("language", F.coalesce(F.col("language"), F.lit(RESULT_DEFAULTS["language"])))
        kept = filter_language(shown, F.col("want"))
    return project_results(kept, return_scores)
