"""Training examples: token ids of the cleaned code and of the docstring, the outline graph, language and id of every record."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.text import preprocess, words
from corvane.operators import graph as G
from corvane.operators.graph_blocks import OutlineReader
from corvane.operators.outline import with_outline
from corvane.operators.sampling import single_triplet
from corvane.operators.tokens import SMALL_VOCAB, look_up, pad, encode_tokens
from corvane.runtime import collect_bounded, shuffled

MAX_LENGTH = 512


def training_examples(
    records: DataFrame, vocab: DataFrame, types: list[str], max_length: int = MAX_LENGTH, max_nodes: int | None = G.MAX_NODES, shipped: int = SMALL_VOCAB
) -> DataFrame:
    """Per record(doc_id, code, docstring, language): ``doc_id, language, code_input_ids, code_attention_mask, query_input_ids,
    query_attention_mask, graph``.

    Everything happens in the record's own row while the vocabulary has at most ``shipped`` tokens; a larger one is
    joined, token by token.  A missing language is Python, a missing docstring empty.  ``types`` are the node types in order
    of their ids; see ``OutlineReader.graphs`` for the graph.
    """
    rows = records.select("doc_id", "code", F.coalesce("docstring", F.lit("")).alias("docstring"), F.coalesce("language", F.lit("python")).alias("language"))
    clean = preprocess(F.col("code"), F.col("language"))
    reader = OutlineReader(types, np.zeros((len(types), 1)), np.zeros((1, 4)))
    graph = reader.graphs(*[F.col(c) for c in reader.columns]).alias("graph")
    small = collect_bounded(vocab.select("token", "token_id"), shipped)
    sides = {"code": clean, "query": F.col("docstring")}
    if small is not None:
        rows = rows.withColumns({f"_{side}": look_up(F.slice(words(text), 1, max_length), small) for side, text in sides.items()})
        ids = {side: pad(F.col(f"_{side}"), max_length) for side in sides}
        return with_outline(rows, max_nodes).select("doc_id", "language", *[c.alias(f"{side}_{name}") for side in sides for c, name in zip(ids[side], _NAMES)], graph)
    out = with_outline(rows, max_nodes).select("doc_id", "language", graph)
    for side, text in sides.items():
        encoded = encode_tokens(rows.select("doc_id", text.alias("text")), vocab, max_length, shipped=0)
        out = out.join(shuffled(encoded.select("doc_id", *[F.col(n).alias(f"{side}_{n}") for n in _NAMES])), "doc_id")
    return out.select("doc_id", "language", *[f"{side}_{name}" for side in sides for name in _NAMES], "graph")


_NAMES = ("input_ids", "attention_mask")


def triplet_examples(examples: DataFrame, seed=0) -> DataFrame:
    """(doc_id, anchor, positive, negative): whole examples; the positive is the anchor, the negative any other record.

    A table of one record has no negatives and gives no rows.
    """
    drawn = single_triplet(examples.select(F.col("doc_id").alias("id")), examples.select(F.col("doc_id").alias("anchor_id")), seed)
    whole = examples.select("doc_id", F.struct(*examples.columns).alias("example"))

    def of(key: str, name: str) -> DataFrame:
        return whole.select(F.col("doc_id").alias(key), F.col("example").alias(name))

    rows = drawn.select("anchor_id", "negative_id").join(shuffled(of("anchor_id", "anchor")), "anchor_id").join(shuffled(of("negative_id", "negative")), "negative_id")
    return rows.select(F.col("anchor_id").alias("doc_id"), "anchor", F.col("anchor").alias("positive"), "negative")


def joined_text(array: Column) -> Column:
    """The numbers of an array as text."""
    return F.array_join(F.transform(array, lambda v: v.cast("bigint").cast("string")), ",")
