"""Token vocabulary, token ids, and the hashed text embedding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.matrix import hash_scatter
from corvane.functions.text import words
from corvane.operators.positions import with_positions
from corvane.runtime import checkpoint, collect_bounded, explode_once, shuffled

# Reserved token ids.
PAD_ID, UNKNOWN_ID, FIRST_ID = 0, 1, 2
# Up to this size a vocabulary is shipped whole for lookups.
SMALL_VOCAB = 100_000


def token_vocab(docs: DataFrame, size: int | None = None, text: str = "text") -> DataFrame:
    """(token, token_id, n): all tokens, or the ``size`` most frequent; ties in token order, ids from 2."""
    tokens = docs.select(explode_once(words(F.col(text))).alias("token")).where(F.col("token").isNotNull())
    counts = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    ranked = with_positions(checkpoint(counts.withColumn("_neg", -F.col("n"))), "_neg", "token")
    if size is not None:
        ranked = ranked.where(F.col("position") < size)
    return ranked.select("token", (F.col("position") + FIRST_ID).cast("bigint").alias("token_id"), "n")


def encode_tokens(
    docs: DataFrame,
    vocab: DataFrame,
    max_length: int = 512,
    key: str = "doc_id",
    text: str = "text",
    shipped: int = SMALL_VOCAB,
) -> DataFrame:
    """(key, input_ids, attention_mask), truncated at ``max_length`` and padded to it.

    A vocabulary of at most ``shipped`` tokens is looked up inside the document's row, batch by batch;
    a larger one is joined, token by token.
    """
    kept = docs.select(key, F.slice(words(F.col(text)), 1, max_length).alias("tokens"))
    ids = vocab.select("token", "token_id")
    small = collect_bounded(ids, shipped)
    if small is not None:
        return _padded(kept.select(key, look_up(F.col("tokens"), small).alias("ids")), key, max_length)
    flat = kept.select(key, F.posexplode_outer("tokens").alias("pos", "token")).join(shuffled(ids), "token", "left")
    entry = F.when(F.col("pos").isNotNull(), F.struct("pos", F.coalesce("token_id", F.lit(UNKNOWN_ID)).alias("id")))
    # At most max_length entries per document; collect_list skips the null of an empty text.
    rows = flat.groupBy(key).agg(F.array_sort(F.collect_list(entry)).alias("e"))
    return _padded(rows.select(key, F.transform("e", lambda s: s["id"].cast("bigint")).alias("ids")), key, max_length)


def look_up(tokens: Column, vocab: pa.Table) -> Column:
    """Ids of an array of tokens, by a vocabulary (token, token_id) that travels with the task."""
    known, known_ids = vocab.column("token").combine_chunks(), vocab.column("token_id").to_numpy()

    @F.arrow_udf("array<bigint>")
    def look_up(batch: pa.Array) -> pa.Array:
        found = pc.fill_null(pc.index_in(batch.flatten(), value_set=known), -1).to_numpy(zero_copy_only=False)
        ids = np.append(known_ids, UNKNOWN_ID)[found]  # -1 picks the unknown id
        lengths = batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        offsets = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("i4"))
        return pa.ListArray.from_arrays(offsets, pa.array(ids, type=pa.int64()))

    return look_up(tokens)


def pad(ids: Column, max_length: int) -> tuple[Column, Column]:
    """Ids filled up to ``max_length``, and the mask of those that are real."""
    used, rest = F.size(ids), F.lit(max_length) - F.size(ids)
    return F.concat(ids, F.array_repeat(F.lit(PAD_ID).cast("bigint"), rest)), F.concat(F.array_repeat(F.lit(1), used), F.array_repeat(F.lit(0), rest))


def _padded(rows: DataFrame, key: str, max_length: int) -> DataFrame:
    ids, mask = pad(F.col("ids"), max_length)
    return rows.select(key, ids.alias("input_ids"), mask.alias("attention_mask"))


def embed_text(text: Column, dim: int) -> Column:
    """Unit vector of a text: signed hashed bag of its words, over the whole text.

    Narrow: a text is never exploded into rows and nothing is shuffled.
    """
    return hash_scatter(F.lower(text), dim)
