"""Token pooling, user models over batches, and fusion of two embeddings; weights are supplied."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, predict_batch_udf, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

from corvane.functions import vectors as V
from corvane.functions.matrix import from_matrix, linear, to_matrix
from corvane.operators.gnn import MAX_COLUMNS, vector_sum

# Smallest mask sum, and the value of a masked component under max pooling.
MIN_MASK, MASKED = 1e-9, -1e9


def pool_tokens(tokens: DataFrame, pooling: str = "cls", key: str = "doc_id", width: int | None = None) -> DataFrame:
    """(key, vec) from token rows (key, pos, vec, mask); the pooled vector is layer-normalized.

    ``width`` is the vector width, where known: narrow vectors are then aggregated by component.
    """
    vec = F.col("vec")
    if pooling == "cls":
        pooled = tokens.where(F.col("pos") == 0).select(key, vec)
    elif pooling == "mean":
        masked = V.scale(vec, F.col("mask").cast("double"))
        rows = tokens.select(key, masked.alias("vec"), "mask")
        sums = rows.groupBy(key).agg(vector_sum("vec", width).alias("vec"), F.sum("mask").cast("double").alias("n"))
        pooled = sums.select(key, V.scale(vec, 1.0 / F.greatest("n", F.lit(MIN_MASK))).alias("vec"))
    elif pooling == "max":
        masked = F.when(F.col("mask") == 0, F.transform(vec, lambda _: F.lit(MASKED))).otherwise(vec)
        rows = tokens.select(key, masked.alias("vec"))
        if width is not None and width <= MAX_COLUMNS:
            top = F.array(*[F.max(vec[i]) for i in range(width)])
        else:
            top = vector_to_array(Summarizer.metrics("max").summary(array_to_vector(vec)).getField("max"))
        pooled = rows.groupBy(key).agg(top.alias("vec"))
    else:
        raise ValueError(f"unknown pooling {pooling!r}")
    return pooled.select(key, V.layer_norm(F.col("vec")).alias("vec"))


def embed_batch(make_model: Callable[[], Callable[[np.ndarray], np.ndarray]], batch_size: int = 32):
    """A user's model as a column function: built once per worker, called on batches of texts."""
    return predict_batch_udf(make_model, return_type=T.ArrayType(T.DoubleType()), batch_size=batch_size)


def fuse_concat(a: Column, b: Column, weight: np.ndarray, bias: np.ndarray | None = None) -> Column:
    return V.layer_norm(linear(F.concat(a, b), weight, bias, "relu"))


def self_attention(
    a: Column, b: Column, heads: int, projections: dict[str, np.ndarray] | None = None
) -> Column:
    """Mean of the two outputs of multi-head self-attention over the pair (a, b).

    ``projections`` may hold matrices q, k, v and out; a missing one is the identity.
    """
    given = {n: np.ascontiguousarray(m.T) for n, m in (projections or {}).items()}

    @F.arrow_udf("array<double>")
    def attend(left: pa.Array, right: pa.Array) -> pa.Array:
        if len(left) == 0:
            return pa.array([], type=pa.list_(pa.float64()))
        pair = np.stack([to_matrix(left), to_matrix(right)], axis=1)
        n, _, dim = pair.shape
        if dim % heads:
            raise ValueError(f"width {dim} is not a multiple of {heads} heads")
        q, k, v = (
            (pair @ given[p] if p in given else pair).reshape(n, 2, heads, dim // heads).transpose(0, 2, 1, 3)
            for p in ("q", "k", "v")
        )
        logits = q @ k.transpose(0, 1, 3, 2) / np.sqrt(dim // heads)
        power = np.exp(logits - logits.max(axis=-1, keepdims=True))
        mixed = (power / power.sum(axis=-1, keepdims=True)) @ v
        out = mixed.transpose(0, 2, 1, 3).reshape(n, 2, dim)
        if "out" in given:
            out = out @ given["out"]
        return from_matrix(out.mean(axis=1))

    return attend(a, b)


def fuse_attention(
    a: Column, b: Column, weight: np.ndarray, heads: int = 8, projections: dict[str, np.ndarray] | None = None
) -> Column:
    return V.layer_norm(linear(self_attention(a, b, heads, projections), weight))


def fuse_gated(a: Column, b: Column, gate: np.ndarray, weight: np.ndarray, gate_bias: float = 0.0) -> Column:
    """A learned share g of ``a`` and 1 - g of ``b``, projected; ``gate`` is one row of weights."""
    on_a, on_b = np.split(np.asarray(gate, dtype="f8").ravel(), 2)

    @F.arrow_udf("array<double>")
    def mix(left: pa.Array, right: pa.Array) -> pa.Array:
        if len(left) == 0:
            return pa.array([], type=pa.list_(pa.float64()))
        x, y = to_matrix(left), to_matrix(right)
        share = (1.0 / (1.0 + np.exp(-(x @ on_a + y @ on_b + gate_bias))))[:, None]
        return from_matrix(share * x + (1.0 - share) * y)

    return V.layer_norm(linear(mix(a, b), weight))


def fuse(method: str, a: Column, b: Column, **weights) -> Column:
    methods = {"concat": fuse_concat, "attention": fuse_attention, "gated": fuse_gated}
    if method not in methods:
        raise ValueError(f"unknown fusion method {method!r}")
    return methods[method](a, b, **weights)
