"""Graph feature propagation with supplied weights, as joins and aggregations over edge tables.

Vectors travel as arrays and are summed by ``Summarizer`` with partial aggregation, so an edge stays
one row whatever the vector width.  A layer ends in a checkpoint, because the batch statistics need
one pass over the whole node table before the next narrow step.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.functions import vectors as V
from corvane.functions.matrix import from_matrix, linear, to_matrix
from corvane.runtime import broadcast_checked, checkpoint, shuffled


# Up to this width a vector aggregate is one column per component, which runs in generated code and
# in a fixed-width hash map; wider vectors go through Summarizer.
MAX_COLUMNS = 128


def vector_sum(x: str, width: int | None = None) -> Column:
    """Componentwise sum of a projected vector column."""
    if width is not None and width <= MAX_COLUMNS:
        return F.array(*[F.sum(F.col(x)[i]) for i in range(width)])
    x = F.col(x)
    return vector_to_array(Summarizer.metrics("sum").summary(array_to_vector(x)).getField("sum"))


def type_embedding(features: DataFrame, projection: np.ndarray, types: DataFrame) -> DataFrame:
    """(doc_id, id, x): projected numeric features plus the vector of the node's type.

    types(type_id, vec).
    """
    joined = shuffled(features).join(broadcast_checked(types), "type_id")
    return joined.select("doc_id", "id", V.add(linear(F.col("x"), projection), F.col("vec")).alias("x"))


def _without_loops(edges: DataFrame) -> DataFrame:
    """Self-loops are replaced by exactly one per node."""
    return edges.where(F.col("src") != F.col("dst")).select("doc_id", "src", "dst")


def gcn_propagate(
    nodes: DataFrame, edges: DataFrame, weight: np.ndarray | None = None, width: int | None = None
) -> DataFrame:
    """Degree-normalized neighbour sum with self-loops; parallel edges count.

    ``width`` is the vector width, where known and no weight tells it.

    nodes(doc_id, id, x[, more]) -> (doc_id, id, h).
    """
    plain = _without_loops(edges)
    degree = plain.groupBy("doc_id", F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("deg"))
    value = F.col("x") if weight is None else linear(F.col("x"), weight)
    inv = 1.0 / F.sqrt(F.coalesce(F.col("deg"), F.lit(0)) + F.lit(1.0))
    scaled = nodes.select("doc_id", "id", value.alias("x")).join(shuffled(degree), ["doc_id", "id"], "left")
    scaled = scaled.select("doc_id", "id", inv.alias("inv"), V.scale(F.col("x"), inv).alias("h"))
    # The self-loop runs along with the edges and brings the receiver's own scale.
    loops = nodes.select("doc_id", F.col("id").alias("src"), F.col("id").alias("dst"))
    joined = plain.unionByName(loops).join(shuffled(scaled.withColumnRenamed("id", "src")), ["doc_id", "src"])
    terms = joined.select("doc_id", F.col("dst").alias("id"), F.when(F.col("src") == F.col("dst"), F.col("inv")).alias("inv"), "h")
    width = width if weight is None else weight.shape[0]
    sums = terms.groupBy("doc_id", "id").agg(F.max("inv").alias("inv"), vector_sum("h", width).alias("h"))
    return sums.select("doc_id", "id", V.scale(F.col("h"), F.col("inv")).alias("h"))


def gat_propagate(
    nodes: DataFrame,
    edges: DataFrame,
    weight: np.ndarray,
    att_src: np.ndarray,
    att_dst: np.ndarray,
    concat: bool = True,
    slope: float = 0.2,
) -> DataFrame:
    """Attention-weighted neighbour sum with self-loops; ``att_*`` have shape (heads, channels).

    weight is (heads*channels, in).  Heads are concatenated, or averaged when ``concat`` is off.
    """
    heads, channels = att_src.shape
    width = heads * channels

    def per_head(att: np.ndarray) -> np.ndarray:
        """Attention scores straight from x: (heads, in)."""
        return np.einsum("hc,hcj->hj", att, weight.reshape(heads, channels, -1))

    # One product per node and side: the sender brings its value and score, the receiver its score.
    sender = nodes.select("doc_id", F.col("id").alias("src"), linear(F.col("x"), np.vstack([weight, per_head(att_src)])).alias("hs"))
    receiver = nodes.select("doc_id", F.col("id").alias("dst"), linear(F.col("x"), per_head(att_dst)).alias("d"))
    loops = nodes.select("doc_id", F.col("id").alias("src"), F.col("id").alias("dst"))
    joined = _without_loops(edges).unionByName(loops).join(shuffled(sender), ["doc_id", "src"]).join(shuffled(receiver), ["doc_id", "dst"])
    raw = F.zip_with(F.slice("hs", width + 1, heads), "d", lambda a, b: F.greatest(a + b, (a + b) * F.lit(slope)))
    scored = joined.select("doc_id", "dst", F.slice("hs", 1, width).alias("h"), raw.alias("e"))
    # Neighbours of one node: at most the edges of one capped graph.  The join above already brought
    # them together in order, so the window adds neither a shuffle nor a sort.
    around = Window.partitionBy("doc_id", "dst")
    peaks = scored.withColumn("peak", F.array(*[F.max(F.col("e")[h]).over(around) for h in range(heads)]))
    power = peaks.select("doc_id", "dst", "h", F.zip_with("e", "peak", lambda a, b: F.exp(a - b)).alias("p"))

    def per_channel(p: str) -> Column:
        return F.flatten(F.transform(p, lambda v: F.array_repeat(v, channels)))

    weighted = F.zip_with("h", per_channel("p"), lambda v, w: v * w)
    terms = power.select("doc_id", F.col("dst").alias("id"), weighted.alias("h"), "p")
    sums = terms.groupBy("doc_id", "id").agg(vector_sum("h", width).alias("h"), vector_sum("p", heads).alias("p"))
    mixed = F.zip_with("h", per_channel("p"), lambda v, w: v / w)
    out = sums.select("doc_id", "id", mixed.alias("h"))
    if concat or heads == 1:
        return out
    mean = np.tile(np.eye(channels), heads) / heads
    return out.select("doc_id", "id", linear(F.col("h"), mean).alias("h"))


def column_statistics(df: DataFrame, x: str) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population variance of every component: one aggregation, one small row back."""
    parts = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(F.col(x)))
    row = df.agg(parts.alias("s")).first()["s"]
    n = row["count"]
    if n == 0:
        raise ValueError("no rows to standardize")
    return row["mean"].toArray(), row["variance"].toArray() * (n - 1) / n


def _standardized(x: Column, mean: np.ndarray, var: np.ndarray, eps: float) -> Column:
    inv = 1.0 / np.sqrt(var + eps)
    shift = -mean * inv

    @F.arrow_udf("array<double>")
    def standardize(v: pa.Array) -> pa.Array:
        if len(v) == 0:
            return pa.array([], type=pa.list_(pa.float64()))
        return from_matrix(to_matrix(v) * inv + shift)

    return standardize(x)


def batch_standardize(
    df: DataFrame, x: str = "x", eps: float = 1e-5, statistics: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """Standardize every component over all rows, or with supplied (mean, variance)."""
    mean, var = statistics or column_statistics(df, x)
    return df.withColumn(x, _standardized(F.col(x), mean, var, eps))


@dataclass
class Layer:
    """Weights of one propagation layer: convolution, optional attention, residual projection."""

    weight: np.ndarray
    residual: np.ndarray
    att_src: np.ndarray | None = None
    att_dst: np.ndarray | None = None
    concat: bool = True


def residual_layer(
    nodes: DataFrame, edges: DataFrame, layer: Layer, eps: float = 1e-5, statistics: tuple[np.ndarray, np.ndarray] | None = None
) -> DataFrame:
    """``residual(x) + relu(standardize(conv(x)))`` for every node, checkpointed.

    ``statistics`` (mean, variance) are those of another table, frozen; without them, the present nodes' own.
    """
    if layer.att_src is None:
        conv = gcn_propagate(nodes, edges, layer.weight)
    else:
        conv = gat_propagate(nodes, edges, layer.weight, layer.att_src, layer.att_dst, layer.concat)
    both = checkpoint(conv.join(shuffled(nodes.select("doc_id", "id", "x")), ["doc_id", "id"]))
    mean, var = statistics or column_statistics(both, "h")
    inv, project = 1.0 / np.sqrt(var + eps), np.ascontiguousarray(layer.residual.T)

    @F.arrow_udf("array<double>")
    def step(h: pa.Array, x: pa.Array) -> pa.Array:
        if len(h) == 0:
            return pa.array([], type=pa.list_(pa.float64()))
        return from_matrix(to_matrix(x) @ project + np.maximum((to_matrix(h) - mean) * inv, 0.0))

    return both.select("doc_id", "id", step("h", "x").alias("x"))


# A graph of more nodes and edges than this does not travel in one row.
MAX_PACKED = 200_000


def node_embeddings(
    nodes: DataFrame,
    edges: DataFrame,
    layers: list[Layer],
    statistics: list[tuple[np.ndarray, np.ndarray]] | None = None,
    max_packed: int = MAX_PACKED,
) -> DataFrame:
    """Node vectors after the last layer.

    Graphs are packed into a row each and never joined; a table with a graph above ``max_packed`` is propagated by joins.
    ``statistics`` are frozen ones, a pair for each layer; without them a layer takes those of the present nodes.
    """
    from corvane.operators import graph_blocks

    nodes, edges = checkpoint(nodes), checkpoint(edges)
    if graph_blocks.largest_graph(nodes, edges) <= max_packed:
        return graph_blocks.node_vectors(graph_blocks.pack(nodes, edges), layers, statistics)
    for k, layer in enumerate(layers):
        nodes = residual_layer(nodes, edges, layer, statistics=statistics[k] if statistics else None)
    return nodes


def graph_mean_max_pool(nodes: DataFrame, width: int | None = None) -> DataFrame:
    """(doc_id, vec): mean and maximum of the node vectors, concatenated."""
    if width is not None and width <= MAX_COLUMNS:
        parts = [f(F.col("x")[i]) for f in (F.avg, F.max) for i in range(width)]
        return nodes.groupBy("doc_id").agg(F.array(*parts).alias("vec"))
    parts = Summarizer.metrics("mean", "max").summary(array_to_vector(F.col("x")))
    pooled = nodes.groupBy("doc_id").agg(parts.alias("s"))
    return pooled.select("doc_id", F.concat(vector_to_array("s.mean"), vector_to_array("s.max")).alias("vec"))
