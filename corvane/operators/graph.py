"""Graphs as two tables: nodes (doc_id, id, type, parent_id, ...) and edges (doc_id, src, dst, kind).

Node ids are dense and in pre-order, so keeping the first ``max_nodes`` nodes is a plain filter.
Every per-graph window below runs after that cap, which bounds its partitions by ``max_nodes`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from corvane.operators.positions import running, with_positions
from corvane.runtime import broadcast_checked, checkpoint, explode_once, shuffled

MAX_NODES = 500

# Node types chained by control-flow edges.
CONTROL_TYPES = (
    "if_statement",
    "while_statement",
    "for_statement",
    "try_statement",
    "switch_statement",
    "function_definition",
    "method_declaration",
    "class_declaration",
)


def parent_child_edges(nodes: DataFrame) -> DataFrame:
    """Parent to child, one way; the root has no edge."""
    return nodes.where(F.col("parent_id").isNotNull()).select(
        "doc_id", F.col("parent_id").alias("src"), F.col("id").alias("dst")
    )


def cap_nodes(nodes: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """The first ``max_nodes`` nodes of each graph; all of them for None."""
    return nodes if max_nodes is None else nodes.where(F.col("id") < max_nodes)


def _both_ways(pairs: DataFrame, kind: str) -> DataFrame:
    """Rows (doc_id, a, b) as edges a->b and b->a."""
    ends = F.inline(
        F.array(
            F.struct(F.col("a").alias("src"), F.col("b").alias("dst")),
            F.struct(F.col("b").alias("src"), F.col("a").alias("dst")),
        )
    )
    return pairs.select("doc_id", ends).withColumn("kind", F.lit(kind))


def _inside(parent: Column, max_nodes: int | None) -> Column:
    return parent.isNotNull() if max_nodes is None else parent < max_nodes


def _children(nodes: DataFrame, max_nodes: int | None) -> DataFrame:
    return cap_nodes(nodes, max_nodes).where(_inside(F.col("parent_id"), max_nodes))


def tree_edges(nodes: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    pairs = _children(nodes, max_nodes).select("doc_id", F.col("parent_id").alias("a"), F.col("id").alias("b"))
    return _both_ways(pairs, "tree")


def sibling_edges(nodes: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """Consecutive children of one parent, both ways."""
    order = Window.partitionBy("doc_id", "parent_id").orderBy("id")
    pairs = _children(nodes, max_nodes).select("doc_id", F.col("id").alias("a"), F.lead("id").over(order).alias("b"))
    return _both_ways(pairs.where(F.col("b").isNotNull()), "sibling")


def control_flow_edges(nodes: DataFrame, max_nodes: int | None = MAX_NODES, control_types=CONTROL_TYPES) -> DataFrame:
    """Consecutive control nodes in pre-order, one way."""
    order = Window.partitionBy("doc_id").orderBy("id")
    control = cap_nodes(nodes, max_nodes).where(F.col("type").isin(*control_types))
    pairs = control.select("doc_id", F.col("id").alias("src"), F.lead("id").over(order).alias("dst"))
    return pairs.where(F.col("dst").isNotNull()).withColumn("kind", F.lit("control"))


def graph_edges(nodes: DataFrame, max_nodes: int | None = MAX_NODES, control_types=CONTROL_TYPES) -> DataFrame:
    """All edges; an edge found by two rules is kept twice.

    One pass over the nodes and one shuffle: partitioned by document, both windows find their rows in
    place, and every node emits its edges of all kinds.
    """
    control = F.coalesce(F.col("type").isin(*control_types), F.lit(False))
    slim = cap_nodes(nodes, max_nodes).select("doc_id", "id", "parent_id", control.alias("control")).repartition("doc_id")
    sibling = F.lead("id").over(Window.partitionBy("doc_id", "parent_id").orderBy("id"))
    following = F.lead("id").over(Window.partitionBy("doc_id", "control").orderBy("id"))
    linked = slim.withColumns({"sibling": sibling, "following": following})
    child = _inside(F.col("parent_id"), max_nodes)

    def edge(when: Column, src: str, dst: str, kind: str) -> Column:
        return F.when(when, F.struct(F.col(src).alias("src"), F.col(dst).alias("dst"), F.lit(kind).alias("kind")))

    has_sibling = child & F.col("sibling").isNotNull()
    edges = F.array(
        edge(child, "parent_id", "id", "tree"),
        edge(child, "id", "parent_id", "tree"),
        edge(has_sibling, "id", "sibling", "sibling"),
        edge(has_sibling, "sibling", "id", "sibling"),
        edge(F.col("control") & F.col("following").isNotNull(), "id", "following", "control"),
    )
    flat = linked.select("doc_id", explode_once(F.array_compact(edges)).alias("e")).where(F.col("e").isNotNull())
    return flat.select("doc_id", "e.src", "e.dst", "e.kind")


def node_type_vocab(nodes: DataFrame) -> DataFrame:
    """(type, type_id): dense ids in order of first occurrence (doc_id, id)."""
    # Written once: ordering samples its input before it reads it.
    first = checkpoint(nodes.groupBy("type").agg(F.min(F.struct("doc_id", "id")).alias("first")))
    ranked = with_positions(first.select("type", "first.doc_id", "first.id"), "doc_id", "id", "type", name="type_id")
    return ranked.select("type", "type_id")


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def node_features(nodes: DataFrame, vocab: DataFrame, max_nodes: int | None = MAX_NODES) -> DataFrame:
    """(doc_id, id, type_id, x) with x = [type_id, depth, child_count, is_named]."""
    capped = shuffled(cap_nodes(nodes, max_nodes)).join(broadcast_checked(vocab), "type")
    parts = [F.col(c).cast("double") for c in ("type_id", "depth", "child_count")]
    x = F.array(*parts, F.col("is_named").cast("int").cast("double"))
    return capped.select("doc_id", "id", "type_id", x.alias("x"))


def with_empty_graphs(features: DataFrame, docs: DataFrame) -> DataFrame:
    """Add one zero node for every document that has none."""
    missing = docs.select("doc_id").join(shuffled(features.select("doc_id").distinct()), "doc_id", "left_anti")
    zero = missing.select(
        "doc_id",
        F.lit(0).alias("id"),
        F.lit(0).cast("bigint").alias("type_id"),
        F.array_repeat(F.lit(0.0), 4).alias("x"),
    )
    return features.unionByName(zero)


def graph_batch(features: DataFrame, edges: DataFrame, batches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stack the graphs of each batch: node ids shifted by the nodes of the earlier graphs.

    batches(doc_id, batch_id).  Returns nodes (batch_id, node, doc_id, id, x) and edges
    (batch_id, src, dst).  Offsets are a running sum over one row per graph.
    """
    sizes = checkpoint(features.groupBy("doc_id").agg(F.count(F.lit(1)).alias("nodes")).join(shuffled(batches), "doc_id"))
    offsets = running(sizes, "batch_id", "doc_id", "nodes", "sum", "offset").select(
        "batch_id", "doc_id", F.col("offset").cast("bigint").alias("offset")
    )
    nodes = features.join(shuffled(offsets), "doc_id").select(
        "batch_id", (F.col("offset") + F.col("id")).alias("node"), "doc_id", "id", "x"
    )
    shifted = edges.join(shuffled(offsets), "doc_id").select(
        "batch_id", (F.col("offset") + F.col("src")).alias("src"), (F.col("offset") + F.col("dst")).alias("dst")
    )
    return nodes, shifted


