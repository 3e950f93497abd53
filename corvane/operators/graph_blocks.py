"""Graph propagation on packed graphs: one row per graph, layers as numpy segment sums over Arrow batches of rows.

A graph that fits in a row needs no join: its edges meet its node vectors inside the batch, all graphs of a batch at
once, and nothing but the packed rows themselves ever moves.  What a layer needs of the whole table, mean and variance
of every component, is one small row per task.  With these frozen, the whole network is a column function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.matrix import from_matrix
from corvane.operators.gnn import Layer
from corvane.operators.graph import CONTROL_TYPES
from corvane.operators.outline import UNNAMED_TYPE
from corvane.runtime import checkpoint, shuffled

# Batches are worked on in slices of about this many nodes and edges.
SLICE_NODES = 20_000
# Task summaries are merged in so many groups before they go to the driver.
MERGE_GROUPS = 32
EPS = 1e-5

Statistics = tuple[np.ndarray, np.ndarray]


@dataclass
class Batch:
    """Graphs laid end to end: ``sizes`` nodes each, node vectors, edges between the numbered nodes."""

    sizes: np.ndarray
    x: np.ndarray
    src: np.ndarray
    dst: np.ndarray


def _segments(sizes: np.ndarray) -> np.ndarray:
    return np.cumsum(sizes) - sizes


class Incoming:
    """Edges by receiver, with exactly one self-loop per node in place of those given."""

    def __init__(self, batch: Batch):
        n = len(batch.x)
        real = batch.src != batch.dst
        src, dst = np.concatenate([batch.src[real], np.arange(n)]), np.concatenate([batch.dst[real], np.arange(n)])
        order = np.argsort(dst, kind="stable")
        self.src, self.dst = src[order], dst[order]
        self.count = np.bincount(dst, minlength=n)
        self.first = _segments(self.count)

    def sum(self, values: np.ndarray) -> np.ndarray:
        return np.add.reduceat(values, self.first, axis=0)


def gcn(x: np.ndarray, weight: np.ndarray | None, edges: Incoming) -> np.ndarray:
    h = x if weight is None else x @ weight.T
    scale = (1.0 / np.sqrt(edges.count))[:, None]
    return edges.sum((h * scale)[edges.src]) * scale


def gat(x: np.ndarray, layer: Layer, edges: Incoming, slope: float = 0.2) -> np.ndarray:
    heads, channels = layer.att_src.shape
    h = (x @ layer.weight.T).reshape(len(x), heads, channels)
    e = np.einsum("nhc,hc->nh", h, layer.att_src)[edges.src] + np.einsum("nhc,hc->nh", h, layer.att_dst)[edges.dst]
    e = np.maximum(e, slope * e)
    p = np.exp(e - np.maximum.reduceat(e, edges.first, axis=0)[edges.dst])
    out = edges.sum(p[:, :, None] * h[edges.src]) / edges.sum(p)[:, :, None]
    return out.reshape(len(x), -1) if layer.concat or heads == 1 else out.mean(axis=1)


def convolve(x: np.ndarray, layer: Layer, edges: Incoming) -> np.ndarray:
    return gcn(x, layer.weight, edges) if layer.att_src is None else gat(x, layer, edges)


def forward(batch: Batch, layers: list[Layer], statistics: list[Statistics], eps: float = EPS) -> np.ndarray:
    """Node vectors after ``layers``, each standardized with its frozen statistics."""
    x, edges = batch.x, Incoming(batch)
    for layer, (mean, var) in zip(layers, statistics, strict=True):
        x = x @ layer.residual.T + np.maximum((convolve(x, layer, edges) - mean) / np.sqrt(var + eps), 0.0)
    return x


def mean_max_pool(x: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    first = _segments(sizes)
    return np.concatenate([np.add.reduceat(x, first, axis=0) / sizes[:, None], np.maximum.reduceat(x, first, axis=0)], axis=1)


def slices(weights: np.ndarray, most: int = SLICE_NODES) -> Iterator[slice]:
    """Runs of rows of about ``most`` in sum; a heavier row is a run of its own."""
    upto, first = np.cumsum(weights), 0
    while first < len(weights):
        last = max(first + 1, int(np.searchsorted(upto, (upto[first - 1] if first else 0) + most, "right")))
        yield slice(first, last)
        first = last


def _flat(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False)


# --- two ways to pack -------------------------------------------------------------------------------------------


@dataclass
class OutlineReader:
    """Reads rows of ``operators.outline.with_outline``: vectors of the nodes' features, and all edges of the outline.

    A type that ``types`` lacks counts as one more type whose vector is zero; a file without nodes is one zero node.
    """

    types: list[str]
    vectors: np.ndarray
    projection: np.ndarray
    control_types: tuple[str, ...] = CONTROL_TYPES

    columns = ("_types", "_parents", "_depths", "_children")

    def sizes(self, arrays: list[pa.Array]) -> np.ndarray:
        return 3 * arrays[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")

    def features(self, arrays: list[pa.Array]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sizes, features ``[type_id, depth, child_count, is_named]`` of every node, and the edges."""
        names, parents, depths, children = arrays
        found = names.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype("i8")
        sizes = np.maximum(found, 1)
        first = _segments(sizes)
        real = np.repeat(found > 0, sizes)  # nodes that are not the stand-in of an empty graph
        place = np.flatnonzero(real)
        coded = names.flatten().dictionary_encode()
        words = coded.dictionary.to_pylist()
        code = coded.indices.to_numpy(zero_copy_only=False)
        known = {t: i for i, t in enumerate(self.types)}
        type_id = np.array([known.get(w, len(known)) for w in words], "i8")[code]
        control = np.array([w in self.control_types for w in words], bool)[code]
        named = np.array([w != UNNAMED_TYPE for w in words], bool)[code]
        x = np.zeros((len(real), 4))
        x[place] = np.stack([type_id, _flat(depths), _flat(children), named], axis=1)

        # Edges: children and parents both ways, consecutive children of a parent both ways, control nodes in their order.
        base = np.repeat(first, sizes)[place]
        parent = parents.flatten().fill_null(-1).to_numpy(zero_copy_only=False)
        child = place[parent >= 0]
        above = (parent + base)[parent >= 0]
        order = np.argsort(above, kind="stable")
        same = above[order][1:] == above[order][:-1]
        left, right = child[order][:-1][same], child[order][1:][same]
        chain, owner = place[control], base[control]
        follows = owner[1:] == owner[:-1]
        src = np.concatenate([above, child, left, right, chain[:-1][follows]])
        dst = np.concatenate([child, above, right, left, chain[1:][follows]])
        return sizes, x, src, dst

    def read(self, arrays: list[pa.Array]) -> Batch:
        sizes, x, src, dst = self.features(arrays)
        table = np.vstack([self.vectors, np.zeros((1, self.vectors.shape[1]))])
        return Batch(sizes, x @ self.projection.T + table[x[:, 0].astype("i8")], src, dst)

    def graphs(self, *columns: Column) -> Column:
        """A graph per row as a struct: ``features`` (four a node, node after node), ``src`` and ``dst`` (node numbers within it)."""

        @F.arrow_udf("struct<features:array<double>,src:array<int>,dst:array<int>>")
        def pack_up(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
            sizes, x, src, dst = self.features([a, b, c, d])
            first = _segments(sizes)
            owner = np.repeat(np.arange(len(sizes)), sizes)[src] if len(src) else src
            order = np.argsort(owner, kind="stable")
            src, dst, owner = src[order], dst[order], owner[order]
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))]).astype("i4")
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array((e - first[owner]).astype("i4"))) for e in (src, dst)]
            nodes = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(4 * sizes)]).astype("i4")), pa.array(x.ravel()))
            return pa.StructArray.from_arrays([nodes, *lists], ["features", "src", "dst"])

        return pack_up(*columns)


class TableReader:
    """Reads rows of ``pack``."""

    columns = ("nodes", "x", "src", "dst")

    def sizes(self, arrays: list[pa.Array]) -> np.ndarray:
        return (arrays[0].value_lengths().to_numpy(zero_copy_only=False) + arrays[2].value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype("i8")

    def read(self, arrays: list[pa.Array]) -> Batch:
        nodes, x, src, dst = arrays
        sizes = nodes.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
        owner = np.repeat(np.arange(len(sizes)), sizes)
        ids = _flat(nodes).astype("i8")
        # Nodes are numbered by (graph, id), an order in which they already stand.
        low = min([0, *[int(v.min()) for v in (ids, _flat(src), _flat(dst)) if len(v)]])
        span = max([0, *[int(v.max()) for v in (ids, _flat(src), _flat(dst)) if len(v)]]) - low + 1
        key = owner * span + ids - low
        of = np.repeat(np.arange(len(sizes)), src.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) * span - low
        ends = [of + _flat(e) for e in (src, dst)]
        at = [np.minimum(np.searchsorted(key, e), len(key) - 1) for e in ends]
        real = (key[at[0]] == ends[0]) & (key[at[1]] == ends[1])
        return Batch(sizes, np.concatenate([_flat(x).reshape(len(ids), -1)]), at[0][real], at[1][real])


def largest_graph(nodes: DataFrame, edges: DataFrame) -> int:
    """Nodes and edges of the largest graph, counted."""
    both = nodes.select("doc_id").unionByName(edges.select("doc_id"))
    return both.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def pack(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per graph of ``nodes(doc_id, id, x)`` and ``edges(doc_id, src, dst)``: ``doc_id, nodes, x, src, dst``.

    For graphs of bounded size (see ``largest_graph``).  Edges to nodes that are not there are left out when read.
    """
    rows = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct(F.col("id").cast("bigint").alias("id"), "x"))).alias("n"))
    links = edges.groupBy("doc_id").agg(F.collect_list(F.struct(F.col("src").cast("bigint").alias("src"), F.col("dst").cast("bigint").alias("dst"))).alias("e"))
    e = F.coalesce("e", F.array().cast("array<struct<src:bigint,dst:bigint>>"))
    return rows.join(shuffled(links), "doc_id", "left").select("doc_id", F.col("n.id").alias("nodes"), F.flatten("n.x").alias("x"), e["src"].alias("src"), e["dst"].alias("dst"))


# --- what runs over packed rows ---------------------------------------------------------------------------------


def _merge(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and sum of squared deviations of several sets of rows as one."""
    n, mean, spread = parts[0]
    for m, other, more in parts[1:]:
        total, gap = n + m, other - mean
        mean, spread, n = mean + gap * (m / total), spread + more + gap * gap * (n * m / total), total
    return n, mean, spread


_SUMMARY = "part int, n bigint, mean array<double>, spread array<double>"


def _summary(part: int, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    n, mean, spread = _merge(parts)
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), from_matrix(mean[None]), from_matrix(spread[None])], names=["part", "n", "mean", "spread"])


def _parts(table: pa.Table) -> list[tuple[int, np.ndarray, np.ndarray]]:
    return [(r["n"], np.array(r["mean"]), np.array(r["spread"])) for r in table.to_pylist()]


def layer_statistics(packed: DataFrame, reader, layers: list[Layer], frozen: list[Statistics], eps: float = EPS) -> Statistics:
    """Mean and population variance of every component of the first layer that is not ``frozen`` yet, over all nodes."""
    upto, layer = layers[: len(frozen)], layers[len(frozen)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = []
        for batch in batches:
            for part in slices(reader.sizes(batch.columns)):
                graphs = reader.read([c.slice(part.start, part.stop - part.start) for c in batch.columns])
                h = convolve(forward(graphs, upto, frozen, eps), layer, Incoming(graphs))
                own.append((len(h), h.mean(axis=0), ((h - h.mean(axis=0)) ** 2).sum(axis=0)))
            own = [_merge(own)] if own else []
        if own:
            yield _summary(TaskContext.get().partitionId() % MERGE_GROUPS, own)

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_summary(key[0].as_py(), _parts(table))])

    rows = packed.select(*reader.columns).mapInArrow(run, _SUMMARY).groupBy("part").applyInArrow(merge, _SUMMARY).toArrow()
    if not rows.num_rows:
        raise ValueError("no rows to standardize")
    n, mean, spread = _merge(_parts(rows))
    return mean, spread / n


def fit_statistics(packed: DataFrame, reader, layers: list[Layer], eps: float = EPS) -> list[Statistics]:
    """The statistics of every layer over a table: one narrow pass a layer, which goes through the layers before it again."""
    frozen: list[Statistics] = []
    for _ in layers:
        frozen.append(layer_statistics(packed, reader, layers, frozen, eps))
    return frozen


def graph_vectors(reader, layers: list[Layer], statistics: list[Statistics], eps: float = EPS) -> Callable[..., Column]:
    """Column function of the reader's columns: mean and maximum of a graph's node vectors after all layers."""

    @F.arrow_udf("array<double>")
    def pooled(a: pa.Array, b: pa.Array, c: pa.Array, d: pa.Array) -> pa.Array:
        arrays = [a, b, c, d]
        out = []
        for part in slices(reader.sizes(arrays)):
            graphs = reader.read([x.slice(part.start, part.stop - part.start) for x in arrays])
            out.append(mean_max_pool(forward(graphs, layers, statistics, eps), graphs.sizes))
        return from_matrix(np.concatenate(out)) if out else pa.array([], type=pa.list_(pa.float64()))

    return pooled


def node_vectors(packed: DataFrame, layers: list[Layer], statistics: list[Statistics] | None = None, eps: float = EPS) -> DataFrame:
    """(doc_id, id, x) after all layers of the graphs of ``pack``; without ``statistics`` those of the table itself."""
    reader = TableReader()
    if statistics is None:
        packed = checkpoint(packed)
        statistics = fit_statistics(packed, reader, layers, eps)
    kind = packed.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(reader.sizes(batch.columns[1:])):
                own = batch.slice(part.start, part.stop - part.start)
                graphs = reader.read(own.columns[1:])
                x = forward(graphs, layers, statistics, eps)
                doc = own.column(0).take(pa.array(np.repeat(np.arange(len(graphs.sizes)), graphs.sizes)))
                yield pa.RecordBatch.from_arrays([doc, own.column(1).flatten(), from_matrix(x)], names=["doc_id", "id", "x"])

    return packed.select("doc_id", *reader.columns).mapInArrow(run, f"doc_id {kind}, id bigint, x array<double>")
