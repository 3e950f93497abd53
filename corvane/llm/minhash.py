"""Near duplicates by a multi-index Hamming join of b-bit MinHash signatures.

A document's set of word shingles is signed with SYMBOLS minima, of which 16 bits each are kept.  Two signatures
within MAX_DISTANCE symbols of each other agree, by the pigeonhole principle, in one of CHUNKS chunks but for at
most one symbol; so each chunk is indexed once per allowed error, with that symbol left out.  All pairs within the
distance share a key, and pairs of 85 % similarity are beyond it with a chance of some 4 in a million.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import SMALL_SLICE_BYTES, broadcast_small, by_slices, give_back, stored
from corvane.runtime import spread_small

SHINGLE = 3
SIMILARITY = 85  # per cent
SYMBOLS, CHUNKS = 32, 8
SPAN = SYMBOLS // CHUNKS
# With more errors than this a chunk could have two in every place.
MAX_DISTANCE = 2 * CHUNKS - 1

_draw = np.random.default_rng(20240229)
_BYTE = _draw.integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_XOR = _draw.integers(0, 1 << 63, SYMBOLS, dtype="u8")
_MUL = _draw.integers(0, 1 << 63, SYMBOLS, dtype="u8") | np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_POWERS = np.cumprod(np.full(1 << 12, _BASE, "u8"))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(k: np.ndarray) -> np.ndarray:
    """Powers of the base by place in a word; words longer than the table multiply two entries."""
    low = _POWERS[k & 0xFFF]
    if len(k) and k.max() >= len(_POWERS):
        high = np.array([pow(int(_POWERS[-1]), int(e), 1 << 64) for e in range(int(k.max()) // len(_POWERS) + 1)], "u8")
        low = low * high[k >> 12]
    return low


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every lower-cased word, and where each text's words start (with the end)."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | first[1:-1]
    start = np.flatnonzero(begin)
    if not len(start):
        return np.empty(0, "u8"), np.zeros(len(offsets), "i8")
    at = np.flatnonzero(inside)
    place = np.searchsorted(at, start)
    size = np.diff(np.append(place, len(at)))
    within = np.arange(len(at)) - np.repeat(place, size)
    return _mix(np.add.reduceat(_BYTE[_LOWER[data[at]]] * _power(within), place)), np.searchsorted(start, offsets)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of every text; fewer words than a shingle are one; no words, none."""
    hashes, at = word_hashes(data, offsets)
    out = []
    tag = np.uint64(0x1234567)
    wide = hashes * np.uint64(3)
    if len(hashes) >= SHINGLE:
        wide = _mix((hashes[:-2] * _BASE) ^ _mix(hashes[1:-1] + tag) * np.uint64(7) + hashes[2:] * np.uint64(0x2545F4914F6CDD1D))
    for a, b in zip(at.tolist(), at[1:].tolist()):
        if b - a >= SHINGLE:
            out.append(np.unique(wide[a : b - SHINGLE + 1]))
        elif b > a:
            out.append(_mix(np.array([int(sum(int(h) * (5 + 2 * k) for k, h in enumerate(hashes[a:b])) + (b - a)) & ((1 << 64) - 1)], "u8")))
        else:
            out.append(np.empty(0, "u8"))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, SYMBOLS) 16-bit symbols; empty sets give zeros."""
    sizes = np.array([len(s) for s in sets])
    out = np.zeros((len(sets), SYMBOLS), "u2")
    some = np.flatnonzero(sizes)
    if len(some):
        flat = np.concatenate([sets[k] for k in some])
        starts = np.cumsum(sizes[some]) - sizes[some]
        for j in range(SYMBOLS):
            out[some, j] = np.minimum.reduceat((flat ^ _XOR[j]) * _MUL[j], starts).astype("u2")
    return out


def chunk_keys(signature: np.ndarray) -> np.ndarray:
    """(n, CHUNKS * SPAN) keys: each chunk with one symbol left out, hashed with which."""
    chunks = signature.reshape(len(signature), CHUNKS, SPAN).astype("u8")
    keys = []
    for c in range(CHUNKS):
        for gone in range(SPAN):
            value = np.full(len(signature), c * SPAN + gone + 1, "u8")
            for s in range(SPAN):
                if s != gone:
                    value = _mix(value * _BASE + chunks[:, c, s])
            keys.append(value)
    return np.stack(keys, 1)


# Members of one key that are compared pair by pair; more are taken together unseen, and told apart later.
RUN = 4096
# Shingle sets that are compared in one task; more are dealt over pairs of blocks.
BLOCK_BYTES = 24 << 20
_NO_ID = (1 << 63) - 1


class Forest:
    """Union-find over places 0 to n - 1; the root is the lowest place.  Knows the root of the largest tree."""

    def __init__(self, n: int):
        self.up, self.size, self.largest = list(range(n)), [1] * n, -1

    def root(self, k: int) -> int:
        up = self.up
        while up[k] != k:
            up[k] = up[up[k]]
            k = up[k]
        return k

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        low, high = min(a, b), max(a, b)
        self.up[high] = low
        self.size[low] += self.size[high]
        if self.largest in (-1, high) or self.size[low] > self.size[self.largest]:
            self.largest = low
        return True


def _digest(shingles: bytes) -> bytes:
    return hashlib.sha256(shingles).digest()[:16]


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    return docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), text, *more)


def signed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: ``row, id, n_shingles, class`` (digest of the set), ``sig``; stored, since rows are named here."""
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    rows = _rows(docs, id_col, text_col, row.alias("row")).select("row", "id", "text")

    def sign(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        sets = shingle_sets(data, offsets)
        sig = signatures(sets)
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                part.column(1),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array([s.tobytes() for s in sig], pa.binary()),
            ],
            names=["row", "id", "n_shingles", "class", "sig"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_slices(sign, batches, SMALL_SLICE_BYTES)

    return stored(spread_small(rows).mapInArrow(run, "row bigint, id bigint, n_shingles bigint, class binary, sig binary"), "signed")


def classes(rows: DataFrame) -> DataFrame:
    """Distinct non-empty sets: ``node`` (the smallest row of the smallest id), ``id``, ``n_shingles, class, sig``."""
    best = F.min(F.struct("id", "row")).alias("best")
    out = rows.where(F.col("n_shingles") > 0).groupBy("class").agg(best, F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    return out.select(F.col("best.row").alias("node"), F.col("best.id").alias("id"), "n_shingles", "class", "sig")


def hamming_edges(nodes: DataFrame) -> DataFrame:
    """``a, b`` that connect all nodes within MAX_DISTANCE of each other (a spanning forest of each key's members).

    Keys with more than RUN members connect them all, near or not.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), "u2").reshape(-1, SYMBOLS)
            keys = chunk_keys(sig).view("i8")
            small = sig.astype("u1")
            for c in range(CHUNKS):
                part = keys[:, c * SPAN : (c + 1) * SPAN].ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part), pa.array(np.repeat(batch.column(0).to_numpy(), SPAN)), pa.array([s for row in small for s in [row.tobytes()] * SPAN], pa.binary())],
                    names=["key", "node", "sig"],
                )
        batch = sig = keys = small = None
        give_back()

    def near(nodes: np.ndarray, sig: np.ndarray) -> Iterator[tuple[int, int]]:
        order = np.argsort(nodes)
        nodes, sig = nodes[order], sig[order]
        if len(nodes) > RUN:
            yield from ((int(nodes[0]), int(x)) for x in nodes[1:])
            return
        forest = Forest(len(nodes))
        for k in range(len(nodes) - 1):
            close = np.flatnonzero((sig[k + 1 :] != sig[k]).sum(1) <= MAX_DISTANCE)
            for j in close.tolist():
                if forest.join(k, k + 1 + j):
                    yield int(nodes[k]), int(nodes[k + 1 + j])

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key; a run of equal keys may go over batches."""
        held: list[pa.RecordBatch] = []

        def edges(table: pa.Table) -> list[tuple[int, int]]:
            key = table.column("key").to_numpy()
            cut = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
            size = np.diff(np.append(cut, len(key)))
            out: set[tuple[int, int]] = set()
            node = table.column("node").to_numpy()
            for k, n in zip(cut[size > 1].tolist(), size[size > 1].tolist()):
                sig = np.frombuffer(b"".join(table.column("sig").slice(k, n).to_pylist()), "u1").reshape(n, SYMBOLS)
                out.update(near(node[k : k + n], sig))
            return sorted(out)

        def emit(table: pa.Table) -> Iterator[pa.RecordBatch]:
            found = edges(table)
            if found:
                a, b = zip(*found)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            last = int(np.searchsorted(key, key[-1])) if key[0] <= key[-1] else 0
            if last == 0 and held and held[-1].column(0)[-1].as_py() == int(key[0]):
                held.append(batch)
                continue
            yield from emit(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = [batch.slice(last)]
        if held:
            yield from emit(pa.Table.from_batches(held))
        batch = key = None
        held.clear()
        give_back()

    rows = nodes.select("node", "sig").mapInArrow(keyed, "key bigint, node bigint, sig binary")
    rows = rows.repartition(F.col("key")).sortWithinPartitions("key")
    return rows.mapInArrow(runs, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) of every node in ``a, b``, by large-star and small-star rounds."""
    edges = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "edges")
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        edges = stored(small.where(F.col("a") != F.col("b")).distinct(), "edges")
    least = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return least.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def links(names: np.ndarray, sets: list[np.ndarray], first: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links among ``sets``; with two blocks (``first`` says which) only of links across.

    Whole sets are compared.  One document's intersections with all others come from inverted lists.  Members of the
    largest component wait: all pairs but those inside it are seen from the other side.  Those that turn out to
    belong to another one, when a larger has come up, are looked at after all.
    """
    n, sizes = len(sets), np.array([len(s) for s in sets])
    forest, out = Forest(n), []
    across = not first.all()
    owner = np.repeat(np.arange(n), sizes)
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    begin = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
    length = np.diff(np.append(begin, len(flat)))
    shared = length > 1
    begin, length = begin[shared], length[shared]
    lists = np.repeat(np.arange(len(begin)), length)
    members = owner[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())]
    starts = np.cumsum(length) - length
    by_doc = np.argsort(members, kind="stable")
    doc_lists, doc_at = lists[by_doc], np.searchsorted(members[by_doc], np.arange(n + 1))
    weight = np.bincount(lists, minlength=len(length)) if len(length) else np.empty(0)
    typical = np.bincount(members, weight[lists] if len(lists) else None, n) if len(members) else np.zeros(n)
    open_ = [k for k in np.argsort(-typical, kind="stable").tolist() if typical[k]]
    while open_:
        waiting = []
        for k in open_:
            if not across and forest.root(k) == forest.largest:
                waiting.append(k)
                continue
            own = doc_lists[doc_at[k] : doc_at[k + 1]]
            size = length[own]
            near = members[np.repeat(starts[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            both = np.bincount(near, minlength=n)
            hit = 100 * both >= SIMILARITY * (sizes[k] + sizes - both)
            hit[k] = False
            if across:
                hit &= first != first[k]
            for j in np.flatnonzero(hit).tolist():
                if forest.join(k, j):
                    out.append((int(names[k]), int(names[j])))
        open_ = waiting if any(forest.root(k) != forest.largest for k in waiting) else []
    return out


def verified_links(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """``a, b``: links among nodes of one group, confirmed on whole sets.

    ``docs`` has ``id, text``; ``groups`` has ``node, id, class, component, n_shingles``.  Sets are made again from the
    texts of the nodes' ids.  A group whose sets exceed BLOCK_BYTES is dealt over pairs of its blocks, each
    compared in a task of its own.
    """
    sizes = groups.groupBy("component").agg(F.ceil(F.sum("n_shingles") * 8 / BLOCK_BYTES).cast("int").alias("n_blocks"))
    block = F.pmod(F.xxhash64("node"), F.col("n_blocks").cast("bigint")).cast("int").alias("block")
    members = stored(groups.join(sizes, "component").select("node", "id", "class", "component", block, "n_blocks"), "members")
    rows = docs.join(broadcast_small(members.select("id").distinct()), "id", "left_semi").select("id", "text")

    def sets_of(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        sets = [s.tobytes() for s in shingle_sets(data, offsets)]
        return pa.RecordBatch.from_arrays([pa.array([_digest(s) for s in sets], pa.binary()), pa.array(sets, pa.binary())], names=["class", "set"])

    def with_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_slices(sets_of, batches, SMALL_SLICE_BYTES)

    rows = rows.mapInArrow(with_sets, "class binary, set binary")
    rows = rows.join(broadcast_small(members.drop("id")), "class")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.drop_duplicates("node")  # rows that repeat an id
        sets = [np.frombuffer(s, "u8") for s in frame["set"]]
        found = links(frame["node"].to_numpy(), sets, (frame["block"] == frame["low"]).to_numpy()) if len(sets) > 1 else []
        return pd.DataFrame(found, columns=["a", "b"], dtype="i8")

    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other")
    rows = rows.select("node", "component", "block", "set", other).withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other"))
    return rows.groupBy("component", "low", "high").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Documents are linked when their sets of three-word shingles overlap by 85 % of their union.  A document
    without words (or null) has no shingles and is its own component.  Rows that repeat an id share its component;
    of equal rows the first is kept.  A null id comes after all others and is null in the result.  ``row_col`` names
    a bigint that tells the rows apart; it is returned as ``row``.
    """
    rows = signed(docs, id_col, text_col, row_col)
    nodes = stored(classes(rows), "nodes")
    coarse = components(hamming_edges(nodes)).join(nodes.select("node", "id", "class", "n_shingles"), "node")
    linked = components(verified_links(_rows(docs, id_col, text_col), stored(coarse, "coarse")))
    named = stored(nodes.select("node", "id", "class").join(linked, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    # The smallest id of a component, and the row that bears it.
    best = named.groupBy("component").agg(F.min(F.struct("id", "node")).alias("best"))
    by_class = named.join(best, "component").select("class", F.col("best.id").alias("best_id"), F.col("best.node").alias("best_row"))
    alone = F.col("n_shingles") == 0
    out = rows.join(by_class, "class", "left")
    component = F.when(alone, F.col("id")).otherwise(F.col("best_id"))
    return out.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        "n_shingles",
        F.when(component != _NO_ID, component).alias("component_id"),
        (alone | (F.col("row") == F.col("best_row"))).alias("kept"),
        *(["row"] if row_col else []),
    )
