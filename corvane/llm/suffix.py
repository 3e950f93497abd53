"""Removal of passages that documents share, by merging Burrows-Wheeler transforms.

1. Every 50-byte string is named by the least hash among its 20-byte substrings (its anchor), so equal strings have
   equal anchors.  Anchors that only one text has cannot repeat anything and are dropped.
2. What is left of a text are segments: runs of 50-byte strings with one anchor.  Distinct segments of a slice of
   documents, with the smallest id that has them, are dealt by anchor.
3. In a bucket the segments form shards, and each shard has its own transform.  The transforms are merged by
   refining their interleave one symbol at a time: stepping every row to the suffix one symbol longer, in the order so
   far, stably by that symbol, gives the order by one symbol more, and where two neighbours part is their common
   prefix.  Only rows that reach 50 symbols are stepped, and those alone in their block leave.  After 50 steps the
   blocks that never parted are the repeated intervals; no suffix was sorted again.
4. The least id of an interval goes back to the slices, which compare it with their documents' ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import broadcast_small, byte_slices, stored
from corvane.runtime import spread_small

LENGTH = 50  # bytes of a string that counts
GRAM = 20  # bytes of an anchor
WINDOW = LENGTH - GRAM + 1
SLICE = 4 << 20
ANCHORS_PER_BUCKET = 3_000_000
# Slices and buckets both grow with the data, and a bucket gets a row from nearly every slice: buckets are as large as memory allows.
SEGMENT_BYTES_PER_BUCKET = 4 << 20
# A bucket beyond this has an anchor with very many contexts; its strings are dealt one by one, by their own hash.
HEAVY_BYTES = 64 << 20
SHARD_SEGMENTS = 8_192
# After so many steps of a merge each, rows that are alone in their block leave it.
LONE_STEPS = 5
_FP = 5  # bytes kept of an anchor while looking for repeated ones
_NO_ID = (1 << 63) - 1

_BYTE = np.random.default_rng(77).integers(1, 1 << 63, 256, dtype="u8") | np.uint64(1)
_MUL = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` bytes from each place on, put together from hashes of powers of two."""
    part, have, out, done = _BYTE[data], 1, None, 0
    while size:
        if size & 1:
            if out is None:
                out, done = part, have
            else:
                n = len(data) - (done + have) + 1
                out = (out[:n] * _MUL) ^ (part[done : done + n] + np.uint64(have))
                out ^= out >> np.uint64(29)
                done += have
        size >>= 1
        if size:
            n = len(data) - 2 * have + 1
            part = (part[:n] * _MUL) ^ part[have : have + n]
            part ^= part >> np.uint64(31)
            have *= 2
    return out * _MUL


def least(values: np.ndarray, window: int) -> np.ndarray:
    """Minimum of every ``window`` values in a row."""
    have = 1
    while 2 * have <= window:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    more = window - have
    return np.minimum(values[:-more], values[more:]) if more else values


def anchor_runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: first string, number of strings (at most WINDOW), anchor, text."""
    none = np.empty(0, "i8")
    if len(data) < LENGTH:
        return none, none, none.astype("u8"), none
    anchors = least(gram_hashes(data, GRAM), WINDOW)
    lengths = np.diff(offsets)
    inside = np.zeros(len(data) + 1, "i1")
    long = lengths >= LENGTH
    np.add.at(inside, offsets[:-1][long], 1)
    np.add.at(inside, offsets[1:][long] - LENGTH + 1, -1)
    at = np.flatnonzero(np.cumsum(inside[: len(anchors)], dtype="i1"))
    if not len(at):
        return none, none, none.astype("u8"), none
    value = anchors[at]
    begin = np.append(True, (value[1:] != value[:-1]) | (np.diff(at) > 1))
    begin[np.searchsorted(at, offsets[:-1][long])] = True
    first = np.flatnonzero(begin)
    # Long runs (a text that repeats itself) are cut.
    count = np.diff(np.append(first, len(at)))
    pieces = -(-count // WINDOW)
    k = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    start = np.repeat(first, pieces) + k * WINDOW
    count = np.minimum(WINDOW, np.repeat(first + count, pieces) - start)
    start_at = at[start]
    return start_at, count, value[start], np.searchsorted(offsets, start_at, "right") - 1


def _digests(data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    raw, ends = memoryview(data.tobytes()), offsets.tolist()
    return [hashlib.sha256(raw[a:b]).digest() for a, b in zip(ends, ends[1:])]


def _fingerprints(anchors: np.ndarray) -> np.ndarray:
    return anchors >> np.uint64(64 - 8 * _FP)


def _pack(fp: np.ndarray) -> bytes:
    return np.ascontiguousarray(fp.astype("<u8").view("u1").reshape(-1, 8)[:, :_FP]).tobytes()


def _unpack(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // _FP, 8), "u1")
    out[:, :_FP] = np.frombuffer(raw, "u1").reshape(-1, _FP)
    return out.view("<u8").ravel()


def repeated_anchors(texts: DataFrame, n_buckets: int) -> DataFrame:
    """``digest, fps``: the anchors of each text that another text has too.

    Texts travel packed by slice, to the buckets and back, so there is a row per slice and bucket, not per text.
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in byte_slices(batch, most=SLICE):
                _, _, anchor, text = anchor_runs(data, offsets)
                if not len(anchor):
                    continue
                raw = b"".join(_digests(data, offsets))
                digests, name = np.frombuffer(raw, "V32"), hashlib.sha256(raw).digest()
                bucket = (anchor & np.uint64(0xFFFFFF)) % np.uint64(n_buckets)
                fp = _fingerprints(anchor)
                order = np.lexsort((fp, text, bucket))
                bucket, fp, text = bucket[order], fp[order], text[order]
                new = np.append(True, (np.diff(bucket) != 0) | (np.diff(text) != 0) | (fp[1:] != fp[:-1]))
                bucket, fp, text = bucket[new], fp[new], text[new]
                cut = np.flatnonzero(np.append(True, np.diff(bucket) != 0)).tolist()
                rows = []
                for a, b in zip(cut, [*cut[1:], len(bucket)]):
                    own = np.flatnonzero(np.append(True, np.diff(text[a:b]) != 0))
                    rows.append((int(bucket[a]), name, digests[text[a:b][own]].tobytes(), np.diff(np.append(own, b - a)).astype("u4").tobytes(), _pack(fp[a:b])))
                columns = list(zip(*rows))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "slice", "digests", "counts", "fps"]
                )

    def shared(frame: pd.DataFrame) -> pd.DataFrame:
        digests = np.frombuffer(b"".join(frame["digests"]), "u1").reshape(-1, 32)
        counts = np.frombuffer(b"".join(frame["counts"]), "u4").astype("i8")
        fp = _unpack(b"".join(frame["fps"]))
        who = np.repeat(np.ascontiguousarray(digests[:, :8]).view("u8").ravel(), counts)
        order = np.argsort(fp)
        begin = np.flatnonzero(np.append(True, np.diff(fp[order]) != 0))
        lone = np.minimum.reduceat(who[order], begin) == np.maximum.reduceat(who[order], begin)
        keep = np.empty(len(fp), bool)
        keep[order] = ~np.repeat(lone, np.diff(np.append(begin, len(fp))))
        kept = np.add.reduceat(keep, np.cumsum(counts) - counts, dtype="i8")
        raw = _pack(fp[keep])
        text_at = np.append(0, np.cumsum([len(c) // 4 for c in frame["counts"]]))
        byte_at = (np.append(0, np.cumsum(kept))[text_at] * _FP).tolist()
        rows = list(zip(frame["slice"], text_at.tolist(), text_at[1:].tolist(), byte_at, byte_at[1:]))
        out = [(name, digests[a:b].tobytes(), kept[a:b].astype("u4").tobytes(), raw[i:j]) for name, a, b, i, j in rows if j > i]
        return pd.DataFrame(out, columns=["slice", "digests", "counts", "fps"])

    def by_text(frame: pd.DataFrame) -> pd.DataFrame:
        held: dict[bytes, list[bytes]] = {}
        for digests, counts, fps in zip(frame["digests"], frame["counts"], frame["fps"]):
            at = 0
            for k, n in enumerate(np.frombuffer(counts, "u4").tolist()):
                if n:
                    held.setdefault(digests[32 * k : 32 * k + 32], []).append(fps[at : at + _FP * n])
                    at += _FP * n
        return pd.DataFrame({"digest": list(held), "fps": [b"".join(v) for v in held.values()]})

    rows = texts.select("text").mapInArrow(deal, "bucket int, slice binary, digests binary, counts binary, fps binary")
    rows = rows.groupBy("bucket").applyInPandas(shared, "slice binary, digests binary, counts binary, fps binary")
    return rows.groupBy("slice").applyInPandas(by_text, "digest binary, fps binary")


_SLICES = "slice string, digests binary, ids binary, n_bytes bigint, segments binary, lengths binary, anchors binary, least_ids binary, occ_text binary, occ_at binary, occ_segment binary"


def segments(rows: DataFrame) -> DataFrame:
    """Per slice of texts (``id, digest, text, fps``): its distinct segments, and where they occur."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in byte_slices(batch, "text", SLICE):
                first, count, anchor, text = anchor_runs(data, offsets)
                lists = part.column(3).to_pylist()
                wanted = _unpack(b"".join(lists)) | (np.repeat(np.arange(len(lists)), [len(x) // _FP for x in lists]).astype("u8") << np.uint64(8 * _FP))
                hit = np.isin(_fingerprints(anchor) | (text.astype("u8") << np.uint64(8 * _FP)), wanted)
                first, count, anchor, text = first[hit], count[hit], anchor[hit], text[hit]
                if not len(first):
                    continue
                size = count + LENGTH - 1
                ends = np.cumsum(size)
                raw = data[np.repeat(first - (ends - size), size) + np.arange(ends[-1])]
                whole = pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.append(0, ends)), pa.py_buffer(raw)]).dictionary_encode()
                index = whole.indices.to_numpy()
                ids = part.column(0).to_numpy()
                order = np.argsort(index, kind="stable")
                begin = np.flatnonzero(np.append(True, np.diff(index[order]) != 0))
                distinct = whole.dictionary
                digests = b"".join(part.column(1).to_pylist())
                columns = [
                    hashlib.sha256(digests).hexdigest(),
                    digests,
                    ids.tobytes(),
                    int(size[order[begin]].sum()),
                    b"".join(_list(distinct)),
                    size[order[begin]].astype("u1").tobytes(),
                    anchor[order[begin]].tobytes(),
                    np.minimum.reduceat(ids[text][order], begin).tobytes(),
                    text.astype("u4").tobytes(),
                    (first - offsets[text]).astype("u4").tobytes(),
                    index.astype("u4").tobytes(),
                ]
                kinds = [pa.string(), pa.binary(), pa.binary(), pa.int64(), *[pa.binary()] * 7]
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _SLICES.split(", ")])

    return rows.select("id", "digest", "text", "fps").mapInArrow(cut, _SLICES)


def _list(array: pa.LargeBinaryArray) -> list[bytes]:
    ends = np.frombuffer(array.buffers()[1], "i8")[array.offset : array.offset + len(array) + 1].tolist()
    data = (array.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


def shard_transform(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Transform of segments (bytes plus 1, each ended by 0): last symbols, whether a row starts a segment, the row one symbol to the left, and the rows' places.

    Suffixes are ordered by their first 56 symbols, more than a merge looks at.
    """
    n = len(symbols)
    left = np.diff(np.flatnonzero(np.append(symbols == 0, True)), prepend=-1)[:-1] if n else np.empty(0, "i8")
    stop = np.repeat(np.cumsum(left) - 1, left)  # place of the segment's end
    place = np.arange(n)
    padded = np.append(symbols, np.zeros(8, symbols.dtype)).astype("u8")
    key = np.zeros(n, "u8")
    for k in range(7):
        key = (key << np.uint64(9)) | np.where(place + k <= stop, padded[k : k + n], np.uint64(0))
    order = np.argsort(key)
    key = key[order]
    head = np.append(True, key[1:] != key[:-1])
    rank = np.empty(n, "i8")  # where the suffix's group of equals begins
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    tied, reach = np.flatnonzero(~(head & np.append(head[1:], True))), 7
    # Only suffixes that are not told apart yet are ordered again, within the places of their group.
    while len(tied) and reach < LENGTH:
        own = order[tied]
        beyond = np.minimum(own + reach, n - 1)
        key = (rank[own].astype("u8") << np.uint64(32)) | np.where(own + reach <= stop[own], rank[beyond] + 1, 0).astype("u8")
        again = np.argsort(key)
        key, own = key[again], own[again]
        order[tied] = own
        head = np.append(True, key[1:] != key[:-1])
        rank[own] = np.maximum.accumulate(np.where(head, tied, 0))
        tied = tied[~(head & np.append(head[1:], True))]
        reach *= 2
    row = np.empty(n, "i4")
    row[order] = np.arange(n, dtype="i4")
    starts = np.append(True, symbols[:-1] == 0)[order]
    before = np.maximum(order - 1, 0)
    return np.where(starts, 0, symbols[before].astype("i4") - 1).astype("u1"), starts, row[before], order


def repeated_intervals(data: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id of every string of every segment: the least ``ids`` entry among the segments that contain it.

    Strings in order of segments and places.
    """
    strings = sizes - LENGTH + 1
    base_of = np.cumsum(strings) - strings
    out = np.repeat(ids, strings)  # right for what no other segment has
    ends = np.cumsum(sizes)
    last, step, owner, offset, base = [], [], [], [], 0
    for a in range(0, len(sizes), SHARD_SEGMENTS):
        own = sizes[a : a + SHARD_SEGMENTS]
        raw = data[ends[a] - sizes[a] : ends[a + len(own) - 1]]
        symbols = np.zeros(len(raw) + len(own), "u2")
        text_of = np.repeat(np.arange(len(own)), own)
        symbols[np.arange(len(raw)) + text_of] = raw.astype("u2") + 1
        bwt, _, left, order = shard_transform(symbols)
        last.append(bwt)
        step.append(left + np.int32(base))
        segment = np.repeat(np.arange(len(own), dtype="i4"), own + 1)
        begin = (np.cumsum(own + 1) - (own + 1)).astype("i4")
        owner.append(np.int32(a) + segment[order])
        offset.append((order - begin[segment[order]]).astype("u1"))
        base += len(symbols)
    last, step, owner, offset = (np.concatenate(x) for x in (last, step, owner, offset))
    # The interleave: rows that have LENGTH symbols to their left, at first told apart by nothing, in the order of their shards.
    # Others run out of symbols before they are strings, and part no two rows.
    rows = np.flatnonzero(offset >= LENGTH).astype("i4")
    block = np.zeros(len(rows), "i4")
    for k in range(1, LENGTH + 1):
        symbol = last[rows]
        order = np.argsort(symbol, kind="stable")
        symbol, block, rows = symbol[order], block[order], step[rows[order]]
        new = np.append(True, (symbol[1:] != symbol[:-1]) | (block[1:] != block[:-1]))
        if k % LONE_STEPS == 0:
            # A row alone in its block stays so: its string has the id of its own segment.
            shared = ~(new & np.append(new[1:], True))
            rows, new = rows[shared], new[shared]
            if not len(rows):
                return out
        block = np.cumsum(new, dtype="i4")
    begin = np.flatnonzero(new)
    low = np.repeat(np.minimum.reduceat(ids[owner[rows]], begin), np.diff(np.append(begin, len(rows))))
    out[base_of[owner[rows]] + offset[rows]] = low
    return out


_DEALT = "bucket bigint, slice string, which binary, segments binary, lengths binary, least_ids binary, from_at binary"
_FOUND = "slice string, which binary, begins binary, ends binary, least_ids binary"


def _segment_rows(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for name, raw, sizes, anchors, ids in zip(*(batch.column(k).to_pylist() for k in range(5))):
        yield name, np.frombuffer(raw, "u1"), np.frombuffer(sizes, "u1").astype("i8"), np.frombuffer(anchors, "u8"), np.frombuffer(ids, "i8")


def deal(slices: DataFrame) -> DataFrame:
    """Segments of all slices by bucket of their anchor; those of heavy buckets as single strings by their own hash."""
    total = slices.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(1, -(-total // SEGMENT_BYTES_PER_BUCKET))
    bucket_of = lambda anchors: (anchors % np.uint64(n_buckets)).astype("i8")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, anchors in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, at = np.unique(bucket_of(np.frombuffer(anchors, "u8")), return_inverse=True)
                weight = np.bincount(at, np.frombuffer(sizes, "u1")).astype("i8")
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(weight)], names=["bucket", "bytes"])

    weights = slices.select("lengths", "anchors").mapInArrow(weigh, "bucket bigint, bytes bigint").groupBy("bucket").agg(F.sum("bytes").alias("bytes"))
    # At most one in HEAVY_BYTES of the data; few even where there are many buckets.
    heavy = np.array([r[0] for r in weights.where(F.col("bytes") > HEAVY_BYTES).select("bucket").collect()], "i8")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw, sizes, anchors, ids in _segment_rows(batch):
                bucket, which, at = bucket_of(anchors), np.arange(len(sizes)), np.zeros(len(sizes), "i8")
                first = np.cumsum(sizes) - sizes
                big = np.isin(bucket, heavy)
                if big.any():
                    strings = np.where(big, sizes - LENGTH + 1, 1)
                    k = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
                    which, single = np.repeat(which, strings), np.repeat(big, strings)
                    own = gram_hashes(raw, LENGTH)
                    first, at = first[which] + k, k
                    sizes, ids = np.where(single, LENGTH, sizes[which]), ids[which]
                    bucket = np.where(single, n_buckets + (own[first] >> np.uint64(2)).astype("i8") % (n_buckets * WINDOW), bucket[which])
                order = np.argsort(bucket, kind="stable")
                cut = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)).tolist()
                out = []
                for a, b in zip(cut, [*cut[1:], len(order)]):
                    own = order[a:b]
                    size = sizes[own]
                    ends = np.cumsum(size)
                    take = np.repeat(first[own] - (ends - size), size) + np.arange(ends[-1])
                    out.append((int(bucket[own[0]]), name, which[own].astype("u4").tobytes(), raw[take].tobytes(), size.astype("u1").tobytes(), ids[own].tobytes(), at[own].astype("u1").tobytes()))
                columns = list(zip(*out))
                kinds = [pa.int64(), pa.string(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[x.split()[0] for x in _DEALT.split(", ")])

    return slices.select("slice", "segments", "lengths", "anchors", "least_ids").mapInArrow(split, _DEALT)


def merge(dealt: DataFrame) -> DataFrame:
    """Per slice and bucket: runs of strings of its segments, and the least id that has them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        data = np.frombuffer(b"".join(frame["segments"]), "u1")
        sizes = np.frombuffer(b"".join(frame["lengths"]), "u1").astype("i8")
        ids = np.frombuffer(b"".join(frame["least_ids"]), "i8")
        from_at = np.frombuffer(b"".join(frame["from_at"]), "u1").astype("i8")
        which = np.frombuffer(b"".join(frame["which"]), "u4")
        counts = np.array([len(x) for x in frame["lengths"]])
        encoded = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.append(0, np.cumsum(sizes))), pa.py_buffer(data)]).dictionary_encode()
        index = encoded.indices.to_numpy()
        order = np.argsort(index, kind="stable")
        begin = np.flatnonzero(np.append(True, np.diff(index[order]) != 0))
        distinct_sizes = sizes[order[begin]]
        raw = np.frombuffer(b"".join(_list(encoded.dictionary)), "u1")
        low = repeated_intervals(raw, distinct_sizes, np.minimum.reduceat(ids[order], begin))
        # Runs of one least id within a distinct segment, then those of every segment that came.
        strings = distinct_sizes - LENGTH + 1
        segment = np.repeat(np.arange(len(strings)), strings)
        start = np.flatnonzero(np.append(True, (segment[1:] != segment[:-1]) | (low[1:] != low[:-1])))
        stop = np.append(start[1:], len(low))
        base = np.cumsum(strings) - strings
        run_of = segment[start]
        first_run = np.searchsorted(run_of, np.arange(len(strings) + 1))
        n_runs = np.diff(first_run)[index]
        ends = np.cumsum(n_runs)
        runs = np.repeat(first_run[index] - (ends - n_runs), n_runs) + np.arange(ends[-1])
        came = np.repeat(np.arange(len(index)), n_runs)
        shift = from_at[came] - base[run_of[runs]]
        at = np.append(0, ends)[np.append(0, np.cumsum(counts))].tolist()
        pieces = [which[came].astype("u4"), (start[runs] + shift).astype("u1"), (stop[runs] + shift).astype("u1"), low[start[runs]]]
        return pd.DataFrame({"slice": frame["slice"], **{n: [p[a:b].tobytes() for a, b in zip(at, at[1:])] for n, p in zip(("which", "begins", "ends", "least_ids"), pieces)}})

    return dealt.groupBy("bucket").applyInPandas(run, _FOUND)


def _union(text: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs covered by intervals, text by text."""
    order = np.lexsort((start, text))
    text, start, stop = text[order], start[order], stop[order]
    wide = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + text * wide) - text * wide
    begin = np.append(True, (text[1:] != text[:-1]) | (start[1:] > reach[:-1]))
    first = np.flatnonzero(begin)
    return text[first], start[first], reach[np.append(first[1:], len(text)) - 1]


def covered(slices: DataFrame, found: DataFrame) -> DataFrame:
    """``digest, id, begins, ends``: the bytes of each text that a text with a smaller id has in 50-byte strings."""

    def run(own: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        names = ["digest", "id", "begins", "ends"]
        if not len(own) or not len(runs):
            return pd.DataFrame(columns=names)
        row = own.iloc[0]
        ids, digests = np.frombuffer(row["ids"], "i8"), row["digests"]
        text, at, segment = (np.frombuffer(row[c], "u4").astype("i8") for c in ("occ_text", "occ_at", "occ_segment"))
        which, begin, end, low = (np.frombuffer(b"".join(runs[c]), k) for c, k in (("which", "u4"), ("begins", "u1"), ("ends", "u1"), ("least_ids", "i8")))
        order = np.argsort(which, kind="stable")
        which, begin, end, low = which[order], begin[order].astype("i8"), end[order].astype("i8"), low[order]
        first, last = np.searchsorted(which, segment), np.searchsorted(which, segment, "right")
        count = last - first
        ends = np.cumsum(count)
        runs_of = np.repeat(first - (ends - count), count) + np.arange(ends[-1])
        occ = np.repeat(np.arange(len(segment)), count)
        less = low[runs_of] < ids[text[occ]]
        runs_of, occ = runs_of[less], occ[less]
        if not len(occ):
            return pd.DataFrame(columns=names)
        of, a, b = _union(text[occ], at[occ] + begin[runs_of], at[occ] + end[runs_of] + LENGTH - 1)
        cut = np.flatnonzero(np.append(True, of[1:] != of[:-1])).tolist()
        out = []
        for i, j in zip(cut, [*cut[1:], len(of)]):
            k = int(of[i])
            out.append((digests[32 * k : 32 * k + 32], int(ids[k]), a[i:j].astype("i8").tobytes(), b[i:j].astype("i8").tobytes()))
        return pd.DataFrame(out, columns=names)

    own = slices.select("slice", "digests", "ids", "occ_text", "occ_at", "occ_segment")
    return own.groupBy("slice").cogroup(found.groupBy("slice")).applyInPandas(run, "digest binary, id bigint, begins binary, ends binary")


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def remove_shared_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Per row of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    Null and empty texts have no bytes; texts of less than 50 bytes lose none; a whole copy of a text with a
    smaller id goes whole; rows that repeat an id do not take from each other; a null id comes after all others.
    With ``with_text`` the last column is ``kept`` (binary) of every text that lost something, else null.
    """
    texts = spread_small(docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(_NO_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    rows = stored(texts.select("id", _digest(F.col("text")).alias("digest"), F.octet_length("text").cast("bigint").alias("n_bytes")), "digests")
    owners = rows.where(F.col("n_bytes") >= LENGTH).groupBy("digest").agg(F.min("id").alias("owner"))
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    n_buckets = max(1, -(-total // (WINDOW // 2 * ANCHORS_PER_BUCKET)))
    some = repeated_anchors(texts, n_buckets).groupBy("digest").agg(F.first("fps").alias("fps"))  # the same for all copies
    some = stored(some.join(owners, "digest").select(F.col("owner").alias("id"), "digest", "fps"), "anchors")
    slices = stored(segments(texts.join(some, "id").where(_digest(F.col("text")) == F.col("digest"))), "segments")
    found = stored(covered(slices, merge(deal(slices))), "covered").dropDuplicates(["digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in byte_slices(batch, "text", SLICE):
                out = []
                for k, (begins, ends) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    a, b = np.frombuffer(begins, "i8"), np.frombuffer(ends, "i8")
                    own = data[offsets[k] : offsets[k + 1]]
                    gone = np.zeros(len(own) + 1, "i4")
                    gone[a] += 1
                    gone[b] -= 1
                    kept = own[np.cumsum(gone[:-1]) == 0].tobytes()
                    out.append((int((b - a).sum()), len(a), hashlib.sha256(kept).hexdigest(), kept if with_text else None))
                removed, spans, digests, kept = zip(*out)
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests), pa.array(kept, pa.binary())],
                    names=["digest", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    part = texts.join(broadcast_small(found), "id").where(_digest(F.col("text")) == F.col("digest")).select("text", "digest", "begins", "ends")
    results = part.mapInArrow(cut, "digest binary, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary").dropDuplicates(["digest"])
    out = rows.join(owners, "digest", "left").join(results, "digest", "left")
    copy = F.col("owner") < F.col("id")
    nothing = F.sha2(F.lit(""), 256)
    return out.select(
        F.when(F.col("id") != _NO_ID, F.col("id")).alias("doc_id"),
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("bigint").alias("n_spans"),
        F.when(copy, nothing).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("digest")))).alias("kept_sha256"),
        *([F.when(copy, F.lit(b"")).otherwise(F.col("kept")).alias("kept")] if with_text else []),
    )
