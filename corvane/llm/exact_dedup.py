"""Exact dedup of new documents against historical ones through minimal perfect hashing.

The distinct digests of the history are spread over shards by their leading bits, and each shard is
a minimal perfect hash: levels of bit arrays in which a bit is set where exactly one of the remaining
keys falls; the rank of a key's bit is its slot.  A slot holds the full digest and the locator of the
winner (row, id, length) and the group size.  A perfect hash gives some slot for any key, so a lookup
compares the slot's 32 digest bytes with the key's: equal means member, anything else is new, and new
digests are grouped among themselves.

Copies are counted and reduced to one candidate per digest before any lookup (map-side), so a group of
copies is one row from there on, however large; shards hold distinct digests only and are even.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import stored

# Removed before texts are compared.
BLANKS = " \t\n\x0b\x0c\r"
# Digests per shard, on average: some 20 MB of slots in one task.
SHARD_DIGESTS = 200_000
_LEVELS, _SPARSE = 24, 1.6

_MEMBERS = "digest binary, best_len bigint, best_id bigint, best_row bigint, n bigint"
_SLOTS = "shard int, sizes binary, bits binary, rest binary, digests binary, best_len binary, best_id binary, best_row binary, n binary"


def digest(text: Column) -> Column:
    """SHA-256 (binary) of the text without blanks; null counts as empty."""
    return F.unhex(F.sha2(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """Per row: ``doc_id, row, digest, n_chars``.  Stored, since row numbers must not change later."""
    text = F.col(text_col).cast("string")
    return stored(
        docs.select(
            F.col(id_col).cast("bigint").alias("doc_id"),
            (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"),
            digest(text).alias("digest"),
            F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_chars"),
        ),
        "digests",
    )


def groups(rows: DataFrame) -> DataFrame:
    """Distinct digests with their winner: most code points, then smallest id (null last), then first row."""
    # Complements turn the order without overflow; a winner without an id has the complement of its length.
    has = F.col("doc_id").isNotNull().cast("int")
    best = F.max(F.struct(F.col("n_chars").alias("long"), has.alias("has"), F.bitwise_not(F.coalesce("doc_id", F.lit(0))).alias("id"), F.bitwise_not("row").alias("row"))).alias("best")
    out = rows.groupBy("digest").agg(best, F.count(F.lit(1)).alias("n"))
    length = F.when(F.col("best.has") == 1, F.col("best.long")).otherwise(F.bitwise_not("best.long"))
    return out.select("digest", length.alias("best_len"), F.bitwise_not("best.id").alias("best_id"), F.bitwise_not("best.row").alias("best_row"), "n")


def _words(digests: np.ndarray) -> np.ndarray:
    """(n, 4) unsigned words of (n, 32) digest bytes."""
    return np.ascontiguousarray(digests).view("<u8").reshape(-1, 4)


def _position(words: np.ndarray, level: int, size: int) -> np.ndarray:
    """Place of each key in the bit array of a level: words of the digest, remixed per level."""
    with np.errstate(over="ignore"):
        x = words[:, 1 + level % 3] ^ (words[:, 1 + (level + 1) % 3] * np.uint64(0x9E3779B97F4A7C15 + 2 * level))
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return ((x >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)


def _ranks(winners: dict, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """What winners are compared by, smallest first: longest, with an id, smallest id, first row."""
    length = winners["best_len"][at]
    return -np.maximum(length, ~length), length < 0, winners["best_id"][at], winners["best_row"][at]


class PerfectHash:
    """Minimal perfect hash over distinct 32-byte digests, and its byte form."""

    def __init__(self, sizes: list[int], bits: list[np.ndarray], rest: np.ndarray):
        self.sizes, self.bits, self.rest = sizes, bits, rest
        self.ranks = [np.concatenate([[0], np.cumsum(b)]) for b in bits]
        self.starts = np.concatenate([[0], np.cumsum([r[-1] for r in self.ranks])]).astype("i8")

    @classmethod
    def build(cls, keys: np.ndarray) -> "PerfectHash":
        left, sizes, bits = _words(keys), [], []
        for level in range(_LEVELS):
            if not len(left):
                break
            size = max(8, int(_SPARSE * len(left)))
            place = _position(left, level, size).astype("i8")
            single = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            bits.append(single)
            left = left[~single[place]]
        # Keys that met another one on every level (next to none) are kept as they are.
        rest = left[np.lexsort(left.T[::-1])] if len(left) else left
        return cls(sizes, bits, rest)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of every key; -1 where no level and no leftover has one.  Not a test of membership."""
        words = _words(keys)
        out, open_ = np.full(len(words), -1, "i8"), np.arange(len(words))
        for level, (size, bits, ranks) in enumerate(zip(self.sizes, self.bits, self.ranks)):
            place = _position(words[open_], level, size).astype("i8")
            hit = bits[place]
            out[open_[hit]] = self.starts[level] + ranks[place[hit]]
            open_ = open_[~hit]
        base = self.starts[-1]
        for k, word in enumerate(self.rest):
            out[open_[(words[open_] == word).all(axis=1)]] = base + k
        return out

    def to_bytes(self) -> tuple[bytes, bytes, bytes]:
        return np.array(self.sizes, "i8").tobytes(), b"".join(np.packbits(b).tobytes() for b in self.bits), self.rest.tobytes()

    @classmethod
    def from_bytes(cls, sizes: bytes, bits: bytes, rest: bytes) -> "PerfectHash":
        counts, at, arrays = np.frombuffer(sizes, "i8").tolist(), 0, []
        for size in counts:
            n = (size + 7) // 8
            arrays.append(np.unpackbits(np.frombuffer(bits, "u1", n, at))[:size].astype(bool))
            at += n
        return cls(counts, arrays, np.frombuffer(rest, "u8").reshape(-1, 4))


def _keys(frame: pd.DataFrame) -> np.ndarray:
    return np.frombuffer(b"".join(frame["digest"]), "u1").reshape(-1, 32)


def _shard(n_shards: int) -> Column:
    return (F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("bigint") % n_shards).cast("int")


def build_history(distinct: DataFrame) -> tuple[DataFrame, int]:
    """The index over ``groups`` rows: one row per shard; and the number of shards (from the count)."""
    n_shards = max(1, -(-distinct.count() // SHARD_DIGESTS))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        keys = _keys(frame)
        mph = PerfectHash.build(keys)
        order = np.argsort(mph.slots(keys))
        sizes, bits, rest = mph.to_bytes()
        columns = {c: [frame[c].to_numpy("i8")[order].tobytes()] for c in ("best_len", "best_id", "best_row", "n")}
        return pd.DataFrame({"shard": [frame["shard"].iloc[0]], "sizes": [sizes], "bits": [bits], "rest": [rest], "digests": [keys[order].tobytes()], **columns})

    index = distinct.withColumn("shard", _shard(n_shards)).groupBy("shard").applyInPandas(build, _SLOTS)
    return stored(index, "history"), n_shards


def lookup(index: DataFrame, n_shards: int, distinct: DataFrame) -> DataFrame:
    """History and new digests brought together, one row per distinct digest.

    Columns of ``groups`` plus ``member``: the digest is in the history.  The winner and the size of a
    member's group cover both sides.
    """

    def match(slots: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
        names = ("best_len", "best_id", "best_row", "n")
        have = {c: new[c].to_numpy("i8").copy() for c in names}
        keys = _keys(new) if len(new) else np.empty((0, 32), "u1")
        frames = []
        member = np.zeros(len(new), bool)
        if len(slots):
            row = slots.iloc[0]
            old_keys = np.frombuffer(row["digests"], "u1").reshape(-1, 32)
            old = {c: np.frombuffer(row[c], "i8").copy() for c in names}
            at = PerfectHash.from_bytes(row["sizes"], row["bits"], row["rest"]).slots(keys)
            found = np.flatnonzero((at >= 0) & (at < len(old_keys)))
            found = found[(old_keys[at[found]] == keys[found]).all(axis=1)]  # the byte check
            member[found], at = True, at[found]
            old["n"][at] += have["n"][found]
            better, level = np.zeros(len(found), bool), np.ones(len(found), bool)
            for x, y in zip(_ranks(have, found), _ranks(old, at)):
                better |= level & (x < y)
                level &= x == y
            for c in names[:3]:
                old[c][at[better]] = have[c][found[better]]
            frames.append(pd.DataFrame({"digest": [k.tobytes() for k in old_keys], **old, "member": True}))
        rest = ~member
        frames.append(pd.DataFrame({"digest": [k.tobytes() for k in keys[rest]], **{c: v[rest] for c, v in have.items()}, "member": False}))
        return pd.concat(frames)

    return (
        index.groupBy("shard")
        .cogroup(distinct.withColumn("shard", _shard(n_shards)).groupBy("shard"))
        .applyInPandas(match, _MEMBERS + ", member boolean")
    )


def exact_dedup(docs: DataFrame, is_history: Column | None = None, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256, in_history``.

    ``is_history`` (over ``doc_id``) says which rows came earlier; the default takes the lower half of
    the range of ids.  It decides only which side is indexed and which looks up, never the result.

    Null or empty texts are equal to each other; a null id loses ties and gives a null ``keep_id``; of
    rows that repeat id and text exactly one is kept; an empty table gives no rows.  ``row_col`` names a bigint
    that tells the rows apart; it is returned as ``row``.
    """
    rows = digests(docs, id_col, text_col, row_col)
    if is_history is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        is_history = F.col("doc_id") <= F.lit(((low or 0) + (high or 0)) // 2)
    side = F.coalesce(is_history, F.lit(False))
    index, n_shards = build_history(groups(rows.where(side)))
    winners = stored(lookup(index, n_shards, groups(rows.where(~side))), "winners")
    # A digest that most rows share is a hot key of this join only; it is a plain equi-join, which
    # adaptive execution splits.
    return rows.join(winners, "digest").select(
        "doc_id",
        F.when(F.col("best_len") >= 0, F.col("best_id")).alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("row") == F.col("best_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("member").alias("in_history"),
        *(["row"] if row_col else []),
    )
