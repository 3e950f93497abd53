"""Records of large JSON files read by many tasks.

A file is cut at closing braces, wherever they stand, so any byte range of it can be read by a task of its own.  Whether a
range begins inside a string, and how deeply nested, depends on all ranges before it: each range says what it does to either
state, these few numbers are composed in order, and with its true beginning known every range gives out its records.  A
record that crosses ranges is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_ESCAPED = re.compile(r"\\.", re.S)
_BLANK = re.compile(r"\s*")
_COMMA = re.compile(r"\s*,\s*")
_OPEN, _CLOSE, _EMPTY = re.compile(r"\s*\[\s*"), re.compile(r"\s*\]\s*"), re.compile(r"\s*\[\s*\]\s*")


def _step(piece: str, inside: int) -> tuple[int, int]:
    """Whether a string is open after ``piece``, and by how much it deepens the nesting, given whether one was open before."""
    if "\\" in piece:
        piece = _ESCAPED.sub("", piece)
    parts = piece.split('"')
    outside = "".join(parts[inside::2])
    return (inside + len(parts) - 1) % 2, outside.count("{") + outside.count("[") - outside.count("]")


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Runs of rows (file, start, value) of one range, with their pieces."""
    rows = ((f, s, v) for b in batches for f, s, v in zip(*(c.to_pylist() for c in b.columns)))
    head = next(rows, None)
    while head is not None:
        key = head[:2]

        def pieces() -> Iterator[str]:
            nonlocal head
            while head is not None and head[:2] == key:  # noqa: B023
                yield head[2]
                head = next(rows, None)

        yield key, pieces()


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per range: string state and nesting at its end, for both states at its beginning; how it begins; its bytes."""
    for (file, start), pieces in _ranges(batches):
        state, depth, size, first = [0, 1], [0, 0], 0, None
        for piece in pieces:
            first = piece.lstrip()[:1] if first is None else first
            size += len(piece.encode()) + 1
            for k in (0, 1):
                state[k], deeper = _step(piece, state[k])
                depth[k] += deeper - (1 - state[k])  # the closing brace counts outside strings
        row = [file, start, state[0], state[1], depth[0], depth[1], size, first]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, [pa.string(), *[pa.int64()] * 6, pa.string()])], names=_SUMMARY_NAMES)


_SUMMARY = "file string, start bigint, state_0 bigint, state_1 bigint, depth_0 bigint, depth_1 bigint, size bigint, first string"
_SUMMARY_NAMES = [p.split(" ")[0] for p in _SUMMARY.split(", ")]
_PARTS = "file string, start bigint, part string, text string"


class Malformed(ValueError):
    pass


def _records(pieces: Iterator[str], begins: dict, strict: bool) -> Iterator[tuple[str, str]]:
    """(part, text) of a range: a ``whole`` record, or the ``tail``, ``middle`` or ``head`` of one that crosses ranges."""

    def check(ok: bool, where: str) -> None:
        if strict and not ok:
            raise Malformed(f"malformed JSON in {begins['file']}: cannot parse {where[:60]!r}")

    inside, depth, base = begins["inside"], begins["depth"], begins["base"]
    held: list[str] = []
    open_, crossed = depth > base or bool(inside), depth > base or bool(inside)
    beginning = begins["is_first"]
    ahead = next(pieces, None)
    while ahead is not None:
        piece, ahead = ahead, next(pieces, None)
        unclosed = ahead is None and begins["is_last"] and not begins["closed"]
        if not open_:
            at = piece.find("{")
            if at < 0 or unclosed and at < 0:
                end = _CLOSE if base else _BLANK
                alone = _EMPTY if base else _BLANK
                check(unclosed and (alone if beginning else end).fullmatch(piece) is not None, piece)
                return
            lead = (_OPEN if base else _BLANK) if beginning else (_COMMA if base else _BLANK)
            check(lead.fullmatch(piece[:at]) is not None, piece)
            if beginning and base:
                depth = 1
            text, open_ = piece[at:], True
        else:
            text = piece
        beginning = False
        inside, deeper = _step(text, inside)
        depth += deeper
        if unclosed:
            check(False, text)
            return
        depth -= 1 - inside
        held.append(text + "}")
        if not inside and depth <= base:
            yield ("head" if crossed else "whole"), "".join(held)
            held, open_, crossed = [], False, False
    if begins["is_last"]:
        # An array ends in a bracket, which is a piece without a brace behind it.
        check(not held and (not base or not begins["closed"]), "".join(held)[-60:] or "the end of the file")
    elif held:
        yield ("middle" if crossed else "tail"), "".join(held)


def _beginnings(rows: list[dict], sizes: dict[str, int]) -> dict[tuple[str, int], dict]:
    """What each range of each file begins with, from the ranges before it."""
    out = {}
    for file in {r["file"] for r in rows}:
        own = sorted((r for r in rows if r["file"] == file), key=lambda r: r["start"])
        base = int(own[0]["first"] == "[")
        closed = sum(r["size"] for r in own) <= sizes[file]  # else the last piece has no brace behind it
        inside, depth = 0, 0
        for k, r in enumerate(own):
            out[file, r["start"]] = {"file": file, "inside": inside, "depth": depth, "base": base, "is_first": k == 0, "is_last": k + 1 == len(own), "closed": closed}
            inside, depth = r[f"state_{inside}"], depth + r[f"depth_{inside}"]
    return out


def read_json_records(spark: SparkSession, path: str, schema: str | T.StructType, mode: str = "FAILFAST", glob: str = "*.json") -> DataFrame:
    """Records of JSON arrays, or of objects one after the other, in one file or directly in a folder; UTF-8.

    Files of any size are read in ranges of ``spark.sql.files.maxPartitionBytes``.  With ``FAILFAST`` a damaged file fails the
    read; "PERMISSIVE" gives null rows for damaged records, "DROPMALFORMED" none.  One short row a range goes through the driver.
    """
    strict = mode.upper() == "FAILFAST"
    text = spark.read.option("lineSep", "}").option("pathGlobFilter", glob).text(path)
    meta = F.col("_metadata")
    pieces = text.select(meta["file_path"].alias("file"), meta["file_block_start"].alias("start"), "value")
    sizes = {r["file"]: r["size"] for r in text.select(meta["file_path"].alias("file"), meta["file_size"].alias("size")).groupBy("file").agg(F.max("size").alias("size")).collect()}
    begins = _beginnings(pieces.mapInArrow(_summaries, _SUMMARY).toArrow().to_pylist(), sizes)
    shipped = spark.sparkContext.broadcast(begins)  # a few numbers a range

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, own in _ranges(batches):
            rows, held = [], 0
            for part, value in _records(own, shipped.value[key], strict):
                rows.append((part, value))
                held += len(value)
                if held > 1 << 20:
                    yield batch_of(key, rows)
                    rows, held = [], 0
            for _ in own:  # what a damaged file has left
                pass
            if rows:
                yield batch_of(key, rows)

    def batch_of(key: tuple[str, int], rows: list[tuple[str, str]]) -> pa.RecordBatch:
        n = len(rows)
        return pa.RecordBatch.from_arrays([pa.array([key[0]] * n), pa.array([key[1]] * n, pa.int64()), pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows])], names=["file", "start", "part", "text"])

    parts = pieces.mapInArrow(cut, _PARTS)
    whole = parts.where(F.col("part") == "whole").select("text")
    # A record that crosses ranges begins with a tail; the ranges up to its head belong to it.
    if len(begins) > len(sizes):
        crossing = parts.where(F.col("part") != "whole")
        ranges = crossing.select("file", "start", "part").distinct().collect()  # at most two a range
        owner, current = [], None
        for r in sorted(ranges, key=lambda r: (r["file"], r["start"], ["head", "middle", "tail"].index(r["part"]))):
            current = r["start"] if r["part"] == "tail" else current
            owner.append((r["file"], r["start"], r["part"], current))
        if owner:
            owners = spark.createDataFrame(owner, "file string, start bigint, part string, first bigint")
            joined = crossing.join(F.broadcast(owners), ["file", "start", "part"]).groupBy("file", "first")
            merged = joined.agg(F.array_sort(F.collect_list(F.struct("start", "text"))).alias("p")).select(F.array_join(F.transform("p", lambda p: p["text"]), "").alias("text"))
            whole = whole.unionByName(merged)
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    options = {"mode": "FAILFAST" if strict else "PERMISSIVE", "columnNameOfCorruptRecord": "_damaged"}
    found = whole.select(F.from_json("text", T.StructType([*schema.fields, *([] if strict else [T.StructField("_damaged", T.StringType())])]), options).alias("r"))
    if mode.upper() == "DROPMALFORMED":
        found = found.where(F.col("r._damaged").isNull())
    return found.select(*[F.col(f"r.`{n}`").alias(n) for n in schema.names])
