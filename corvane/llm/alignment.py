"""Alignment of two tokenizers' tokens by the bytes they cover.

Both vocabularies encode every text; the byte offsets at which a token of each ends cut the tokens into groups, and tokens
that share bytes are linked.  Per batch all of this is columns: token lists are flattened and carry their parents' indices, their
byte lengths become segmented running sums, the ends (document, offset) are the keys of a full outer hash join,
and in the joined table, in order of its keys, every row is one link.  How many documents hold a pair of ids is counted by
``group_by`` per batch; Spark adds the partial counts up and joins them with the documents' links.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from corvane.llm.common import byte_slices, join_counted, stored
from corvane.runtime import spread_small

# Texts are tokenized and joined so many bytes at a time; a longer one is cut where both tokenizers part it anyway.
PART_BYTES = 1 << 20
# A row of the stored links, or of partial counts, has at most so many pairs.
ROW_PAIRS = 1 << 16
# Partial counts of a task are handed on when they have so many distinct pairs.
TASK_PAIRS = 1 << 20
B_BITS = 32

_CUT = re.compile(r"(?<=\S) (?=\S)")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def byte_level_alphabet() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 as itself, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@dataclass
class Vocabularies:
    """Two encoders, their tokens' bytes by id, and the decimal ids with what follows them in a written group."""

    encode_a: object
    encode_b: object
    bytes_a: pa.Array
    bytes_b: pa.Array
    cuttable: bool

    def __post_init__(self) -> None:
        self.len_a, self.len_b = (pc.cast(pc.binary_length(x), pa.int64()) for x in (self.bytes_a, self.bytes_b))
        written = [f"{k}{end}" for end in ",|" for k in range(len(self.bytes_a))] + [f"{k}{end}" for end in [",", ";", ""] for k in range(len(self.bytes_b))]
        self.written = pa.array(written, pa.large_string())


def _byte_level(path: str) -> tuple[object, pa.Array]:
    """The encoder of a byte-level BPE file without special tokens, and the bytes of its entries.

    Where ids follow the order of the merges the pieces are merged by rank; else by the file's own library.
    """
    model = json.loads(open(path, encoding="utf-8").read())
    letters = byte_level_alphabet()
    added = {t["id"]: t["content"].encode() for t in model.get("added_tokens", [])}
    entries = {i: bytes(letters[c] for c in entry) for entry, i in model["model"]["vocab"].items() if i not in added}
    table = [entries.get(i, added.get(i, b"")) for i in range(max([*entries, *added]) + 1)]
    merged = [model["model"]["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["model"]["merges"]]
    plain = model["normalizer"] is None and model["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
    if plain and merged == list(range(256, 256 + len(merged))):
        import public_tokenizers
        import tiktoken

        ranks = {b: i for i, b in entries.items()}
        fast = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [np.asarray(fast.encode_to_numpy(t, disallowed_special=()), "i4") for t in texts], pa.array(table, pa.large_binary())
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    slow.encode_special_tokens = True
    return lambda texts: [np.array(slow.encode(t, add_special_tokens=False).ids, "i4") for t in texts], pa.array(table, pa.large_binary())


def _pieces(path: str) -> tuple[object, pa.Array, bool]:
    """The encoder of a sentence-piece file, the bytes of its pieces, and whether no piece goes on after a space."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    table = [bytes.fromhex(_BYTE.fullmatch(n)[1]) if model.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)]
    cuttable = not any("▁" in n.lstrip("▁") for n in names)
    return lambda texts: [np.array(x, "i4") for x in model.encode(texts, num_threads=1)], pa.array(table, pa.large_binary()), cuttable


@cache
def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    """Read once a worker."""
    encode_a, bytes_a = _byte_level(path_a)
    encode_b, bytes_b, cuttable = _pieces(path_b)
    return Vocabularies(encode_a, encode_b, bytes_a, bytes_b, cuttable)


def parts(text: str, cuttable: bool, most: int = PART_BYTES) -> list[str]:
    """``text`` cut at single spaces between words, which are dropped (both encoders put one before what they get).

    Text without such a space in reach stays whole.
    """
    out, first = [], 0
    while cuttable and len(text) - first > most and (m := _CUT.search(text, first + most)):
        out.append(text[first : m.start()])
        first = m.end()
    return [*out, text[first:]]


def _lists(ids: list[np.ndarray]) -> pa.LargeListArray:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])])
    return pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(np.concatenate([*ids, np.zeros(0, "i4")]).astype("i4"), pa.int32()))


def _ends(lists: pa.LargeListArray, lengths: pa.Array, name: str) -> pa.Table:
    """Flattened tokens with their key: parent in the high half, the end's offset within the parent in the low."""
    ids, parent = pc.list_flatten(lists), pc.cast(pc.list_parent_indices(lists), pa.int64())
    total = pc.cumulative_sum(lengths.take(ids))
    before = pa.concat_arrays([pa.array([0], pa.int64()), total]).take(lists.offsets.slice(0, len(lists)))
    own = pc.subtract(total, before.take(parent))
    return pa.table({"key": pc.add(pc.shift_left(parent, pa.scalar(32, pa.int64())), own), name: ids})


def align(texts: list[str], more: list[bool], v: Vocabularies) -> tuple[dict, list[bytes], pa.Table]:
    """Per text (not empty): ``ok, n_a, n_b, n_groups, n_links`` as arrays; its written groups; and the links.

    The links are ``text, pair, times``: a pair of ids (B_BITS apart) and how often it is linked in the text.  The written
    groups of a text that has ``more`` after it end in a semicolon.
    """
    raw = pa.array(texts, pa.large_string())
    want = pc.cast(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), raw, pa.scalar(" ", pa.large_string())), pa.large_binary())
    a, b = _lists(v.encode_a([f" {t}" for t in texts])), _lists(v.encode_b(texts))

    def joined(lists: pa.LargeListArray, table: pa.Array) -> pa.Array:
        tokens = pa.LargeListArray.from_arrays(lists.offsets, table.take(lists.values))
        return pc.binary_join(tokens, pa.scalar(b"", pa.large_binary()))

    ok = pc.and_(pc.equal(joined(a, v.bytes_a), want), pc.equal(joined(b, v.bytes_b), want))
    if not pc.all(ok).as_py():  # a text whose bytes are not kept has no tokens
        none = pa.scalar([], a.type)
        a, b = pc.if_else(ok, a, none), pc.if_else(ok, b, none)
    n_a, n_b = (pc.cast(pc.list_value_length(x), pa.int64()).to_numpy(zero_copy_only=False) for x in (a, b))
    met = _ends(a, v.len_a, "a").join(_ends(b, v.len_b, "b"), keys="key", join_type="full outer", use_threads=False)
    met = met.take(pc.sort_indices(met["key"])).combine_chunks()
    text = pc.shift_right(met["key"], pa.scalar(32, pa.int64()))
    # A row stands for the bytes up to its end; what covers them is the token that ends here or the next to end.
    of_a, of_b = pc.fill_null_backward(met["a"]), pc.fill_null_backward(met["b"])
    pair = pc.add(pc.shift_left(pc.cast(of_a, pa.int64()), pa.scalar(B_BITS, pa.int64())), pc.cast(of_b, pa.int64()))
    links = pa.table({"text": text, "pair": pair})
    counted = links.group_by(["text", "pair"], use_threads=False).aggregate([([], "count_all")]).rename_columns(["text", "pair", "times"])

    ends_a, ends_b = (~met[c].is_null().to_numpy() for c in "ab")
    cut, place = ends_a & ends_b, text.to_numpy()
    n_groups = np.bincount(place[cut], minlength=len(texts))
    n_links = np.bincount(place, minlength=len(texts))

    # Tokens in written order: of each group those of A, then those of B.
    group = np.cumsum(cut) - cut
    upto_a, upto_b = np.cumsum(ends_a), np.cumsum(ends_b)
    before_b = np.concatenate([[0], upto_b[cut]])  # of B, in groups before
    through_a = upto_a[cut]  # of A, in this group and those before
    ids_a, ids_b = met["a"].drop_null().to_numpy(), met["b"].drop_null().to_numpy()
    last = np.zeros(len(cut), bool)
    last[np.cumsum(n_links)[n_links > 0] - 1] = True
    closes = np.where(last & ~np.array(more, bool)[place], 2, 1)
    order = np.empty(len(ids_a) + len(ids_b), "i8")
    order[upto_a[ends_a] - 1 + before_b[group[ends_a]]] = ids_a + len(v.bytes_a) * cut[ends_a].astype("i8")
    order[upto_b[ends_b] - 1 + through_a[group[ends_b]]] = 2 * len(v.bytes_a) + ids_b + len(v.bytes_b) * np.where(cut, closes, 0)[ends_b]
    written = v.written.take(pa.array(order))
    stops = np.frombuffer(written.buffers()[1], "i8")[: len(written) + 1][np.concatenate([[0], np.cumsum(n_a + n_b)])]
    data = memoryview(written.buffers()[2]) if len(written) else memoryview(b"")
    groups = [data[x:y] for x, y in zip(stops[:-1].tolist(), stops[1:].tolist())]
    return {"ok": ok.to_numpy(zero_copy_only=False), "n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": n_links}, groups, counted


SCHEMA = "row bigint, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<bigint>, times array<bigint>"
_NAMES = [x.split(" ")[0] for x in SCHEMA.split(", ")]
_COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def _long(text: str, v: Vocabularies) -> tuple[dict, str, pa.Table]:
    """One long text, part by part: counts add up, groups are hashed as they come, links are merged."""
    total, digest, linked = dict.fromkeys(_COUNTS, 0), hashlib.sha256(), []
    cut = parts(text, v.cuttable)
    for k, part in enumerate(cut):
        one, groups, links = align([part], [k + 1 < len(cut)], v)
        if not one["ok"][0]:
            return dict.fromkeys(_COUNTS, 0), "", links.slice(0, 0)
        for c in _COUNTS:
            total[c] += int(one[c][0])
        digest.update(groups[0])
        linked.append(links)
        if len(linked) > 8:
            linked = [_merged(linked)]
    return total, digest.hexdigest(), _merged(linked)


def _merged(tables: list[pa.Table]) -> pa.Table:
    """Links of one text (or partial counts) added up."""
    keys = [c for c in tables[0].column_names if c != "times"]
    out = pa.concat_tables(tables).group_by(keys, use_threads=False).aggregate([("times", "sum")])
    return out.rename_columns([*keys, "times"])


def _pair_rows(row: int | None, links: pa.Table) -> Iterator[pa.RecordBatch]:
    """Rows with nothing but pairs."""
    for k in range(0, links.num_rows, ROW_PAIRS):
        part = links.slice(k, ROW_PAIRS).combine_chunks()
        ends = pa.array([0, part.num_rows], pa.int32())
        lists = [pa.ListArray.from_arrays(ends, part[c].combine_chunks().cast(pa.int64())) for c in ("pair", "times")]
        yield pa.RecordBatch.from_arrays([pa.array([row], pa.int64()), *[pa.nulls(1, pa.int64())] * 5, pa.nulls(1, pa.string()), *lists], names=_NAMES)


def link_parts(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts; its links in it or, where they are many, in rows of their own (``n_a`` null); and
    partial counts of the task (``row`` null): in how many of its documents a pair is linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabularies(path_a, path_b)
        seen: list[pa.Table] = []
        held = 0

        def count(links: pa.Table) -> Iterator[pa.RecordBatch]:
            nonlocal held
            if links.num_rows:
                seen.append(links.group_by("pair", use_threads=False).aggregate([([], "count_all")]).rename_columns(["pair", "times"]))
                held += seen[-1].num_rows
            if held > TASK_PAIRS:
                seen[:] = [_merged(seen)]
                held = seen[0].num_rows
                if held > TASK_PAIRS // 2:
                    yield from _pair_rows(None, seen.pop())
                    held = 0

        for batch in batches:
            for part, data, offsets in byte_slices(batch, "text", PART_BYTES):
                texts = part.column(2).to_pylist()
                if len(texts) == 1 and offsets[-1] > PART_BYTES:
                    one, digest, links = _long(texts[0], v)
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), *[pa.array([one[c]], pa.int64()) for c in _COUNTS], pa.array([digest]), *[pa.nulls(1, pa.list_(pa.int64()))] * 2], names=_NAMES
                    )
                    yield from _pair_rows(part.column(0)[0].as_py(), links)
                    yield from count(links)
                    continue
                full = np.flatnonzero(np.diff(offsets) > 0)
                counts = {c: np.zeros(len(texts), "i8") for c in _COUNTS}
                digests, sizes, links = [""] * len(texts), np.zeros(len(texts), "i8"), None
                if len(full):
                    found, groups, links = align([texts[k] for k in full], [False] * len(full), v)
                    for c in _COUNTS:
                        counts[c][full] = found[c]
                    for k, ok, group in zip(full.tolist(), found["ok"].tolist(), groups):
                        digests[k] = hashlib.sha256(group).hexdigest() if ok else ""
                    of = links["text"].to_numpy()
                    if np.any(np.diff(of) < 0):
                        links = links.take(pc.sort_indices(links["text"]))
                    sizes[full] = np.bincount(of, minlength=len(full))
                ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype("i4"), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(links[c].to_numpy() if links is not None else np.zeros(0, "i8"), pa.int64())) for c in ("pair", "times")]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(counts[c], pa.int64()) for c in _COUNTS], pa.array(digests, pa.string()), *lists], names=_NAMES)
                if links is not None:
                    yield from count(links)
        if seen:
            yield from _pair_rows(None, _merged(seen))

    rows = spread_small(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(run, SCHEMA)


def align_documents(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Per row of ``docs`` ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``, and the pairs' counts.

    The counts are ``a, b, n_docs, best``: best if no other pair of the same ``a`` is in more documents.  Null and empty
    texts, and those that a tokenizer does not give back byte by byte, have zeros and an empty digest.  Rows that repeat an
    id or a text are documents of their own.
    """
    found = stored(link_parts(docs, path_a, path_b, id_col, text_col), "links")

    def linked(rows: DataFrame, *carried: str) -> DataFrame:
        both = F.explode(F.arrays_zip("pairs", "times")).alias("link")
        return rows.select(*carried, both).select(*carried, F.col("link.pairs").alias("pair"), F.col("link.times").alias("times"))

    totals = linked(found.where(F.col("row").isNull())).groupBy("pair").agg(F.sum("times").alias("n_docs"))
    totals = stored(totals.select("pair", F.shiftright("pair", B_BITS).alias("a"), "n_docs"), "totals")
    most = totals.groupBy("a").agg(F.max("n_docs").alias("most"))
    totals = stored(totals.join(most, "a").select(F.col("pair").alias("_pair"), "n_docs", (F.col("n_docs") == F.col("most")).alias("best")), "counts")
    links = linked(found.where(F.col("row").isNotNull()), "row")
    met = join_counted(links, totals, F.col("pair") == F.col("_pair"), "n_docs")
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n_docs")).alias("count_sum"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    out = found.where(F.col("n_a").isNotNull()).select("row", "doc_id", *_COUNTS, "groups_sha256").join(sums, "row", "left")
    counts = totals.select(F.shiftright("_pair", B_BITS).alias("a"), F.col("_pair").bitwiseAND(F.lit((1 << B_BITS) - 1)).alias("b"), "n_docs", "best")
    return out.select("doc_id", *_COUNTS, zero("n_best"), zero("count_sum"), "groups_sha256"), counts
