"""Byte-level BPE by prefix dynamic programming.

For a fixed ranked vocabulary every byte prefix of a piece has exactly one token that ends its encoding.
A token may end a prefix if it is a suffix of it and may follow the last token of the prefix before it,
that is, if merging the two tokens' bytes by rank would leave this boundary alone.  So the encoding of a
piece is a table of one last token per prefix, filled from left to right, and read from right to left.
The table makes appends exact (go on filling) and edits cheap (keep the table up to the edit).

Texts are cut into pieces by the published pattern with array operations over a whole slice of texts, equal
pieces are found by Arrow's dictionary encoding, and only pieces not seen before by the worker meet the table.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from corvane.llm.common import SMALL_SLICE_BYTES, by_slices, code_points, give_back, id_text

# The vocabulary's pattern, and the suffixes it splits off after an apostrophe.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SUFFIXES = ("s", "t", "re", "ve", "m", "ll", "d")

# Pieces (by a task) and pairs (by a worker) that are remembered; beyond that the memory starts anew, with the same results.
REMEMBERED = 500_000

OTHER, LETTER, NUMBER, SPACE = range(4)


def read_ranks(path: str) -> list[bytes]:
    """Tokens by rank from a file of base64 token and rank per line."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * (1 + max(int(r) for _, r in pairs))
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


@cache
def classes() -> np.ndarray:
    """Letter, number, white space or other, by code point."""
    import regex

    every = np.r_[:0xD800, 0xE000:0x110000].astype("<u4").tobytes().decode("utf-32-le")
    out = np.zeros(0x110000, "u1")
    shift = lambda i: i if i < 0xD800 else i + 0x800
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for run in regex.finditer(pattern, every):
            out[shift(run.start()) : shift(run.end() - 1) + 1] = kind
    return out


def piece_starts(points: np.ndarray, text_offsets: np.ndarray) -> np.ndarray:
    """Where the pieces of all texts start (in code points), as PATTERN would find them text by text."""
    n = len(points)
    if not n:
        return np.empty(0, "i8")
    kind = classes()[points]
    first = np.zeros(n + 1, bool)  # first code point of a text, and the end
    first[text_offsets] = True
    change = np.empty(n, bool)
    change[0] = True
    np.not_equal(kind[1:], kind[:-1], out=change[1:])
    change |= first[:n]
    run = np.flatnonzero(change)
    end = np.append(run[1:], n)
    run_kind = kind[run]
    followed = ~first[end]  # by another run of the same text
    start = np.zeros(n + 2, bool)
    space = run_kind == SPACE
    start[run] = True
    # The last white space of a run is a piece of its own, or (a plain blank) opens the next piece.
    start[end[space & followed] - 1] = True
    after_blank = np.zeros(len(run), bool)
    after_blank[1:] = space[:-1] & followed[:-1] & (points[run[1:] - 1] == 32)
    start[run[after_blank]] = False
    # An apostrophe alone, not after a blank, takes a suffix from the letters behind it.
    mark = np.flatnonzero((run_kind == OTHER) & (end - run == 1) & (points[run] == 39) & ~after_blank & followed)
    mark = mark[run_kind[mark + 1] == LETTER]
    if len(mark):
        at, stop = run[mark] + 1, end[mark + 1]
        one = points[at]
        two = np.where(at + 1 < stop, points[np.minimum(at + 1, n - 1)], 0)
        taken = np.zeros(len(mark), "i8")
        for suffix in SUFFIXES:
            hit = one == ord(suffix[0])
            if len(suffix) == 2:
                hit &= two == ord(suffix[1])
            taken[hit] = len(suffix)
        at, stop, taken = at[taken > 0], stop[taken > 0], taken[taken > 0]
        start[at] = False
        start[(at + taken)[at + taken < stop]] = True
    return np.flatnonzero(start[:n])


class Vocabulary:
    """Tokens by rank, the two parts each token was merged from, and a finder of tokens in a piece."""

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.rank = {t: i for i, t in enumerate(tokens) if t}
        self.parts: list[tuple[int, int]] = []
        self.merged: dict[tuple[int, int], int] = {}
        for i, token in enumerate(tokens):
            parts = self._split(token, i)
            self.parts.append(parts)
            if parts[0] != i:
                self.merged[parts] = i
        # Finds every token that ends at a place, the longest first.
        self.automaton = ahocorasick.Automaton()
        for token, i in self.rank.items():
            self.automaton.add_word(token.decode("latin-1"), (i, len(token)))
        self.automaton.make_automaton()
        self.longest = max(map(len, self.rank), default=0)
        self.stable: dict[int, bool] = {}

    def _split(self, token: bytes, own: int) -> tuple[int, int]:
        """The pair of tokens whose merge gives this one; (own, own) for a token that no merge makes."""
        if len(token) < 2:
            return own, own
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranks = [self.rank.get(a + b, own) for a, b in zip(parts, parts[1:])]
            best = min(ranks)
            if best >= own:
                return own, own
            k = ranks.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        try:
            return self.rank[parts[0]], self.rank[parts[1]]
        except KeyError:
            return own, own

    def may_follow(self, left: int, right: int) -> bool:
        """Whether ``right`` after ``left`` is stable: no merge reaches over the boundary.

        Merges are undone from the latest; at each step the tokens that touch the boundary must not have a
        merge that would have come earlier than the one just undone.
        """
        if len(self.stable) > REMEMBERED:
            self.stable.clear()
        known = self.stable[left << 32 | right] = self._stable(left, right)
        return known

    def _stable(self, left: int, right: int) -> bool:
        before = len(self.tokens) + 1
        while True:
            if self.merged.get((left, right), before) < before:
                return False
            undo_left, undo_right = self.parts[left][1] != left, self.parts[right][0] != right
            if undo_left and (left > right or not undo_right):
                before, left = left, self.parts[left][1]
            elif undo_right:
                # Of two equal merges the left one comes first.
                before, right = right + 1, self.parts[right][0]
            else:
                return True


class PrefixEncoder:
    """Encoding of one piece, kept as the last token of every prefix."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.encoded = 0  # bytes that tokens were looked for behind
        self.append(piece)

    def append(self, more: bytes) -> "PrefixEncoder":
        """Encoding of the piece with ``more`` behind it; what is known of the prefixes stays."""
        vocabulary, last = self.vocabulary, self.last
        stable, may_follow = vocabulary.stable, vocabulary.may_follow
        done = len(self.piece)
        self.piece += more
        self.encoded += len(more)
        skipped = max(0, done - vocabulary.longest)  # no token that ends in ``more`` starts before
        filled = done
        for end, (token, length) in vocabulary.automaton.iter(self.piece[skipped:].decode("latin-1")):
            stop = end + skipped + 1
            if stop <= filled:
                continue
            if stop > filled + 1:
                break
            before = last[stop - length]
            if before >= 0:
                known = stable.get(before << 32 | token)
                if not (may_follow(before, token) if known is None else known):
                    continue
            last.append(token)
            filled = stop
        if filled < len(self.piece):
            raise ValueError(f"no token of the vocabulary ends {self.piece[: filled + 1]!r}")
        return self

    def edit(self, start: int, stop: int, new: bytes) -> "PrefixEncoder":
        """Replace bytes ``start:stop``; prefixes before the edit are not encoded again, nor those some way behind it.

        The last token of a prefix follows from its last bytes and the last tokens of the prefixes that end there.  So
        once as many tokens in a row as the longest token has bytes are those of the old table, all further ones are.
        """
        longest, tail, old = self.vocabulary.longest, self.piece[stop:], self.last[stop + 1 :]
        self.piece = self.piece[:start]
        del self.last[start + 1 :]
        self.append(new)
        done = 0
        while done < len(tail):
            step = tail[done : done + 2 * longest]
            self.append(step)
            done += len(step)
            if done >= longest and self.last[-longest:] == old[done - longest : done]:
                self.piece += tail[done:]
                self.last += old[done:]
                break
        return self

    def ids(self) -> list[int]:
        whole = self.vocabulary.rank.get(self.piece)
        if whole is not None:
            return [whole]
        out, at = [], len(self.piece)
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(self.vocabulary.tokens[token])
        return out[::-1]


def _byte_list(array: pa.LargeBinaryArray) -> list[bytes]:
    """Like ``to_pylist`` without a scalar object per value."""
    ends = np.frombuffer(array.buffers()[1], "i8")[array.offset : array.offset + len(array) + 1].tolist()
    data = (array.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
    return [data[a:b] for a, b in zip(ends, ends[1:])]


class Tokenizer:
    """Encodes and decodes slices of texts; remembers the pieces it has met."""

    def __init__(self, tokens: list[bytes]):
        self.vocabulary = Vocabulary(tokens)
        self.forget()
        self.bytes_of = pa.array(tokens, pa.large_binary())

    def forget(self) -> None:
        """Give back what the pieces take: workers outlive their tasks, and the next may be another operator's."""
        self.known: dict[bytes, int] = {}  # piece -> its row below
        self.flat, self.starts = np.empty(0, "u4"), np.zeros(1, "i8")

    def _rows(self, pieces: list[bytes]) -> np.ndarray:
        """Rows of the pieces' ids; those not met before are encoded."""
        if len(self.known) > REMEMBERED:
            self.forget()
        rows = list(map(self.known.get, pieces))
        new: list[list[int]] = []
        for k, row in enumerate(rows):
            if row is None:
                rank = self.vocabulary.rank.get(pieces[k])
                new.append([rank] if rank is not None else PrefixEncoder(self.vocabulary, pieces[k]).ids())
                rows[k] = self.known[pieces[k]] = len(self.known)
        if new:
            ends = self.starts[-1] + np.cumsum(np.fromiter(map(len, new), "i8", len(new)))
            self.flat = np.concatenate([self.flat, np.fromiter((i for ids in new for i in ids), "u4")])
            self.starts = np.concatenate([self.starts, ends])
        return np.array(rows, "i8")

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids start (with the end)."""
        points, text_offsets, first = code_points(data, offsets)
        starts = piece_starts(points, text_offsets)
        if not len(starts):
            return np.empty(0, "u4"), np.zeros(len(offsets), "i8")
        byte_starts = np.append(first[starts], len(data)).astype("i8")
        pieces = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(byte_starts), pa.py_buffer(data)])
        encoded = pieces.dictionary_encode()
        rows = self._rows(_byte_list(encoded.dictionary))[encoded.indices.to_numpy()]
        counts = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(counts)
        ids = self.flat[np.repeat(self.starts[rows] - (ends - counts), counts) + np.arange(ends[-1])]
        at = np.searchsorted(byte_starts[:-1], offsets)  # the first piece of every text
        return ids, np.append(0, ends)[at]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The bytes of every text's ids."""
        taken = pc.take(self.bytes_of, pa.array(ids))
        ends = np.frombuffer(taken.buffers()[1], "i8")[: len(ids) + 1]
        data = memoryview(taken.buffers()[2] or b"")
        at = ends[offsets].tolist()
        return [bytes(data[a:b]) for a, b in zip(at, at[1:])]


@cache
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer(read_ranks(path))


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_tokens, token_ids, decoded`` (binary), digests of both.

    ``ranks_path`` names the vocabulary file, which every machine must have at that path.  Null and
    empty texts have no tokens and decode to nothing.  Text of special tokens is ordinary text.  Rows are
    independent: repeated rows give repeated results.
    """
    names = ["doc_id", "n_tokens", "token_ids", "decoded", "ids_sha256", "decoded_sha256"]

    def encoded(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        tokenizer = _tokenizer(ranks_path)
        ids, at = tokenizer.encode(data, offsets)
        decoded = tokenizer.decode(ids, at)
        raw, ends = memoryview(ids.astype("<u4").tobytes()), (4 * at).tolist()
        return pa.RecordBatch.from_arrays(
            [
                part.column(0),
                pa.array(np.diff(at), pa.int64()),
                pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype("i4"))),
                pa.array(decoded, pa.binary()),
                pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]),
                pa.array([hashlib.sha256(d).hexdigest() for d in decoded]),
            ],
            names=names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_slices(encoded, batches, SMALL_SLICE_BYTES)
        _tokenizer(ranks_path).forget()
        give_back()

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id bigint, n_tokens bigint, token_ids array<int>, decoded binary, ids_sha256 string, decoded_sha256 string"
    )
