"""Every-query-against-every-item work without a cross join.

A similarity search, a rank or an in-batch softmax needs all (query, item) products, but never the
pairs as rows.  ``block_join`` brings blocks of queries and blocks of items together, computes one
matrix product per pair of blocks, and emits only what the fold kept: local top-k rows, counts, or
softmax sums.  Two ways to bring the blocks together:

* few queries (checked: at most ``broadcast_cells`` numbers): they travel to the items with the
  task, the items are read in place and are neither shuffled nor copied;
* otherwise a grid: queries are copied to every item block, items to every query block, and each
  grid cell is one cogroup of bounded size.  Blocks grow with the table up to BLOCK_BYTES, so that a row
  is copied a bounded number of times.

With group columns (index cell, mini-batch, hash bucket) only blocks of the same group meet.  The
number of blocks follows the group's row count, so a hot group is spread over many grid cells.

Products are taken in 32 bits first; only those that may count, by a bound on the error, are taken again
in 64 bits, so nothing depends on the short product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.matrix import to_matrix, unit_rows
from corvane.runtime import MAX_BROADCAST_CELLS, broadcast_checked, collect_bounded, shuffled

# Vectors of one side in a grid cell, in bytes: the fewer blocks, the fewer copies of every row.
BLOCK_BYTES = 32 << 20
# Blocks have these rows at least, and so many more that a row is copied at most MAX_COPIES times, up to BLOCK_BYTES.
BLOCK_ROWS, MAX_COPIES = 32_768, 8
# Grid cells of more products than a task should take are dealt over so many partitions a cell, so that few share a task.
CELL_PARTITIONS = 4
# Products of a task that scans items beside shipped queries: some 20 seconds of work.
TASK_PAIRS = 4_000_000_000
# A product inside a cell is tiled, so that its scores stay small; the first tiles are smaller, and raise the bar for the others.
QUERY_TILE, ITEM_TILE, FIRST_TILE = 1024, 4096, 256
# A tile in which more than one product in so many has to be taken again is better taken as a whole.
FEW_HITS = 16
# Items to count are dealt into leaves of near ones (a multiple of 8, at most 248), bounded along so many directions of their own; queries
# meet so many leaves at a time, and products of so many queries with a leaf are taken at once.  Fewer items than MANY_ITEMS are not dealt.
LEAF, DIRECTIONS, LEAF_QUERIES, LEAF_TILE, LEAF_ROWS, MANY_ITEMS = 128, 4, 16_384, 32, 2048, 2048
# A leaf that leaves a larger share of the queries undecided takes the products of all of them.
MOST_OPEN = 0.6
# Each task of a scan beside shipped queries emits partial results for all of them, so a large index is not scanned by
# more tasks than this, or eight a core where there are more cores.
SCAN_TASKS = 10_000
# Scores closer than this are ties, settled by the lower id.
TIE_DIGITS = 9


def _down(x: np.ndarray) -> np.ndarray:
    """The 32-bit number below."""
    return np.nextafter(x.astype("f4"), np.float32(-np.inf))


def _room(q: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """How far 32-bit inner products of each query may be off, and 9-digit rounding with them; None: any far."""
    largest = np.sqrt((q * q).sum(1)), np.sqrt((x * x).sum(1).max(initial=0.0))
    if not (largest[0].max(initial=0.0) < 1e15 and largest[1] < 1e15):  # no number, or none in 32 bits
        return None
    return (q.shape[1] + 8) * 2.0**-23 * largest[0] * largest[1] + 4.0 * 10.0**-TIE_DIGITS


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    return q.astype("f4") @ x.astype("f4").T


def _pair_sums(fn, q: np.ndarray, x: np.ndarray, r: np.ndarray, c: np.ndarray) -> np.ndarray:
    """``fn`` of rows of ``q`` and ``x`` pair by pair, so many at once that the rows stay small."""
    step = max(1, 4_000_000 // max(q.shape[1], 1))
    return np.concatenate([np.zeros(0), *[fn(q[r[i : i + step]], x[c[i : i + step]]) for i in range(0, len(r), step)]])


def _inner(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.round(np.einsum("ij,ij->i", a, b), TIE_DIGITS) + 0.0  # no minus zero


def _minus_distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return -np.round(np.sqrt(((a - b) ** 2).sum(1)), TIE_DIGITS)


class TopK:
    """Best ``k`` items per query: inner product descending, or L2 distance ascending."""

    schema = "grp bigint, query_id bigint, vec_id bigint, score double"

    def __init__(self, k: int, metric: str = "ip", exclude_self: bool = False):
        self.k, self.metric, self.exclude_self = k, metric, exclude_self

    def start(self, n: int):
        width = max(self.k, 1)
        return np.full((n, width), -np.inf), np.full((n, width), np.iinfo("i8").max)

    def _scores(self, q, x):
        if self.metric == "ip":
            return np.round(q @ x.T, TIE_DIGITS) + 0.0  # no minus zero
        # Squared distances by matrix product pick the candidates; their error bound decides how
        # many more than k must be recomputed exactly, so rounding never changes the result.
        qq, xx = (q * q).sum(1)[:, None], (x * x).sum(1)[None, :]
        rough = np.maximum(qq + xx - 2.0 * (q @ x.T), 0.0)
        if rough.shape[1] > self.k + 1:
            near = np.partition(rough, self.k, axis=1)[:, self.k][:, None]
            slack = 1e-15 * q.shape[1] * (qq + xx.max()) + 4.0 * 10.0**-TIE_DIGITS * np.sqrt(near)
            rows, cols = np.nonzero(rough <= near + 2.0 * slack + 1e-16)
        else:
            rows, cols = (a.ravel() for a in np.indices(rough.shape))
        out = np.full(rough.shape, -np.inf)
        out[rows, cols] = _pair_sums(_minus_distance, q, x, rows, cols)
        return out

    def _ahead(self, kth, q, x):
        """Pairs (query, item) that may be among the best, given the last of the best so far; None: too many to tell apart."""
        if not np.isfinite(kth).all():
            return None
        if self.metric == "ip":
            room = _room(q, x)
            if room is None:
                return None
            hit = _products(q, x) >= _down(kth - room)[:, None]
        else:
            centre = x.mean(axis=0)
            q, x = q - centre, x - centre
            room = _room(q, x)
            if room is None:
                return None
            # |q - x| <= d where q x - x x / 2 >= (q q - d d) / 2.
            qq, xx = (q * q).sum(1), (x * x).sum(1)
            room = 2.0 * room + 2.0**-21 * (qq + xx.max() + kth * kth)
            product = _products(q, x)
            product -= (xx / 2.0).astype("f4")
            hit = product >= _down((qq - (4.0 * 10.0**-TIE_DIGITS - kth) ** 2) / 2.0 - room)[:, None]
        return None if FEW_HITS * np.count_nonzero(hit) > hit.size else np.divmod(np.flatnonzero(hit), hit.shape[1])

    def _improve(self, state, at, r, scores, ids) -> None:
        """Put pairs, in order of their queries, among the best of their query."""
        best, best_ids = (s[at] for s in state)
        rows = r[np.flatnonzero(np.diff(r, prepend=-1))]
        width = best.shape[1]
        row = np.concatenate([r, np.repeat(rows, width)])
        scores, ids = np.concatenate([scores, best[rows].ravel()]), np.concatenate([ids, best_ids[rows].ravel()])
        order = np.lexsort((ids, -scores, row))
        first = np.flatnonzero(np.diff(row[order], prepend=-1))
        pick = order[first[:, None] + np.arange(width)]
        best[rows], best_ids[rows] = scores[pick], ids[pick]

    def fold(self, state, at, q, q_ids, own, x, x_ids):
        best, best_ids = state
        pairs = self._ahead(best[at][:, -1], q, x) if self.k else None
        if pairs is not None:
            r, c = pairs
            if self.exclude_self:
                other = q_ids[r] != x_ids[c]
                r, c = r[other], c[other]
            if len(r):
                self._improve(state, at, r, _pair_sums(_inner if self.metric == "ip" else _minus_distance, q, x, r, c), x_ids[c])
            return
        order = np.argsort(x_ids, kind="stable")
        x, x_ids = x[order], x_ids[order]
        scores = self._scores(q, x)
        if self.exclude_self:
            scores[q_ids[:, None] == x_ids[None, :]] = -np.inf
        if scores.shape[1] > self.k:
            kth = np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k][:, None]
            above, level = scores > kth, scores == kth
            room = self.k - above.sum(axis=1, keepdims=True)
            keep = above | (level & (np.cumsum(level, axis=1, dtype="i4") <= room))
            cols = np.nonzero(keep)[1].reshape(len(q), self.k)
            scores = np.take_along_axis(scores, cols, axis=1)
            ids = x_ids[cols]
        else:
            ids = np.broadcast_to(x_ids, scores.shape)
        ids = np.where(np.isneginf(scores), np.iinfo("i8").max, ids)
        merged = np.concatenate([best[at], scores], axis=1)
        merged_ids = np.concatenate([best_ids[at], ids], axis=1)
        pick = np.lexsort((merged_ids, -merged))[:, : best.shape[1]]
        best[at] = np.take_along_axis(merged, pick, axis=1)
        best_ids[at] = np.take_along_axis(merged_ids, pick, axis=1)

    def emit(self, state, groups, q_ids):
        best, best_ids = state
        rows, cols = np.nonzero(~np.isneginf(best))
        score = best[rows, cols]
        return [groups[rows], q_ids[rows], best_ids[rows, cols], score if self.metric == "ip" else -score]


def _deal(x: np.ndarray) -> np.ndarray:
    """Rows of ``x`` in order of their leaves: halves along the direction in which they spread, down to LEAF rows.

    Every leaf but the last has LEAF rows.  The direction is that of some of the rows; it changes no result.
    """
    out, open_ = [], [np.arange(len(x))]
    while open_:
        rows = open_.pop()
        if len(rows) <= LEAF:
            out.append(rows)
            continue
        some = x[rows[:: -(-len(rows) // 512)]]
        some = some - some.mean(axis=0)
        along = some[np.argmax((some * some).sum(axis=1))]
        for _ in range(4):
            along = some.T @ (some @ along)
            along = along / max(np.sqrt(along @ along), 1e-300)
        half = LEAF * max(1, len(rows) // (2 * LEAF))
        parted = rows[np.argpartition(x[rows] @ along, half)]
        open_ += [parted[half:], parted[:half]]  # the one with the rest is taken last
    return np.concatenate(out)


def _leaf_bounds(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of leaves (leaf, row, component): a centre, some directions times how far rows lie from it along them, and how far beside them."""
    centre = x.mean(axis=1)
    away = x - centre[:, None, :]
    basis = away[:, :: LEAF // DIRECTIONS, :][:, : min(DIRECTIONS, x.shape[2])].transpose(0, 2, 1)
    for _ in range(3):
        basis = np.linalg.qr(away.transpose(0, 2, 1) @ (away @ basis))[0]
    along = away @ basis
    beside = away - along @ basis.transpose(0, 2, 1)
    low, high = along.min(axis=1), along.max(axis=1)
    centre = centre + (basis @ ((low + high) / 2.0)[:, :, None])[:, :, 0]
    return centre, (basis * ((high - low) / 2.0)[:, None, :]).transpose(2, 0, 1), np.sqrt((beside * beside).sum(axis=2).max(axis=1))


def _row_counts(hit: np.ndarray) -> np.ndarray:
    """True cells of every row of LEAF cells, eight at a time."""
    return ((hit.view("u8").sum(axis=1) * np.uint64(0x0101010101010101)) >> np.uint64(56)).astype("i8")


class BetterCount:
    """How many items beat the query's own score; ties count when the item id is lower."""

    schema = "grp bigint, query_id bigint, better bigint"

    def start(self, n: int):
        return np.zeros(n, dtype="i8"), np.zeros(n, dtype=bool)

    def fold_many(self, state, at, q, q_ids, own, x, x_ids) -> None:
        """``fold`` of many items.

        Items are dealt into leaves.  Bounds tell for most queries that all items of a leaf are ahead or none; the others
        take the products of the leaf, in 32 bits, and what those cannot tell in 64 bits.
        """
        count, seen = state
        seen[at] = True
        mark = np.round(own, TIE_DIGITS)
        with np.errstate(over="ignore", invalid="ignore"):
            large, size = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        fit, plain = large < 1e15, (size < 1e15) & (np.abs(mark) < 1e15)
        dealt = np.flatnonzero(fit)
        dealt = dealt[_deal(x[dealt])][: len(dealt) // LEAF * LEAF]
        rest = np.ones(len(x), bool)
        rest[dealt] = False
        first = at.start or 0

        def as_before(of: np.ndarray, items: np.ndarray) -> None:
            for i in range(0, len(of), QUERY_TILE):
                rows = of[i : i + QUERY_TILE]
                for j in range(0, len(items), ITEM_TILE):
                    part, found = items[j : j + ITEM_TILE], (np.zeros(len(rows), "i8"), np.zeros(len(rows), bool))
                    self.fold(found, slice(0, len(rows)), q[rows], q_ids[rows], own[rows], x[part], x_ids[part])
                    count[first + rows] += found[0]

        as_before(np.arange(len(q)), np.flatnonzero(rest))
        as_before(np.flatnonzero(~plain), dealt)
        if not len(dealt):
            return
        ids = np.sort(x_ids[dealt])
        # A query without a direction is level with every item.
        level = np.flatnonzero(plain & (size == 0.0))
        lower, upto = (np.searchsorted(ids, q_ids[level], side) for side in ("left", "right"))
        count[first + level] += np.where(mark[level] < 0.0, len(ids) - (upto - lower), np.where(mark[level] == 0.0, lower, 0))
        rows = np.flatnonzero(plain & (size > 0.0))
        if len(rows):
            counted = self._in_leaves(q[rows], q_ids[rows], mark[rows], x[dealt], x_ids[dealt])
            count[first + rows] += counted - self._of_own_id(q[rows], q_ids[rows], mark[rows], x[dealt], x_ids[dealt])

    def _of_own_id(self, q, q_ids, mark, x, x_ids) -> np.ndarray:
        """How many items of the query's own id are ahead of it."""
        order = np.argsort(x_ids, kind="stable")
        lower, upto = (np.searchsorted(x_ids[order], q_ids, side) for side in ("left", "right"))
        n, ends = upto - lower, np.cumsum(upto - lower)
        out = np.zeros(len(q), "i8")
        for i in range(0, int(ends[-1]), 1_000_000):
            pair = np.arange(i, min(i + 1_000_000, ends[-1]))
            r = np.searchsorted(ends, pair, "right")
            c = order[lower[r] + pair - (ends[r] - n[r])]
            out += np.bincount(r[_pair_sums(_inner, q, x, r, c) > mark[r]], minlength=len(q))
        return out

    def _in_leaves(self, q, q_ids, mark, x, x_ids) -> np.ndarray:
        """How many items are ahead, those of the query's own id too; items lie leaf by leaf."""
        count, (n, width) = np.zeros(len(q), "i8"), x.shape
        leaves = x.reshape(n // LEAF, LEAF, width)
        size = np.sqrt((q * q).sum(axis=1))
        most, far = float(size.max()), float(np.sqrt((x * x).sum(axis=1).max()))
        room = (width + 8) * 2.0**-23 * (most * far + float(np.abs(mark).max())) + 4.0 * 10.0**-TIE_DIGITS
        slack = np.float32(2.0 * (DIRECTIONS + 2) * room)
        above, below = np.nextafter(np.float32(room), np.float32(np.inf)), -np.nextafter(np.float32(room), np.float32(np.inf))
        product = np.empty((LEAF_ROWS, LEAF), "f4")
        hits = np.empty((2, LEAF_ROWS, LEAF), bool)
        queries = np.concatenate([q, mark[:, None]], axis=1).astype("f4")
        minus = np.full((len(leaves), 1), -1.0)
        open_pairs: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            r, c = (np.concatenate(p) for p in zip(*open_pairs))
            scores = _pair_sums(_inner, q, x, r, c)
            better = (scores > mark[r]) | ((scores == mark[r]) & (x_ids[c] < q_ids[r]))
            count[:] += np.bincount(r[better], minlength=len(q))
            open_pairs.clear()

        waiting = 0
        for k in range(0, len(leaves), LEAF_TILE):
            tile = leaves[k : k + LEAF_TILE]
            centre, spread, beside = _leaf_bounds(tile)
            centre = np.concatenate([centre, minus[: len(tile)]], axis=1).astype("f4")
            spread = spread.reshape(-1, width).astype("f4")
            beside = (beside * most).astype("f4")[:, None] + slack
            items = np.concatenate([tile, np.full((len(tile), LEAF, 1), -1.0)], axis=2).astype("f4").transpose(0, 2, 1).copy()
            for j in range(0, len(q), LEAF_QUERIES):
                mine = queries[j : j + LEAF_QUERIES]
                score = centre @ mine.T
                reach = np.abs(spread @ mine[:, :-1].T).reshape(-1, *score.shape).sum(axis=0)
                reach += beside
                ahead = score > reach
                undecided = np.abs(score) <= reach
                n_open = np.count_nonzero(undecided, axis=1)
                crowded = n_open > MOST_OPEN * len(mine)
                ahead[crowded] = False
                count[j : j + LEAF_QUERIES] += LEAF * ahead.sum(axis=0, dtype="i8")
                for i in np.flatnonzero(n_open):
                    at = np.arange(len(mine)) if crowded[i] else np.flatnonzero(undecided[i])
                    for a in range(0, len(at), LEAF_ROWS):
                        rows = at[a : a + LEAF_ROWS]
                        p, (sure, maybe) = product[: len(rows)], hits[:, : len(rows)]
                        np.matmul(mine[rows], items[i], out=p)
                        np.greater(p, above, out=sure)
                        np.greater_equal(p, below, out=maybe)
                        found = _row_counts(sure)
                        near = _row_counts(maybe) - found
                        rows += j
                        some = np.flatnonzero(near)
                        if FEW_HITS * near.sum() > LEAF * len(some):  # much the same items: their products in 64 bits
                            many = some[FEW_HITS * near[some] > LEAF]
                            own_ids, marks = q_ids[rows[many]][:, None], mark[rows[many]][:, None]
                            scores, c = np.round(q[rows[many]] @ tile[i].T, TIE_DIGITS), x_ids[(k + i) * LEAF : (k + i + 1) * LEAF]
                            found[many] = np.count_nonzero((scores > marks) | ((scores == marks) & (c[None, :] < own_ids)), axis=1)
                            some = some[FEW_HITS * near[some] <= LEAF]
                        count[rows] += found
                        if len(some):
                            r, c = np.divmod(np.flatnonzero(maybe[some] ^ sure[some]), LEAF)
                            open_pairs.append((rows[some[r]], c + (k + i) * LEAF))
                            waiting += len(r)
                            if waiting > 1_000_000:
                                settle()
                                waiting = 0
        if open_pairs:
            settle()
        return count

    def fold(self, state, at, q, q_ids, own, x, x_ids):
        count, seen = state
        seen[at] = True
        mark = np.round(own, TIE_DIGITS)
        room = _room(q, x)
        if room is not None:
            product = _products(q, x)
            ahead = product > -_down(-(mark + room))[:, None]
            near = (product >= _down(mark - room)[:, None]) ^ ahead
            if FEW_HITS * np.count_nonzero(near) <= near.size:
                # The query's own item is nowhere ahead of it.
                mine = np.flatnonzero(np.isin(x_ids, q_ids))
                ahead[:, mine] &= q_ids[:, None] != x_ids[mine][None, :]
                count[at] += [np.count_nonzero(row) for row in ahead]
                r, c = np.divmod(np.flatnonzero(near), near.shape[1])
                scores, marks = _pair_sums(_inner, q, x, r, c), mark[r]
                better = ((scores > marks) | ((scores == marks) & (x_ids[c] < q_ids[r]))) & (x_ids[c] != q_ids[r])
                count[at] += np.bincount(r[better], minlength=len(q))
                return
        scores, mark = np.round(q @ x.T, TIE_DIGITS), mark[:, None]
        other = x_ids[None, :] != q_ids[:, None]
        ahead = (scores > mark) | ((scores == mark) & (x_ids[None, :] < q_ids[:, None]))
        count[at] += (ahead & other).sum(axis=1)

    def emit(self, state, groups, q_ids):
        count, seen = state
        return [groups[seen], q_ids[seen], count[seen]]


class LogSumExp:
    """Running maximum and shifted sum of ``exp(score / temperature)``."""

    schema = "grp bigint, query_id bigint, peak double, mass double"

    def __init__(self, temperature: float):
        self.temperature = temperature

    def start(self, n: int):
        return np.full(n, -np.inf), np.zeros(n)

    def fold(self, state, at, q, q_ids, own, x, x_ids):
        peak, mass = state
        logits = q @ x.T / self.temperature
        top = np.maximum(peak[at], logits.max(axis=1))
        mass[at] = mass[at] * np.exp(peak[at] - top) + np.exp(logits - top[:, None]).sum(axis=1)
        peak[at] = top

    def emit(self, state, groups, q_ids):
        peak, mass = state
        seen = mass > 0.0
        return [groups[seen], q_ids[seen], peak[seen], mass[seen]]


def _names(schema: str) -> list[str]:
    return [part.split()[0] for part in schema.split(",")]


def _canonical(df: DataFrame, key: str, vec: str, group: str | None, own: str | None = None) -> DataFrame:
    cols = [
        (F.lit(0) if group is None else F.col(group)).cast("bigint").alias("grp"),
        F.col(key).cast("bigint").alias("id"),
        F.col(vec).alias("vec"),
    ]
    if own is not None:
        cols.append(F.col(own).cast("double").alias("own"))
    return df.select(*cols)


def _columns(table: pa.Table, unit: bool):
    grp, ids = (table.column(c).to_numpy() for c in ("grp", "id"))
    own = table.column("own").to_numpy() if "own" in table.column_names else np.zeros(len(ids))
    matrix = to_matrix(table.column("vec"))
    return grp, ids, unit_rows(matrix) if unit else matrix, own


def block_join(
    queries: DataFrame,
    items: DataFrame,
    fold,
    query_key: str = "query_id",
    item_key: str = "vec_id",
    query_vec: str = "vec",
    item_vec: str = "vec",
    group: str | None = None,
    own: str | None = None,
    unit: bool = True,
    broadcast_cells: int = MAX_BROADCAST_CELLS,
    query_rows: int | None = None,
    item_rows: int | None = None,
) -> DataFrame:
    """Partial results of ``fold``: several rows per query, to be merged by the caller.

    Vectors travel as stored (32-bit floats stay so) and are normalized block by block if ``unit``.  Blocks have
    ``query_rows`` and ``item_rows`` rows, and more where that would copy a row more than MAX_COPIES times; none holds more
    than BLOCK_BYTES of vectors, by which a table of any size is cut.
    """
    q = _canonical(queries, query_key, query_vec, group, own)
    x = _canonical(items, item_key, item_vec, group)
    head = q.limit(1).toArrow().column("vec")
    width = max(1, len(head[0])) if len(head) else 1
    block = max(QUERY_TILE, BLOCK_BYTES // (8 * width))
    query_rows, item_rows = query_rows or BLOCK_ROWS, item_rows or BLOCK_ROWS
    if broadcast_cells:
        small = collect_bounded(q, broadcast_cells // width)
        if small is not None:
            return _beside_items(x, small, fold, unit, item_rows, block)
    return _grid(q, x, fold, unit, grouped=group is not None, query_rows=query_rows, item_rows=item_rows, most=block)


def _fold_groups(fold, state, queries, items, item_rows: int) -> None:
    """Fold the items into the state of the queries of the same group; queries are sorted by group."""
    q_grp, q_ids, q, own = queries
    grp, ids, x, _ = items
    item_rows = min(item_rows, ITEM_TILE)
    by_group = np.argsort(grp, kind="stable")
    starts = np.flatnonzero(np.diff(grp[by_group], prepend=grp[by_group[0]] - 1))
    for lo, hi in zip(starts, [*starts[1:], len(grp)]):
        value = grp[by_group[lo]]
        q_lo, q_hi = np.searchsorted(q_grp, [value, value + 1])
        if hi - lo >= MANY_ITEMS and q_lo < q_hi and hasattr(fold, "fold_many"):
            at, rows = slice(q_lo, q_hi), by_group[lo:hi]
            fold.fold_many(state, at, q[at], q_ids[at], own[at], x[rows], ids[rows])
            continue
        i, step = lo, min(FIRST_TILE, item_rows)
        while i < hi:
            rows = by_group[i : min(i + step, hi)]
            i, step = i + step, min(4 * step, item_rows)
            for j in range(q_lo, q_hi, QUERY_TILE):
                at = slice(j, min(j + QUERY_TILE, q_hi))
                fold.fold(state, at, q[at], q_ids[at], own[at], x[rows], ids[rows])


def _beside_items(x: DataFrame, queries: pa.Table, fold, unit: bool, item_rows: int, split_rows: int) -> DataFrame:
    """``split_rows`` is about what a task reads of the items in place."""
    if queries.num_rows * split_rows > TASK_PAIRS // 16:
        # So many queries that a task's own share of the items would keep it too long.
        pairs, cores = queries.num_rows * x.count(), x.sparkSession.sparkContext.defaultParallelism
        x = x.repartition(max(1, -(-pairs // TASK_PAIRS), min(cores, 8 * pairs // TASK_PAIRS)))
    shipped = x.sparkSession.sparkContext.broadcast(
        queries.sort_by([("grp", "ascending"), ("id", "ascending")]).combine_chunks()
    )
    names = _names(fold.schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = _columns(shipped.value, unit)
        state = fold.start(len(queries[1]))
        for batch in batches:
            if batch.num_rows and len(queries[1]):
                _fold_groups(fold, state, queries, _columns(pa.Table.from_batches([batch]), unit), item_rows)
        out = fold.emit(state, queries[0], queries[1])
        if len(out[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    # Every task emits up to k rows per query, so there should not be far more tasks than cores.
    tasks = max(SCAN_TASKS, 8 * x.sparkSession.sparkContext.defaultParallelism)
    x = x.coalesce(tasks)
    return x.mapInArrow(scan, fold.schema)


def _grid(q: DataFrame, x: DataFrame, fold, unit: bool, grouped: bool, query_rows: int, item_rows: int, most: int) -> DataFrame:
    names, apart = _names(fold.schema), 0

    def sizes(df: DataFrame) -> DataFrame:
        return df.groupBy("grp").agg(F.count(F.lit(1)).alias("n"))

    def block_count(n: Column, rows: int) -> Column:
        return F.greatest(F.ceil(n / most), F.least(F.ceil(n / rows), F.lit(MAX_COPIES))).cast("int")

    def blocks(df: DataFrame, rows: int, name: str) -> DataFrame:
        """Groups needing more than one block, with their number of blocks."""
        return sizes(df).where(F.col("n") > rows).select("grp", block_count(F.col("n"), rows).alias(name))

    if grouped:
        # Groups that fit into one block on both sides share grid cells of about one block's rows; a
        # larger group has grid cells of its own.
        packs = max(1, -(-q.count() // query_rows), -(-x.count() // item_rows))
        heavy = broadcast_checked(blocks(q, query_rows, "n_qb").join(shuffled(blocks(x, item_rows, "n_ib")), "grp", "full"))
        q, x = (shuffled(df).join(heavy, "grp", "left") for df in (q, x))
        single = F.col("n_qb").isNull() & F.col("n_ib").isNull()
        shared = F.pmod(F.xxhash64("grp"), F.lit(packs))
        cell = F.when(single, F.struct(shared.alias("pack"), F.lit(None).cast("bigint").alias("alone"))).otherwise(
            F.struct(F.lit(None).cast("bigint").alias("pack"), F.col("grp").alias("alone"))
        )
    else:
        n_q, n_x = q.count(), x.count()
        n_qb, n_ib = (max(-(-n // most), min(-(-n // rows), MAX_COPIES)) for n, rows in ((n_q, query_rows), (n_x, item_rows)))
        q, x = (df.withColumns({"n_qb": F.lit(n_qb), "n_ib": F.lit(n_ib)}) for df in (q, x))
        cell = F.lit(0)
        if n_q * n_x > TASK_PAIRS:
            apart = CELL_PARTITIONS * n_qb * n_ib
    q, x = q.withColumn("cell", cell), x.withColumn("cell", cell)

    def spread(df: DataFrame, mine: str, my_count: str, other: str, other_count: str) -> DataFrame:
        own_block = F.pmod(F.xxhash64("id"), F.greatest(F.coalesce(F.col(my_count), F.lit(1)), F.lit(1)))
        copies = F.sequence(F.lit(0), F.greatest(F.coalesce(F.col(other_count), F.lit(1)), F.lit(1)) - 1)
        out = df.withColumn(mine, own_block.cast("int")).withColumn(other, F.explode(copies))
        return out.drop("n_qb", "n_ib")

    q = spread(q, "qb", "n_qb", "ib", "n_ib")
    x = spread(x, "ib", "n_ib", "qb", "n_qb")
    keys = ("cell", "qb", "ib")
    if apart:
        q, x = (df.repartition(apart, *keys) for df in (q, x))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            out = [[] for _ in names]
        else:
            queries = _columns(left.sort_by("grp"), unit)
            state = fold.start(len(queries[1]))
            _fold_groups(fold, state, queries, _columns(right, unit), item_rows)
            out = fold.emit(state, queries[0], queries[1])
        schema = pa.schema([(n, pa.float64() if n in ("score", "peak", "mass") else pa.int64()) for n in names])
        return pa.table([pa.array(c, type=t) for c, t in zip(out, schema.types)], schema=schema)

    return q.groupBy(*keys).cogroup(x.groupBy(*keys)).applyInArrow(meet, fold.schema)
