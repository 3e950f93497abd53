"""Language of documents by interpolated Kneser-Ney character models.

One model per language over lower-cased letters; anything else is one boundary symbol.  Counts of the
highest order come from all labelled documents: counted per task in numpy, summed by Spark.  Counts of
lower orders are continuation counts, so they follow from the distinct n-grams of the highest order.
N-grams are 64-bit hashes that pack 16 bits a symbol (exact on the basic plane), held in sorted arrays:
a lookup is a binary search.  N-grams too many to ship to every task stay stored tables, and the n-grams of the
documents are joined with them; the probabilities are the same, and no n-gram is left out either way.
A document takes the language with the lowest cross-entropy per symbol.
Confidence and rejection are calibrated on a bounded sample of the labelled documents, which the counts leave out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.functions.matrix import from_matrix
from corvane.llm.common import byte_slices, code_points, id_text, stored

ORDER = 4
# Calibration looks at about this many labelled documents, the same number and at most this share of each language, and at none
# of a language with few.
CALIBRATION_DOCS, CALIBRATION_SHARE, CALIBRATION_LEAST = 2_000, 0.1, 20
# A model of so many n-grams at most (all languages together, 40 to 100 bytes each) ships to every task; a larger
# one is joined with.
MAX_NGRAMS = 1_500_000
UNKNOWN = "und"
# A document is rejected when its cross-entropy lies beyond this share of its language's own documents.
ACCEPTED_SHARE = 0.999


@cache
def symbols() -> np.ndarray:
    """Symbol of every code point: the lower-case letter or mark in 16 bits, 0 for all else."""
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, "u2")
    for match in regex.finditer(r"[\p{L}\p{M}]", every):
        low = match[0].lower()
        point = ord(low) if len(low) == 1 else ord(match[0])
        out[ord(match[0])] = point if point < 0x10000 else 0xD800 + point % 0x800  # the unused range
    return out


@cache
def letters() -> np.ndarray:
    import regex

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    out = np.zeros(0x110000, bool)
    for match in regex.finditer(r"\p{L}", every):
        out[ord(match[0])] = True
    return out


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the ORDER symbols that end at each place, first place of each text (with the end), has a letter.

    Runs of boundaries are one; each text starts as after boundaries.
    """
    points, at, _ = code_points(data, offsets)
    sym = symbols()[points].astype("u8")
    n_texts = len(offsets) - 1
    text = np.repeat(np.arange(n_texts), np.diff(at))
    first = np.zeros(len(sym), bool)
    first[at[:-1][np.diff(at) > 0]] = True
    keep = sym > 0
    keep[1:] |= (sym[:-1] > 0) & ~first[1:]
    has = np.bincount(text[letters()[points]], minlength=n_texts) > 0
    sym, text = sym[keep], text[keep]
    starts = np.searchsorted(text, np.arange(n_texts + 1))
    key = sym.copy()
    place = np.arange(len(sym)) - starts[text]
    for back in range(1, ORDER):
        key[back:] |= np.where(place[back:] >= back, sym[:-back] << np.uint64(16 * back), np.uint64(0))
    return key, starts, has


def count_ngrams(docs: DataFrame, lang: str = "lang") -> DataFrame:
    """``lang, key, n`` over all of ``docs`` (columns id, text and the label)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {}

        def add(name: str, keys: np.ndarray, counts: np.ndarray) -> None:
            if name in held:
                both = np.concatenate([held[name][0], keys])
                keys, inverse = np.unique(both, return_inverse=True)
                counts = np.bincount(inverse, np.concatenate([held[name][1], counts]), len(keys)).astype("i8")
            held[name] = [keys, counts]

        def emit() -> Iterator[pa.RecordBatch]:
            for name, (keys, counts) in held.items():
                for k in range(0, len(keys), 50_000):
                    part = keys[k : k + 50_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part), pa.string()), pa.array(part.view("i8")), pa.array(counts[k : k + 50_000])], names=["lang", "key", "n"]
                    )
            held.clear()

        for batch in batches:
            for part, data, offsets in byte_slices(batch.sort_by("lang")):
                key, starts, _ = ngrams(data, offsets)
                names = np.array(part.column(2).to_pylist(), object)
                cuts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
                for a, b in zip(cuts, cuts[1:]):
                    add(names[a], *np.unique(key[starts[a] : starts[b]], return_counts=True))
            if sum(len(keys) for keys, _ in held.values()) > 1_000_000:
                yield from emit()  # bounds the memory of a task; Spark adds up
        yield from emit()

    counted = docs.select("id", "text", lang).mapInArrow(run, "lang string, key bigint, n bigint")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model:
    """Interpolated Kneser-Ney probabilities of all languages over one sorted array of hashes per order."""

    def __init__(self, langs: list[str], lang: np.ndarray, key: np.ndarray, n: np.ndarray):
        self.langs = langs
        n_langs = len(langs)
        self.seen: list[tuple[np.ndarray, np.ndarray]] = []  # order -> n-grams, discounted share per language
        self.left: list[tuple[np.ndarray, np.ndarray]] = []  # order -> contexts, share left to the lower order
        alphabet = np.unique(key & np.uint64(0xFFFF))
        self.base = 1.0 / (len(alphabet) + 1)
        grams, counts, who = key, n.astype("f8"), lang
        levels = []
        for order in range(ORDER, 0, -1):
            context = grams >> np.uint64(16)
            code = np.unique(context)
            slot = np.searchsorted(code, context) * n_langs + who
            total = np.bincount(slot, counts, len(code) * n_langs)
            kinds = np.bincount(slot, minlength=len(code) * n_langs)
            once, twice = (np.bincount(who[counts == c], minlength=n_langs) for c in (1, 2))
            discount = np.clip((once + 0.5) / (once + 2 * twice + 1.0), 0.1, 0.95)
            share = np.maximum(counts - discount[who], 0) / total[slot]
            known = np.unique(grams)
            matrix = np.zeros((len(known), n_langs))
            matrix[np.searchsorted(known, grams), who] = share
            with np.errstate(invalid="ignore", divide="ignore"):
                left = np.where(total > 0, np.tile(discount, len(code)) * kinds / total, 1.0).reshape(-1, n_langs)
            levels.append(((known, matrix), (code, left)))
            # Continuation counts: in how many ways the shorter n-gram is led up to.
            mask = np.uint64((1 << 16 * (order - 1)) - 1)
            pair = np.unique(np.stack([grams & mask, who.astype("u8")], 1), axis=0, return_counts=True) if order > 1 else None
            if pair is not None:
                grams, who, counts = pair[0][:, 0].copy(), pair[0][:, 1].astype("i8"), pair[1].astype("f8")
        for seen, left in reversed(levels):
            self.seen.append(seen)
            self.left.append(left)
        self.keys = self.seen[-1][0]
        self.logs = np.log(self._probability(self.keys, ORDER)).astype("f4")

    @staticmethod
    def _find(table: tuple[np.ndarray, np.ndarray], keys: np.ndarray, missing: float) -> np.ndarray:
        at = np.searchsorted(table[0], keys)
        at[at == len(table[0])] = 0
        return np.where((table[0][at] == keys)[:, None], table[1][at], missing) if len(table[0]) else np.full((len(keys), table[1].shape[1]), missing)

    def _probability(self, keys: np.ndarray, order: int) -> np.ndarray:
        if order == 0:
            return np.full((len(keys), len(self.langs)), self.base)
        lower = self._probability(keys & np.uint64((1 << 16 * (order - 1)) - 1), order - 1)
        share = self._find(self.seen[order - 1], keys, 0.0)
        return share + self._find(self.left[order - 1], keys >> np.uint64(16), 1.0) * lower

    def log_probability(self, keys: np.ndarray) -> np.ndarray:
        """(n, languages): n-grams in the sorted array at once, others through the lower orders."""
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        out = self.logs[at]
        new = np.flatnonzero(self.keys[at] != keys)
        if len(new):
            out[new] = np.log(self._probability(keys[new], ORDER))
        return out

    def cross_entropy(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) nats per symbol, and whether a text has a letter."""
        key, starts, has = ngrams(data, offsets)
        out = np.zeros((len(has), len(self.langs)))
        some = np.flatnonzero(np.diff(starts) > 0)
        if len(some):
            distinct, inverse = np.unique(key, return_inverse=True)
            logs = self.log_probability(distinct)
            for k in range(len(self.langs)):
                out[some, k] = -np.add.reduceat(logs[:, k].astype("f8")[inverse], starts[some]) / np.diff(starts)[some]
        return out, has


class Tables:
    """The probabilities of ``Model`` in stored tables, for any number of n-grams.

    Per order ``key, share`` of the n-grams and ``context, left`` of their contexts, both arrays by language.
    """

    def __init__(self, counted: DataFrame):
        self.langs = sorted(r.lang for r in counted.select("lang").distinct().collect())
        self.base = 1.0 / (counted.select(F.col("key").bitwiseAND(F.lit(0xFFFF))).distinct().count() + 1)
        self.seen: list[DataFrame] = []
        self.left: list[DataFrame] = []
        code = F.create_map(*[F.lit(x) for k, name in enumerate(self.langs) for x in (name, k)])
        grams = counted.select(code[F.col("lang")].alias("who"), "key", F.col("n").cast("double").alias("n"))
        for order in range(ORDER, 0, -1):
            grams = stored(grams.withColumn("context", F.shiftrightunsigned("key", 16)), f"grams_{order}")
            few = {r.who: r for r in grams.groupBy("who").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("twice")).collect()}
            few = [few[k] for k in range(len(self.langs))]
            discounts = [float(np.clip((r.once + 0.5) / (r.once + 2 * r.twice + 1.0), 0.1, 0.95)) for r in few]
            discount = F.array(*map(F.lit, discounts))[F.col("who")]
            totals = grams.groupBy("who", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
            shares = grams.join(totals, ["who", "context"]).select("key", "who", (F.greatest(F.col("n") - discount, F.lit(0.0)) / F.col("total")).alias("value"))
            rest = totals.select("context", "who", (discount * F.col("kinds") / F.col("total")).alias("value"))
            self.seen.insert(0, stored(self._wide(shares, "key", "share", 0.0), f"seen_{order}"))
            self.left.insert(0, stored(self._wide(rest, "context", "left", 1.0), f"left_{order}"))
            grams = grams.groupBy("who", self._shorter(order).alias("key")).agg(F.count(F.lit(1)).cast("double").alias("n"))

    @staticmethod
    def _shorter(order: int) -> Column:
        return F.col("key").bitwiseAND(F.lit((1 << 16 * (order - 1)) - 1))

    def _each(self, value: Callable[[Column], Column]) -> Column:
        """An array with ``value`` of every language's number."""
        return F.transform(F.sequence(F.lit(0), F.lit(len(self.langs) - 1)), value)

    def _wide(self, rows: DataFrame, key: str, name: str, missing: float) -> DataFrame:
        by_lang = rows.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("who", "value"))).alias("by_lang"))  # as many as languages
        return by_lang.select(key, self._each(lambda k: F.coalesce(F.try_element_at("by_lang", k), F.lit(missing))).alias(name))

    def _probability(self, keys: DataFrame, order: int = ORDER) -> DataFrame:
        """``key, p`` (by language) of the distinct ``key``."""
        rows = keys.join(self.seen[order - 1], "key", "left").withColumn("context", F.shiftrightunsigned("key", 16)).join(self.left[order - 1], "context", "left")
        if order > 1:
            lower = self._probability(keys.select(self._shorter(order).alias("key")).distinct(), order - 1).toDF("shorter", "lower")
            rows = rows.withColumn("shorter", self._shorter(order)).join(lower, "shorter")
        else:
            rows = rows.withColumn("lower", F.array_repeat(F.lit(self.base), len(self.langs)))
        p = self._each(lambda k: F.coalesce(F.col("share")[k], F.lit(0.0)) + F.coalesce(F.col("left")[k], F.lit(1.0)) * F.col("lower")[k])
        return rows.select("key", p.alias("p"))

    def cross_entropy(self, rows: DataFrame) -> DataFrame:
        """``id, lang, has, entropy`` (by language) per row of ``id, text, lang``; see ``Model.cross_entropy``."""
        kind = "row bigint, id bigint, lang string, has boolean, size bigint, key bigint, n bigint"
        names = ["row", "id", "lang", "has", "size", "key", "n"]

        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row per text, and one per text and distinct n-gram."""
            for batch in batches:
                for part, data, offsets in byte_slices(batch):
                    key, starts, has = ngrams(data, offsets)
                    row, none = part.column(3).to_numpy(), pa.nulls(part.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([part.column(3), part.column(0), part.column(2), pa.array(has), pa.array(np.diff(starts), pa.int64()), none, none], names=names)
                    text = np.repeat(np.arange(len(has)), np.diff(starts))
                    order = np.lexsort((key, text))
                    key, text = key[order].view("i8"), text[order]
                    first = np.ones(len(key), bool)
                    first[1:] = (key[1:] != key[:-1]) | (text[1:] != text[:-1])
                    at = np.flatnonzero(first)
                    n = np.diff(np.append(at, len(key)))
                    for k in range(0, len(at), 50_000):
                        some = at[k : k + 50_000]
                        empty = [pa.nulls(len(some), t) for t in (pa.int64(), pa.string(), pa.bool_(), pa.int64())]
                        yield pa.RecordBatch.from_arrays([pa.array(row[text[some]]), *empty, pa.array(key[some]), pa.array(n[k : k + 50_000])], names=names)

        parts = stored(rows.select("id", "text", "lang", F.monotonically_increasing_id().alias("row")).mapInArrow(split, kind), "text_ngrams")
        grams = parts.where(F.col("key").isNotNull()).select("row", "key", "n")
        logs = self._probability(stored(grams.select("key").distinct(), "text_keys")).select("key", F.transform("p", lambda p: F.log(p)).alias("log"))
        sums = grams.join(logs, "key").groupBy("row").agg(*[F.sum(F.col("n") * F.col("log")[k].cast("float").cast("double")).alias(f"sum_{k}") for k in range(len(self.langs))])
        entropy = F.array(*[F.coalesce(-F.col(f"sum_{k}") / F.greatest("size", F.lit(1)), F.lit(0.0)) for k in range(len(self.langs))])
        return parts.where(F.col("key").isNull()).select("row", "id", "lang", "has", "size").join(sums, "row", "left").select("id", "lang", "has", entropy.alias("entropy"))


def confidence(entropy: np.ndarray, sharpness: float) -> np.ndarray:
    x = -sharpness * entropy
    x = np.exp(x - x.max(axis=1, keepdims=True))
    return x / x.sum(axis=1, keepdims=True)


def _entropies(model: Model | Tables, rows: DataFrame) -> DataFrame:
    """``id, lang, has, entropy`` (by language) per row of ``id, text, lang``."""
    if isinstance(model, Tables):
        return model.cross_entropy(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in byte_slices(batch):
                entropy, has = model.cross_entropy(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(has), from_matrix(entropy)], names=["id", "lang", "has", "entropy"])

    return rows.select("id", "text", "lang").mapInArrow(run, "id bigint, lang string, has boolean, entropy array<double>")


def left_out(rows: DataFrame, docs: int = CALIBRATION_DOCS) -> Column:
    """Whether a labelled row is for calibration: drawn by its hash, at a rate that its language's size gives.

    One aggregated row a language goes through the driver.
    """
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    each = docs / max(1, len(sizes))
    rates = {k: int(1_000_000 * min(CALIBRATION_SHARE, each / n)) for k, n in sizes.items() if n >= CALIBRATION_LEAST}
    if not rates:
        return F.lit(False)
    rate = F.create_map(*[F.lit(x) for pair in rates.items() for x in pair])[F.col("lang")]
    return F.pmod(F.xxhash64("id", "text"), F.lit(1_000_000)) < F.coalesce(rate, F.lit(0))


def _by_lang(column: pa.Array | pa.ChunkedArray, n_langs: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, n_langs)


def fit(docs: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[Model | Tables, float, np.ndarray]:
    """Model, sharpness of the confidence and highest accepted cross-entropy per language."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), text.alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(usable & F.col("lang").isNotNull())
    aside = left_out(rows)
    counted = stored(count_ngrams(rows.where(~aside)), "ngrams")
    if counted.count() > MAX_NGRAMS:
        model: Model | Tables = Tables(counted)
        code = {name: k for k, name in enumerate(model.langs)}
    else:
        table = counted.toArrow()
        names = np.array(table.column("lang").to_pylist(), object)
        code = {name: k for k, name in enumerate(sorted(set(names.tolist())))}
        who = np.fromiter((code[x] for x in names), "i8", len(names))
        model = Model(list(code), who, table.column("key").to_numpy().view("u8"), table.column("n").to_numpy())
    langs = model.langs
    sharpness, highest = 20.0, np.full(len(langs), np.inf)
    # Texts stay where they are: a few numbers a drawn document come back.
    measured = _entropies(model, rows.where(aside)).where("has").select("lang", "entropy").toArrow() if langs else None
    if measured is not None and measured.num_rows:
        true = np.array([code.get(x, -1) for x in measured["lang"].to_pylist()])
        entropy, true = _by_lang(measured["entropy"], len(langs))[true >= 0], true[true >= 0]
        if len(true):
            tries = np.geomspace(1, 1000, 30)
            loss = [-np.log(confidence(entropy, s)[np.arange(len(true)), true] + 1e-9).mean() for s in tries]
            sharpness = float(tries[int(np.argmin(loss))])
            own = entropy[np.arange(len(true)), true]
            for k in range(len(langs)):
                if (true == k).any():
                    highest[k] = np.quantile(own[true == k], ACCEPTED_SHARE)
    return model, sharpness, highest


def predict(docs: DataFrame, model: Model, sharpness: float, highest: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, lang_pred, score, cross_entropy, accepted``.

    A text that is null or has no letter gives ``und``, score 0 and is not accepted; so does any text when no
    language was learned.  Equal cross-entropies go to the first language by name.  A rejected text scores below 0.5.
    """
    names = ["doc_id", "lang_pred", "score", "cross_entropy", "accepted"]

    kind = "doc_id bigint, lang_pred string, score double, cross_entropy double, accepted boolean"
    langs = np.array([*model.langs, UNKNOWN], object)

    def decided(ids: pa.Array, entropy: np.ndarray, has: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        best, score, low, ok = np.full(n, len(langs) - 1), np.zeros(n), np.zeros(n), np.zeros(n, bool)
        if len(langs) > 1:
            k = entropy.argmin(1)
            best[has], low[has] = k[has], entropy[np.arange(n), k][has]
            ok = has & (low <= highest[k])
            # Text beyond what the language's own documents reach is rejected, and the farther the less it scores.
            far = np.where(ok, 1.0, 0.5 * np.where(np.isfinite(highest[k]), highest[k], 1.0) / np.maximum(low, 1e-9))
            score[has] = (confidence(entropy, sharpness)[np.arange(n), k] * np.minimum(far, 1.0))[has]
        return pa.RecordBatch.from_arrays([ids, pa.array(langs[best], pa.string()), pa.array(score), pa.array(low), pa.array(ok)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in byte_slices(batch):
                entropy, has = model.cross_entropy(data, offsets) if model.langs else (None, None)
                yield decided(part.column(0), entropy, has)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield decided(batch.column(0), _by_lang(batch.column(2), len(langs) - 1), batch.column(1).to_numpy(zero_copy_only=False))

    rows = id_text(docs, id_col, text_col)
    if isinstance(model, Tables):
        rows = model.cross_entropy(rows.withColumn("lang", F.lit(None).cast("string")))
        return rows.select("id", "has", "entropy").mapInArrow(joined, kind)
    return rows.mapInArrow(run, kind)
