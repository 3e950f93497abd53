"""Quality of documents by a byte-level convolutional network.

Bytes are embedded, learned filters of eight bytes pass over the whole document in steps of four, their
responses are max-pooled within overlapping chunks that cover every byte, and the mean of the chunks'
pooled responses goes into one logistic unit.  Training (back-propagation in numpy, Adam) runs on the
driver over a bounded sample of labelled documents; scoring is one pass over slices of texts in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from corvane.llm.common import SMALL_SLICE_BYTES, by_slices, byte_slices, give_back, id_text, large_binary
from corvane.runtime import spread_small

STEP = 4  # bytes from one filter position to the next; a filter spans two steps
CHUNK, CHUNK_STEP = 64, 48  # filter positions of a chunk (260 bytes), and from chunk to chunk
EMBED, FILTERS = 8, 24
THRESHOLD = 0.3

# Bounds of the training sample: documents of each label, and characters of a document; a longer one gives a passage, drawn by
# its id's hash, since the network learns from chunks.
SAMPLE_PER_LABEL = 1_000
SAMPLE_CHARS = 60_000
# Filter positions that are worked out at a time (some 250 bytes each): a text of any length goes through in windows.
WINDOW_STEPS = 1 << 18
# A small sample is gone through until about so many texts were drawn.
MIN_DRAWS = 12_000


@dataclass
class Network:
    embed: np.ndarray  # (256, EMBED)
    first: np.ndarray  # (STEP * EMBED, FILTERS): the half of a filter on a step's bytes
    second: np.ndarray  # ... and on the bytes of the step after
    bias: np.ndarray
    weight: np.ndarray
    shift: np.ndarray  # (1,)

    @classmethod
    def start(cls, seed: int) -> "Network":
        draw = np.random.default_rng(seed).standard_normal
        wide = STEP * EMBED
        arrays = (draw((256, EMBED)) * 0.5, draw((wide, FILTERS)) / 8, draw((wide, FILTERS)) / 8, np.zeros(FILTERS), draw(FILTERS) / 5, np.zeros(1))
        return cls(*(a.astype("f4") for a in arrays))

    def arrays(self) -> list[np.ndarray]:
        return [self.embed, self.first, self.second, self.bias, self.weight, self.shift]


def layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts padded to whole steps and one more: the bytes by step, chunk bounds in steps, chunks per text.

    Padding is the byte 0; filter positions that would reach into the next text lie between chunks.
    """
    lengths = np.diff(offsets)
    steps = np.maximum(2, -(-lengths // STEP) + 1)
    first = np.cumsum(steps) - steps
    padded = np.zeros(int(steps.sum()) * STEP, "u1")
    if len(lengths) == 1:
        padded[: len(data)] = data
    else:
        padded[np.arange(len(data)) + np.repeat(first * STEP - offsets[:-1], lengths)] = data
    places = steps - 1  # filter positions
    chunks = np.maximum(1, -(-(places - CHUNK) // CHUNK_STEP) + 1)
    at = np.arange(chunks.sum()) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    begin = np.repeat(first, chunks) + at * CHUNK_STEP
    end = np.minimum(begin + CHUNK, np.repeat(first + places, chunks))
    return padded.reshape(-1, STEP), np.stack([begin, end], 1), chunks


def respond(net: Network, steps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Embedded steps, and the filters' responses at every step (the last one is not a position)."""
    wide = net.embed[steps].reshape(len(steps), -1)
    out = wide @ net.first
    out[:-1] += wide[1:] @ net.second
    out += net.bias
    return wide, np.maximum(out, 0, out=out)


def features(net: Network, steps: np.ndarray, bounds: np.ndarray, chunks: np.ndarray, window: int = WINDOW_STEPS) -> np.ndarray:
    """Mean over each text's chunks of the responses max-pooled in the chunk; a window of chunks at a time."""
    sums = np.zeros((len(chunks), FILTERS), "f4")
    text = np.repeat(np.arange(len(chunks)), chunks)
    k = 0
    while k < len(bounds):
        last = max(k + 1, int(np.searchsorted(bounds[:, 1], bounds[k, 0] + window, "right")))
        low, high = bounds[k, 0], bounds[last - 1, 1]
        _, out = respond(net, steps[low : high + 1])
        pooled = np.maximum.reduceat(out, (bounds[k:last] - low).ravel(), axis=0)[::2]
        own = text[k:last]
        begins = np.flatnonzero(np.diff(own, prepend=-1))
        sums[own[begins]] += np.add.reduceat(pooled, begins, axis=0)
        k = last
    return sums / chunks[:, None].astype("f4")


def logits(net: Network, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return (features(net, *layout(data, offsets)) @ net.weight + net.shift[0]).astype("f8")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def gradients(net: Network, data: np.ndarray, offsets: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
    """Gradients of the mean logistic loss over a few texts."""
    steps, bounds, chunks = layout(data, offsets)
    wide, out = respond(net, steps)
    n = int(chunks.sum())
    # Where in each chunk a filter responds most: chunks as rows of equal length, the rest never wins.
    at = bounds[:, :1] + np.arange(CHUNK)
    inside = at < bounds[:, 1:]
    at = np.where(inside, at, bounds[:, :1])
    best = np.take_along_axis(at, out[at].argmax(1).reshape(n, -1), 1)  # (chunk, filter) -> step
    pooled = out[best, np.arange(FILTERS)]
    text = np.repeat(np.arange(len(chunks)), chunks)
    mean = np.add.reduceat(pooled, np.cumsum(chunks) - chunks, axis=0) / chunks[:, None]
    error = ((sigmoid(mean @ net.weight + net.shift[0]) - label) / len(label)).astype("f4")
    d_pooled = (error / chunks)[text, None] * net.weight * (pooled > 0)
    d_first, d_second = np.empty_like(net.first), np.empty_like(net.second)
    d_embed = np.zeros_like(net.embed)
    for f in range(FILTERS):
        d, where = d_pooled[:, f], best[:, f]
        d_first[:, f], d_second[:, f] = d @ wide[where], d @ wide[where + 1]
        for half, k in ((net.first, where), (net.second, where + 1)):
            back = (d[:, None] * half[:, f]).reshape(-1, EMBED)
            for e in range(EMBED):
                d_embed[:, e] += np.bincount(steps[k].ravel(), back[:, e], 256)
    return [d_embed, d_first, d_second, d_pooled.sum(0), error @ mean, error.sum(keepdims=True)]


def train(texts: list[bytes], labels: np.ndarray, prior: float, seed: int = 7, epochs: int = 6, batch: int = 16, rate: float = 0.01) -> Network:
    """A network fitted to the sample; ``prior`` (share of label 1 among all labelled rows) sets its level."""
    net, draw = Network.start(seed), np.random.default_rng(seed)
    if not len(labels) or labels.min() == labels.max():
        net.weight[:] = 0
        net.shift[:] = np.log((prior + 1e-3) / (1 - prior + 1e-3))
        return net
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    epochs = max(epochs, MIN_DRAWS // len(texts))
    step, total = 0, epochs * -(-len(texts) // batch)
    for _ in range(epochs):
        order = draw.permutation(len(texts))
        for k in range(0, len(order), batch):
            chosen = order[k : k + batch]
            parts = [np.frombuffer(texts[i], "u1") for i in chosen]
            offsets = np.append(0, np.cumsum([len(p) for p in parts]))
            grads = gradients(net, np.concatenate(parts), offsets, labels[chosen])
            step += 1
            now = rate * (1 - step / (total + 1))
            for a, g, m, v in zip(net.arrays(), grads, first, second):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                a -= (now * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype("f4")
    share = float(labels.mean())
    net.shift += np.float32(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return net


def training_sample(
    docs: DataFrame, labels: DataFrame, usable: Column, label_col: str, per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS
) -> tuple[list[bytes], np.ndarray, float]:
    """At most ``per_label`` documents of each label, drawn by a hash of the id, and the share of label 1.

    Ids are drawn from the labels alone; texts come by a broadcast of those few ids.  Of a text of more than ``chars``
    characters a passage of that length is taken.  An id with both labels counts as label 1.
    """
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull())
    known = known.where(usable).groupBy("id").agg(F.max("label").alias("label"))
    draw = lambda v: known.where(F.col("label") == v).orderBy(F.xxhash64("id"), "id").limit(per_label)
    chosen = draw(0).unionByName(draw(1)).toArrow()  # bounded
    n = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    spark = docs.sparkSession
    ids = spark.createDataFrame(list(zip(chosen.column("id").to_pylist(), chosen.column("label").to_pylist())), "id bigint, label int")
    over = F.length("text") - chars
    passage = F.when(over > 0, F.substring("text", (F.pmod(F.xxhash64("id"), F.greatest(over, F.lit(1))) + 1).cast("int"), F.lit(chars))).otherwise(F.col("text"))
    found = id_text(docs).join(F.broadcast(ids), "id").select("id", "label", passage.alias("text"))
    rows = found.groupBy("id", "label").agg(F.min("text").alias("text")).select("id", "label", "text").toArrow().sort_by("id")
    values = large_binary(rows.column("text")).to_pylist() if rows.num_rows else []
    share = (n.get(1, 0) + 1) / (n.get(0, 0) + n.get(1, 0) + 2)
    return values, rows.column("label").to_numpy().astype("f4"), share


def score_documents(docs: DataFrame, net: Network, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, score`` (probability of label 1).

    Null and empty texts score as a text of no bytes; repeated rows give repeated results; texts of any
    length are read whole.
    """
    own = Network(*net.arrays())

    def scored(part: pa.RecordBatch, data: np.ndarray, offsets: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(sigmoid(logits(own, data, offsets)))], names=["doc_id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from by_slices(scored, batches, SMALL_SLICE_BYTES)

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id bigint, score double")


def filter_documents(docs: DataFrame, net: Network, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns as they are, whose text scores ``threshold`` or more; nothing is shuffled."""
    own = Network(*net.arrays())

    def good(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts = batch.column(batch.schema.get_field_index(text_col)).fill_null("")
        one = pa.RecordBatch.from_arrays([texts], names=["text"])
        scores = [sigmoid(logits(own, data, offsets)) for _, data, offsets in byte_slices(one, most=SMALL_SLICE_BYTES)]
        if scores:
            yield batch.filter(pa.array(np.concatenate(scores) >= threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = None
        for batch in batches:
            yield from good(batch)
        del batch
        give_back()

    return spread_small(docs).mapInArrow(run, docs.schema)
