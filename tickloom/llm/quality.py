"""A byte-level convolutional quality classifier in numpy.

A text's bytes are cut into overlapping chunks that cover all of it. Filters of six bytes,
three taps of two bytes each with a learned weight for each pair of bytes, respond at every
place; a chunk keeps each filter's largest response, and a text the mean, largest and least
of its chunks' (through a hyperbolic tangent), which a logistic layer combines into one
probability. Filters and layer are learned together by gradient descent (Adam): a filter's
gradient goes to the places of its largest responses.

Learning takes a bounded sample of labelled texts to the driver; scoring is one pass over
the documents without any shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import put, sample_window, schema_with, slices
from .words import text_bytes

CHUNK, STRIDE = 512, 448
TAPS, FILTERS = 3, 16
WIDTH = 2 * TAPS
#: The learning sample: texts of each label, and characters of each (of longer texts a stretch; they are scored whole).
SAMPLE_PER_LABEL, SAMPLE_CHARS = 700, 30_000
EPOCHS, BATCH, RATE = 8, 32, 0.02
_BLOCK = 128 * STRIDE


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 3; rows of 1 are held out from learning."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).cast("binary")) % 3


@dataclass
class Network:
    filters: np.ndarray = field(default_factory=lambda: np.zeros((TAPS, 65536, FILTERS), dtype=np.float32))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(3 * FILTERS, dtype=np.float64))
    bias: float = 0.0

    def responses(self, pairs: np.ndarray) -> np.ndarray:
        """For each place: the filters' sums. pairs: each byte with the one after it."""
        n = len(pairs) - 2 * (TAPS - 1)
        out = self.filters[0].take(pairs[:n], axis=0)
        for t in range(1, TAPS):
            out += self.filters[t].take(pairs[2 * t : 2 * t + n], axis=0)
        return out

    def combined(self, chunks: np.ndarray) -> np.ndarray:
        h = np.tanh(chunks)
        return np.concatenate([h.mean(0), h.max(0), h.min(0)])

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights + self.bias, -30, 30)))


def byte_pairs(data: np.ndarray) -> np.ndarray:
    """A text's places, ended by zeros so that every byte, and an empty text, has one."""
    padded = np.concatenate([data, np.zeros(WIDTH, dtype=np.uint8)]).astype(np.int32)
    return padded[:-1] * 256 + padded[1:]


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of n places start: the last one reaches the end."""
    return np.arange(0, max(1, n - (CHUNK - STRIDE)), STRIDE)


def chunk_peaks(net: Network, data: np.ndarray) -> np.ndarray:
    """The filters' largest responses in each chunk of a text, computed block by block."""
    pairs = byte_pairs(data)
    n = len(pairs) - 2 * (TAPS - 1)
    starts = chunk_starts(n)
    out = np.empty((len(starts), FILTERS), dtype=np.float32)
    per = _BLOCK // STRIDE
    for k in range(0, len(starts), per):
        own = starts[k : k + per]
        end = min(n, int(own[-1]) + CHUNK)
        r = net.responses(pairs[own[0] : end + 2 * (TAPS - 1)])
        edges = np.stack([own - own[0], np.minimum(own + CHUNK, n) - own[0]], 1).ravel()
        edges[-1] = len(r) - 1 if edges[-1] >= len(r) else edges[-1]
        peak = np.maximum.reduceat(r, edges, axis=0)[::2]
        peak[-1] = np.maximum(peak[-1], r[-1])
        out[k : k + per] = peak
    return out


def _learn_text(net: Network, data: np.ndarray):
    """Features and, for the gradient, the chunks' tanh values and the places of the peaks."""
    pairs = byte_pairs(data)
    n = len(pairs) - 2 * (TAPS - 1)
    r = net.responses(pairs)
    at = np.array([s + r[s : min(n, s + CHUNK)].argmax(0) for s in chunk_starts(n)])
    return pairs, at, np.tanh(r[at, np.arange(FILTERS)].astype(np.float64))


def learn(texts: list[bytes], labels: list[int], seed: int = 1) -> Network:
    """Fits a network; both labels weigh the same. Without texts of both labels it stays at probability 0.5."""
    net, rng = Network(), np.random.default_rng(seed)
    y = np.array(labels)
    if len(set(labels)) < 2:
        return net
    # A filter starts as a random function of what kind of byte stands where, finer differences are learned.
    kind = rng.standard_normal((2 * TAPS, 256, FILTERS)) * 0.3
    for t in range(TAPS):
        net.filters[t] = (kind[2 * t][:, None, :] + kind[2 * t + 1][None, :, :]).reshape(65536, FILTERS)
    net.weights = rng.standard_normal(3 * FILTERS) * 0.05
    # Learned byte weights: a pair's weight is the sum of its bytes' weights.
    moments = [[np.zeros_like(x), np.zeros_like(x)] for x in (kind, net.weights, np.zeros(1))]
    cost = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    data = [np.frombuffer(t, dtype=np.uint8) for t in texts]
    step = 0
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS) + RATE / 20
        order = rng.permutation(len(texts))
        for s in range(0, len(order), BATCH):
            g_kind, g_w, g_b = np.zeros_like(kind), np.zeros_like(net.weights), np.zeros(1)
            batch = order[s : s + BATCH]
            for i in batch:
                pairs, at, h = _learn_text(net, data[i])
                top, low = h.argmax(0), h.argmin(0)
                x = np.concatenate([h.mean(0), h.max(0), h.min(0)])
                d = cost[i] * (net.probability(x) - y[i])
                g_w += d * x
                g_b += d
                w = d * net.weights.reshape(3, FILTERS)
                g_h = np.repeat(w[:1] / len(h), len(h), 0)
                g_h[top, np.arange(FILTERS)] += w[1]
                g_h[low, np.arange(FILTERS)] += w[2]
                g_h *= 1 - h * h
                f = np.broadcast_to(np.arange(FILTERS), at.shape)
                for t in range(TAPS):
                    p = pairs[at + 2 * t]
                    np.add.at(g_kind[2 * t], (p >> 8, f), g_h)
                    np.add.at(g_kind[2 * t + 1], (p & 255, f), g_h)
            step += 1
            bias = np.array([net.bias])
            for value, grad, (m, v) in zip((kind, net.weights, bias), (g_kind, g_w, g_b), moments, strict=True):
                grad /= len(batch)
                m += 0.1 * (grad - m)
                v += 0.01 * (grad * grad - v)
                value -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            net.bias = float(bias[0])
            for t in range(TAPS):
                net.filters[t] = (kind[2 * t][:, None, :] + kind[2 * t + 1][None, :, :]).reshape(65536, FILTERS)
    return net


def learn_quality(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
    per_label: int = SAMPLE_PER_LABEL, chars: int = SAMPLE_CHARS,
) -> Network:
    """Learns from up to per_label documents of each label (0 and 1), the first by a hash of their ids, outside the held-out
    third, and of a text longer than chars from a stretch of so many characters. Rows without id, label or text teach
    nothing."""
    spark = docs.sparkSession
    known = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).dropna().where("y in (0, 1)").groupBy("id").agg(F.min("y").alias("y")).where(fold("id") != 1)
    picked = None
    for y in (0, 1):
        own = known.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(per_label)
        picked = own if picked is None else picked.union(own)
    ids = spark.createDataFrame(picked.collect(), "id long, y int")  # 2 * per_label rows at most
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(ids), "id")
    texts = texts.select("id", "y", sample_window(F.col("text"), F.col("id"), chars).alias("text")).groupBy("id").agg(F.max("y").alias("y"), F.max("text").alias("text"))
    rows = sorted(map(tuple, texts.dropna().collect()))
    return learn([t.encode() for _, _, t in rows], [y for _, y, _ in rows])


def score_quality(docs: DataFrame, net: Network, text_col: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from 0.5 up); null and empty texts are scored as no bytes.
    Older columns of these names give way."""
    model = docs.sparkSession.sparkContext.broadcast(net)
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    schema = schema_with(docs, score=T.DoubleType(), predicted=T.IntegerType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for batch in slices(batches, text_col):
            data, first = text_bytes(batch.column(text_col))
            features = np.array([net.combined(chunk_peaks(net, data[s:e])) for s, e in zip(first, first[1:], strict=False)])
            p = net.probability(features) if len(features) else np.zeros(0)
            yield put(batch, schema, score=pa.array(p), predicted=pa.array((p >= 0.5).astype(np.int32)))

    return docs.mapInArrow(run, schema)
