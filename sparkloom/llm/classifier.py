"""A byte-level convolutional quality classifier in numpy.

FILTERS learned filters of WIDTH bytes slide over the whole document, byte by byte; their responses
are max-pooled within chunks of CHUNK positions, each of which shares half of them with the next,
and the chunks' mean and maximum are combined into one probability. As inputs are single bytes, a
filter is a table of one weight for each (place, byte), so a response is WIDTH table look-ups and
both training and scoring run without matrix products."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean_batches

FILTERS, WIDTH, CHUNK = 16, 8, 256
HALF = CHUNK // 2
#: The bounded training sample: so many documents of either label, each of at most so many bytes.
PER_LABEL, MOST_BYTES = 500, 8192
EPOCHS, BATCH, RATE, DECAY = 14, 32, 0.08, 1e-4
#: Bytes scored at once.
BLOCK = 1 << 20


class Net:
    """weights (WIDTH, 256, FILTERS), bias, and the output weights of chunk mean and maximum."""

    def __init__(self, seed: int = 11):
        rng = np.random.Generator(np.random.PCG64(seed))
        self.w = rng.normal(0, 0.15, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.b = np.zeros(FILTERS, np.float32)
        self.u = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.v = rng.normal(0, 0.3, FILTERS).astype(np.float32)
        self.c = np.zeros(1, np.float32)

    def params(self) -> list[np.ndarray]:
        return [self.w, self.b, self.u, self.v, self.c]

    def respond(self, texts: list[bytes]):
        """Responses at all positions of the joined texts, where each half chunk starts and ends, the
        bounds of the texts' half chunks and the bytes. A text's last position is just behind it."""
        pad = b"\0" * WIDTH
        data = np.frombuffer(b"".join(t + pad for t in texts) + pad, np.uint8)
        n = len(data) - WIDTH + 1  # one more than there are positions
        r = np.take(self.w[0], data[:n], axis=0)
        for k in range(1, WIDTH):
            r += np.take(self.w[k], data[k : n + k], axis=0)
        sizes = np.array([len(t) + 1 for t in texts])
        starts = np.cumsum(sizes + WIDTH - 1) - (sizes + WIDTH - 1)
        halves = -(-sizes // HALF)
        bounds = np.concatenate(([0], np.cumsum(halves)))
        lo = np.repeat(starts, halves) + HALF * (np.arange(bounds[-1]) - np.repeat(bounds[:-1], halves))
        hi = np.minimum(lo + HALF, np.repeat(starts + sizes, halves))
        return r, lo, hi, bounds, data

    def pooled(self, r, lo, hi, bounds):
        """Of chunks, a half and the next of the same text: largest response, that rectified, and
        its mean and maximum in each text."""
        edges = np.column_stack((lo, hi)).ravel()  # what lies between a text's end and the next is not looked at
        top = np.maximum.reduceat(r, edges)[::2]
        top = joined(top, bounds) + self.b
        z = np.maximum(top, 0)
        n = np.diff(bounds)[:, None]
        return top, z, np.add.reduceat(z, bounds[:-1]) / n, np.maximum.reduceat(z, bounds[:-1])

    def score(self, texts: list[bytes]) -> np.ndarray:
        r, lo, hi, bounds, _ = self.respond(texts)
        _, _, mean, most = self.pooled(r, lo, hi, bounds)
        return 1 / (1 + np.exp(-np.clip(mean @ self.u + most @ self.v + self.c[0], -30, 30).astype(np.float64)))

    def gradients(self, texts: list[bytes], y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss. Only the window that gave a chunk's maximum passes gradient on."""
        r, lo, hi, bounds, data = self.respond(texts)
        top, z, mean, most = self.pooled(r, lo, hi, bounds)
        p = 1 / (1 + np.exp(-np.clip(mean @ self.u + most @ self.v + self.c[0], -30, 30)))
        d = ((p - y) / len(texts)).astype(np.float32)
        counts = np.diff(bounds)
        of = np.repeat(np.arange(len(texts)), counts)
        is_most = z == most[of]
        dz = d[of, None] * (self.u / counts[of, None] + self.v * is_most / np.maximum(np.add.reduceat(is_most.astype(np.float32), bounds[:-1])[of], 1))
        dz *= top > 0
        gw = np.zeros_like(self.w)
        best = np.stack([s + r[s:e].argmax(0) for s, e in zip(lo.tolist(), hi.tolist())])
        most_r = np.take_along_axis(r, best, 0)
        other = np.flatnonzero(np.isin(np.arange(1, len(best)), bounds, invert=True))
        best[other] = np.where(most_r[other + 1] > most_r[other], best[other + 1], best[other])
        f = np.broadcast_to(np.arange(FILTERS), best.shape)
        for k in range(WIDTH):
            np.add.at(gw[k], (data[best + k], f), dz)
        return [gw, dz.sum(0), d @ mean, d @ most, d.sum(keepdims=True)]


def joined(halves: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Half chunks' maxima to those of chunks: each half with the next one of its text."""
    out = halves.copy()
    np.maximum(halves[:-1], halves[1:], out=out[:-1])
    last = bounds[1:] - 1
    out[last] = halves[last]
    return out


def train(texts: list[bytes], labels: list[int], seed: int = 11) -> Net:
    """Adam over EPOCHS epochs in a seeded order. Without both labels, the untrained net with even odds."""
    net, y = Net(seed), np.array(labels, np.float32)
    if len(set(labels)) < 2:
        net.u[:], net.v[:] = 0, 0
        return net
    rng = np.random.Generator(np.random.PCG64(seed + 1))
    m, s, step = [np.zeros_like(p) for p in net.params()], [np.zeros_like(p) for p in net.params()], 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        rate = RATE * 0.25 * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            pick, step = order[at : at + BATCH], step + 1
            for p, g, a, b in zip(net.params(), net.gradients([texts[i] for i in pick], y[pick]), m, s):
                g = g + DECAY * p
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return net


def remainder(c="doc_id"):
    """crc32 of the id as text, modulo 3; null: 0."""
    return F.coalesce(F.crc32(F.col(c).cast("string")) % 3, F.lit(0))


def sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> tuple[list[bytes], list[int]]:
    """At most per_label documents of either label, by the smallest hashes of their ids among those
    that may be learned from. Every text is whole; longer ones than MOST_BYTES are not drawn. Of several
    texts with one id, that of the smallest hash is drawn."""
    size = docs.select("doc_id", F.octet_length("text").alias("__b")).filter(F.col("__b").between(1, MOST_BYTES))
    known = labels.filter((remainder() != 1) & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("__q")).filter("quality = __q").drop("__q")
    fit = known.join(size.select("doc_id").distinct(), "doc_id")
    key = F.xxhash64("doc_id")
    ids = [r for q in (0, 1) for r in fit.filter(F.col("quality") == q).orderBy(key, "doc_id").limit(per_label).select("doc_id", "quality").collect()]
    if not ids:
        return [], []
    chosen = docs.sparkSession.createDataFrame(ids, fit.select("doc_id", "quality").schema)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter(F.octet_length("text").between(1, MOST_BYTES)).groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.min("quality").alias("quality")).orderBy("doc_id").collect()
    return [r["text"].encode() for r in rows], [int(r["quality"]) for r in rows]


def _score(net: Net):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
            scores, at = [], 0
            while at < len(texts):
                stop, size = at + 1, len(texts[at])
                while stop < len(texts) and size + len(texts[stop]) <= BLOCK:
                    size += len(texts[stop])
                    stop += 1
                scores.append(score_long(net, texts[at]) if size > 4 * BLOCK else net.score(texts[at:stop]))
                at = stop
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], ["doc_id", "score"])

    return run


def score_long(net: Net, text: bytes) -> np.ndarray:
    """A very long text piece by piece, each of whole half chunks and one more, with the same pooling."""
    step, total, n, most = HALF * 4096, 0.0, 0, np.zeros(FILTERS, np.float32)
    for at in range(0, len(text) + 1, step):
        last = at + step > len(text)
        r, lo, hi, bounds, _ = net.respond([text[at : at + step + HALF + WIDTH]])
        if not last:  # the piece's chunks, and the half that its last one shares with the next piece
            lo, hi = lo[: 4096 + 1], hi[: 4096 + 1]
            bounds = np.array([0, len(lo)])
        _, z, _, _ = net.pooled(r, lo, hi, bounds)
        z = z if last else z[:4096]
        total, n, most = total + z.sum(0, dtype=np.float64), n + len(z), np.maximum(most, z.max(0))
    logit = (total / n) @ net.u.astype(np.float64) + most @ net.v + net.c[0]
    return np.array([1 / (1 + np.exp(-np.clip(float(logit), -30, 30)))])


def score(docs: DataFrame, net: Net) -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 likelier), a row per document, whole texts. Null
    counts as empty and is scored as padding alone; repeated rows are scored alike; other columns
    are ignored; an empty table gives an empty one. The net travels in the task (about 130 kB)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_score(net), f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Train on the bounded sample and score all: doc_id, held_out, score, predicted."""
    lean_batches(docs.sparkSession)
    net = train(*sample(docs, labels))
    return score(docs, net).select("doc_id", (remainder() == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
