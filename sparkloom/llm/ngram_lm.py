"""Interpolated modified Kneser-Ney bigram model, counted in Spark, kept as sorted hash arrays.

Three counting passes, each a scan that pre-aggregates its partition and sends sorted arrays to
shards whose number grows with the corpus: words (by ranges of their 64-bit hash, so that a word's
id is its rank), bigrams (pairs of ids, by hash) and, from the merged bigrams, context and
continuation counts (by ranges of ids). More than RADIX shards are reached in two passes, by groups
of shards first, so that a task sends few arrays however large the corpus. A bigram's key holds the
low 32 bits of either id; their high bits choose a range of shards, so ids have no limit. Shards are
written to a model folder in the shared folder, with the tables of shard sizes; scoring tasks map
the files into memory and look up sorted queries. Nothing but shard sizes and counts of counts
reaches the driver."""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lean_batches, n_words, shared_dir
from .hashing import column_words, mix

ORDER = 2
#: The hash of the token that ends a text and, before the first word, stands for the last end.
END = np.uint64(0xFFFFFFFFFFFFFFF1)
SLICE = 512
#: Entries a task gathers before it merges them.
GATHER = 3_000_000
#: Text bytes for each shard of words and of bigrams in a small corpus; at least LEAST shards. Distinct
#: n-grams grow more slowly than a corpus, so shards grow as its size to the power GROWTH.
WORD_BYTES, PAIR_BYTES, LEAST, GROWTH = 64 << 20, 12 << 20, 64, 0.8
#: Shards, or groups of shards, that one pass deals to. A power of two, as the numbers of shards are.
RADIX = 2048
UINT = np.uint64
LOW = UINT(0xFFFFFFFF)
HALF = UINT(32)


class Store:
    """Array files of one folder. A file system that workers can open is used as it is and mapped;
    any other goes through pyarrow's file systems and is read whole."""

    def __init__(self, uri: str):
        self.uri = uri
        self.local = re.sub("^file:(//)?", "", uri) if uri.startswith("file:") else None

    def save(self, name: str, array: np.ndarray) -> None:
        """Written beside and renamed, so a repeated task leaves the same whole file."""
        temp = f".{name}.{uuid.uuid4().hex}"
        if self.local:
            os.makedirs(self.local, exist_ok=True)
            with open(f"{self.local}/{temp}", "wb") as f:
                np.save(f, array)
            os.replace(f"{self.local}/{temp}", f"{self.local}/{name}.npy")
        else:
            fs, path = pa.fs.FileSystem.from_uri(self.uri)
            fs.create_dir(path, recursive=True)
            with fs.open_output_stream(f"{path}/{temp}") as f:
                np.save(f, array)
            fs.move(f"{path}/{temp}", f"{path}/{name}.npy")

    def load(self, name: str) -> np.ndarray:
        if self.local:
            return np.load(f"{self.local}/{name}.npy", mmap_mode="r")
        fs, path = pa.fs.FileSystem.from_uri(self.uri)
        with fs.open_input_file(f"{path}/{name}.npy") as f:
            return np.load(f)


def merge(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and their summed counts (a row of counts for each key)."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(counts[order], first, axis=0)


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of equal values."""
    if not len(values):
        return []
    at = np.flatnonzero(np.concatenate(([True], values[1:] != values[:-1])))
    return list(zip(at.tolist(), [*at[1:].tolist(), len(values)]))


class Tally:
    """Counts gathered from many slices in bounded memory."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.size = self.least = 0

    def add(self, keys: np.ndarray) -> None:
        keys, counts = np.unique(keys, return_counts=True)
        self.parts.append((keys, counts.astype(np.uint32)))
        self.size += len(keys)
        if self.size > self.least + GATHER:
            self.parts = [self.all()]
            self.size = self.least = len(self.parts[0][0])

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.parts:
            return np.empty(0, UINT), np.empty(0, np.uint32)
        return merge(np.concatenate([k for k, _ in self.parts]), np.concatenate([c for _, c in self.parts]))


def group(shard: np.ndarray, shards: int) -> np.ndarray:
    """The group that stands for a shard in the first pass; the shard itself if one pass is enough."""
    return shard // max(1, shards // RADIX)


def _rows(shard: np.ndarray, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """A row (shard, keys, counts) for each run of `shard`, which ascends; keys as differences."""
    if not len(keys):
        return
    counts = np.ascontiguousarray(counts, np.uint32)
    bounds = runs(shard)
    for i in range(0, len(bounds), 64):
        part = bounds[i : i + 64]
        k = [np.diff(keys[s:e], prepend=keys.dtype.type(0)).tobytes() for s, e in part]
        yield pa.RecordBatch.from_arrays([pa.array([int(shard[s]) for s, _ in part], pa.int64()), pa.array(k, pa.binary()), pa.array([counts[s:e].tobytes() for s, e in part], pa.binary())], ["shard", "keys", "counts"])


_ROWS = "shard long, keys binary, counts binary"


def _arrays(keys: bytes, counts: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(np.frombuffer(keys, UINT), dtype=UINT), np.frombuffer(counts, np.uint32).reshape(-1, width)


def _gathered(rows, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All (keys, counts) of a shard merged, some GATHER entries beyond the distinct ones at a time."""
    parts, size = [], 0
    for k, c in rows:
        keys, counts = _arrays(k, c, width)
        parts.append((keys, counts.astype(np.int64)))
        size += len(keys)
        if size > GATHER:
            parts, size = [merge(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))], 0
    return merge(np.concatenate([x for x, _ in parts]), np.concatenate([x for _, x in parts]))


def _split(shards: int, shard_of):
    """The second pass: from rows of a group, rows of its shards. Gathers GATHER entries at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        size = 0

        def flush():
            for shard in sorted(held):
                keys, counts = (np.concatenate(x) for x in zip(*held[shard]))
                keys, counts = merge(keys, counts)
                yield from _rows(np.full(len(keys), shard), keys, counts)
            held.clear()

        for batch in batches:
            for label, k, c in zip(*(x.to_pylist() for x in batch.columns)):
                keys, counts = _arrays(k, c, 1)
                shard = shard_of(keys) + shards * (label // RADIX)
                order = np.argsort(shard, kind="stable")
                keys, counts, shard = keys[order], counts[order, 0], shard[order]
                for s, e in runs(shard):
                    held.setdefault(int(shard[s]), []).append((keys[s:e], counts[s:e]))
                size += len(keys)
                if size > GATHER:
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def dealt(rows: DataFrame, shards: int, shard_of) -> DataFrame:
    """Rows (shard, keys, counts) of all shards, from what tasks have sent by groups."""
    if shards <= RADIX:
        return rows
    return rows.repartition(RADIX, "shard").mapInArrow(_split(shards, shard_of), _ROWS)


def stream(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """END, the first text's words, END, the next text's, ..., END; and the place of each END."""
    n = np.diff(bounds)
    ends = np.concatenate(([0], np.cumsum(n + 1)))
    out = np.full(int(ends[-1]) + 1, END, UINT)
    inner = np.ones(len(out), bool)
    inner[ends] = False
    out[inner] = words[bounds[0] : bounds[-1]]
    return out, ends


def _slices(batches: Iterator[pa.RecordBatch], column: int):
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, *stream(*column_words(part.column(column)))


def _shift(shards: int) -> np.uint64:
    return UINT(64 - (shards.bit_length() - 1))


def word_shard(shards: int):
    return lambda keys: (keys >> _shift(shards)).astype(np.int64)


def _count_words(shards: int):
    def run(batches):
        tally = Tally()
        for _, tokens, _ in _slices(batches, 0):
            tally.add(tokens[1:])
        keys, counts = tally.all()
        yield from _rows(group(word_shard(shards)(keys), shards), keys, counts)

    return run


def _save_words(uri: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = _gathered(zip(pdf["keys"], pdf["counts"]), 1)
        shard, store = int(pdf["shard"].iloc[0]), Store(uri)
        store.save(f"word-{shard}", keys)
        store.save(f"count-{shard}", counts[:, 0])
        return pd.DataFrame({"shard": [shard], "n": [len(keys)], "total": [int(counts.sum())]})

    return run


class Model:
    """The files of a model folder, opened once in a worker process."""

    def __init__(self, uri: str, meta: dict):
        self.store, self.meta, self.open = Store(uri), meta, {}
        self.words, self.pairs = meta["word_shards"], meta["pair_shards"]
        self.offsets = self.file("offsets")
        self.halves = (meta["vocabulary"] >> 32) + 1

    def file(self, name: str) -> np.ndarray:
        if name not in self.open:
            self.open[name] = self.store.load(name)
        return self.open[name]

    def find(self, kind: str, shard: np.ndarray, keys: np.ndarray, have) -> tuple[np.ndarray, np.ndarray]:
        """Of keys ascending in each run of shard: place in its file, and whether it is there."""
        place, found = np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        for s, e in runs(shard):
            if have(int(shard[s])):
                there = self.file(f"{kind}-{shard[s]}")
                i = np.minimum(np.searchsorted(there, keys[s:e]), len(there) - 1)
                place[s:e], found[s:e] = i, there[i] == keys[s:e]
        return place, found

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of ascending word hashes; -1 for unknown ones."""
        shard = (hashes >> _shift(self.words)).astype(np.int64)
        place, found = self.find("word", shard, hashes, lambda s: self.offsets[s + 1] > self.offsets[s])
        return np.where(found, place + self.offsets[shard], -1)

    def times(self, keys: np.ndarray, part: np.ndarray) -> np.ndarray:
        """How often the pairs (see `packed`) were seen."""
        shard = pair_shard(self.pairs)(keys) + self.pairs * part
        order = np.lexsort((keys, shard))
        keys, shard = keys[order], shard[order]
        there, out = self.file("shards"), np.zeros(len(keys), np.int64)
        place, found = self.find("pair", shard, keys, lambda s: there[min(np.searchsorted(there, s), len(there) - 1)] == s)
        for s, e in runs(shard):
            if found[s:e].any():
                out[order[s:e]] = np.where(found[s:e], self.file(f"times-{shard[s]}")[place[s:e]], 0)
        return out

    def take(self, kind: str, ids: np.ndarray) -> np.ndarray:
        """Rows of the id-indexed files for ids that ascend but for unknown ones; -1 gives zeros."""
        out = np.zeros((len(ids), *(() if kind == "count" else (4,))), np.int64)
        known = np.flatnonzero(ids >= 0)
        shard = np.searchsorted(self.offsets, ids[known], side="right") - 1
        for s, e in runs(shard):
            at = known[s:e]
            out[at] = self.file(f"{kind}-{shard[s]}")[ids[at] - self.offsets[shard[s]]]
        return out


_models: dict[str, Model] = {}


def opened(uri: str, meta: str) -> Model:
    if (uri + meta) not in _models:
        _models.clear()
        _models[uri + meta] = Model(uri, json.loads(meta))
    return _models[uri + meta]


def pair_shard(shards: int):
    return lambda keys: (mix(keys) & UINT(shards - 1)).astype(np.int64)


def packed(first: np.ndarray, second: np.ndarray, halves: int) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs of ids: a key of their low halves, and the range of shards of their high halves."""
    return ((first & LOW) << HALF) | (second & LOW), ((first >> HALF) * UINT(halves) + (second >> HALF)).astype(np.int64)


def unpacked(keys: np.ndarray, part: int, halves: int) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of ids again."""
    return (keys >> HALF) | (UINT(part // halves) << HALF), (keys & LOW) | (UINT(part % halves) << HALF)


def _count_pairs(uri: str, meta: str):
    def run(batches):
        model, tallies = opened(uri, meta), {}
        for _, tokens, _ in _slices(batches, 0):
            words, at = np.unique(tokens, return_inverse=True)
            ids = model.ids(words).astype(UINT)[at]
            keys, part = packed(ids[:-1], ids[1:], model.halves)
            for p in np.unique(part).tolist():
                tallies.setdefault(p, Tally()).add(keys[part == p] if model.halves > 1 else keys)
        for p, tally in sorted(tallies.items()):
            keys, counts = tally.all()
            shard = pair_shard(model.pairs)(keys) + model.pairs * p
            order = np.argsort(shard, kind="stable") if model.pairs <= RADIX else np.lexsort((keys, group(shard, model.pairs)))
            yield from _rows(group(shard, model.pairs)[order], keys[order], counts[order])

    return run


def counts_of_counts(c: np.ndarray) -> list[int]:
    return np.bincount(np.minimum(c, 5), minlength=6)[1:5].tolist()


def _save_pairs(uri: str, meta: str):
    """Writes a shard of bigrams; sends on, by ranges of ids, what it adds to contexts (bigrams seen
    once, twice, more often) and to continuations (contexts of a word)."""

    def run(batches):
        model = opened(uri, meta)
        by: dict[int, list] = {}
        for batch in batches:
            for shard, k, c in zip(*(x.to_pylist() for x in batch.columns)):
                by.setdefault(shard, []).append((k, c))
        for shard in sorted(by):
            keys, counts = _gathered(by.pop(shard), 1)
            counts = counts[:, 0]
            model.store.save(f"pair-{shard}", keys)
            model.store.save(f"times-{shard}", np.minimum(counts, 0xFFFFFFFF).astype(np.uint32))
            first, second = unpacked(keys, shard // model.pairs, model.halves)
            add = np.zeros((2 * len(keys), 4), np.uint32)
            add[np.arange(len(keys)), np.minimum(counts, 3) - 1] = 1
            add[len(keys) :, 3] = 1
            ids, add = merge(np.concatenate((first, second)), add)
            to = np.searchsorted(model.offsets, ids.astype(np.int64), side="right") - 1
            yield from _rows(to, ids, add.astype(np.uint32))
            tally = np.array(counts_of_counts(counts), UINT)
            yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([np.array([shard], UINT).tobytes()], pa.binary()), pa.array([tally.tobytes()], pa.binary())], ["shard", "keys", "counts"])

    return run


def _save_contexts(uri: str, meta: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        model, shard = opened(uri, meta), int(pdf["shard"].iloc[0])
        ids, add = _gathered(zip(pdf["keys"], pdf["counts"]), 4)
        table = np.zeros((int(model.offsets[shard + 1] - model.offsets[shard]), 4), np.int64)
        table[ids.astype(np.int64) - model.offsets[shard]] = add
        model.store.save(f"context-{shard}", table)
        n = counts_of_counts(table[:, 3])
        return pd.DataFrame({"shard": [shard], "total": [int(table[:, 3].sum())], "n1": n[:1], "n2": n[1:2], "n3": n[2:3], "n4": n[3:4], "more": [int((table[:, 3] > 2).sum())]})

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """The three discounts of modified Kneser-Ney for counts of 1, 2 and more; where counts of
    counts are missing, half the count's first step."""
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 0.75, 3 - 4 * y * n4 / n3 if n3 else 0.9]
    return [min(max(d, 0.05), k - 0.05) for d, k in zip(raw, (1, 2, 3))]


def train(docs: DataFrame) -> tuple[str, str] | None:
    """Count a model over the texts of docs (column text): its folder and a JSON of its numbers.
    None without any text row. Null counts as empty: an end after an end."""
    lean_batches(docs.sparkSession)
    spark, rows = docs.sparkSession, docs.select("text")
    size, n = rows.agg(F.sum(F.octet_length("text")), F.count(F.lit(1))).first()
    if not n:
        return None
    power = lambda per: 1 << max(0, (max(LEAST, int(((size or 0) / per) ** GROWTH)) - 1).bit_length())
    words, pairs = power(WORD_BYTES), power(PAIR_BYTES)
    uri = f"{shared_dir(spark)}/ngram-{uuid.uuid4().hex}"
    sent = dealt(rows.mapInArrow(_count_words(words), _ROWS), words, word_shard(words))
    got = sent.groupBy("shard").applyInPandas(_save_words(uri), "shard long, n long, total long").collect()
    per = {r["shard"]: r["n"] for r in got}
    offsets = np.concatenate(([0], np.cumsum([per.get(s, 0) for s in range(words)])))
    meta = {"word_shards": words, "pair_shards": pairs, "tokens": sum(r["total"] for r in got), "vocabulary": int(offsets[-1])}
    Store(uri).save("offsets", offsets.astype(np.int64))
    text = json.dumps(meta)
    sent = dealt(rows.mapInArrow(_count_pairs(uri, text), _ROWS), pairs, pair_shard(pairs))
    sent = cut(sent.repartition(pairs, "shard").mapInArrow(_save_pairs(uri, text), _ROWS))
    tallies = sent.filter("shard < 0").select("keys", "counts").collect()  # a shard and four numbers
    done = sent.filter("shard >= 0").groupBy("shard").applyInPandas(_save_contexts(uri, text), "shard long, total long, n1 long, n2 long, n3 long, n4 long, more long").collect()
    Store(uri).save("shards", np.sort(np.array([np.frombuffer(r["keys"], UINT)[0] for r in tallies]).astype(np.int64)))
    pair_n = np.sum([np.frombuffer(r["counts"], UINT) for r in tallies], axis=0).tolist()
    cont_n = [sum(r[k] for r in done) for k in ("n1", "n2", "n3", "n4")]
    meta |= {"d2": discounts(*pair_n), "d1": discounts(*cont_n), "cont_total": sum(r["total"] for r in done), "cont_n": [*cont_n[:2], sum(r["more"] for r in done)]}
    return uri, json.dumps(meta)


def probabilities(model: Model, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a stream (see `stream`): each token's count, from the second on, and its probability
    after the token before it."""
    m = model.meta
    words, at = np.unique(tokens, return_inverse=True)
    ids = model.ids(words)
    counts, context = model.take("count", ids), model.take("context", ids)
    d1, d2 = np.array([0.0, *m["d1"]]), np.array([0.0, *m["d2"]])
    cont = context[:, 3]
    spread = float(np.dot(m["d1"], m["cont_n"])) / m["cont_total"] / (m["vocabulary"] + 1)
    lower = np.maximum(cont - d1[np.minimum(cont, 3)], 0) / m["cont_total"] + spread
    mass = context[:, :3] @ d2[1:]
    before, after = at[:-1], at[1:]
    c = np.zeros(len(before), np.int64)
    known = (ids[before] >= 0) & (ids[after] >= 0)
    keys, part = packed(ids[before[known]].astype(UINT), ids[after[known]].astype(UINT), model.halves)
    c[known] = model.times(keys, part)
    total = counts[before]
    seen = total > 0
    p = np.where(seen, (np.maximum(c - d2[np.minimum(c, 3)], 0) + mass[before] * lower[after]) / np.maximum(total, 1), lower[after])
    return counts[after], p


def _score(uri: str, meta: str):
    def run(batches):
        model = opened(uri, meta)
        n, v = model.meta["tokens"], model.meta["vocabulary"]
        for part, tokens, ends in _slices(batches, 2):
            c, p = probabilities(model, tokens)
            at = ends[:-1]  # token i of the stream is number i - 1 of c
            base = np.log10((c + 1) / (n + v + 1))
            size = np.diff(ends)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(size, pa.int64()), pa.array(np.add.reduceat((c > 0).astype(np.int64), at), pa.int64()), pa.array(np.full(len(size), n), pa.int64()), pa.array(np.add.reduceat(base, at), pa.float64()), pa.array(np.add.reduceat(np.log10(p), at), pa.float64())], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def held_out() -> Column:
    """crc32 of the id as text, modulo 7, is 2; a null id is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """Score all texts by a model of those not held out: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probability of the text), a row per document.

    Perplexity is 10 ** (-score / n_tokens). Null text counts as empty: one token, the end.
    Repeated rows count and are scored as often as they come. Without training rows every score is
    null and every count 0. Other columns are ignored; an empty table gives an empty one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    out = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    model = train(rows.filter(~F.col("held_out")))
    if model is None:
        none = F.lit(None).cast("double")
        return rows.select("doc_id", "held_out", (n_words(F.col("text")) + 1).alias("n_tokens"), F.lit(0).cast("long").alias("n_known"), F.lit(0).cast("long").alias("train_tokens"), none.alias("base_score"), none.alias("score"))
    return rows.mapInArrow(_score(*model), out)
