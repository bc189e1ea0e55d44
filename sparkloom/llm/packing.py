"""Best-fit decreasing packing of token pieces, planned on the histogram of lengths."""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, gapless_rank, lean_batches, small

CAPACITY = 4096
END_ID = 1
SLICE = 512
MEMO = 700_000
_loaded: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordIds:
    """Ids of a text through a memo of its white-space separated words, as little-endian uint32
    bytes. The tokenizer's pattern never crosses white space, so a text's ids are its words' ids
    in a row. Fresh words are encoded many in one call, apart by a mark that has one id. The memo
    is bounded: two generations of MEMO words, the older dropped when the younger is full."""

    MARK = b"\x01"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.ends = {x.encode(): self.ids(x).tobytes() for x in ".,"}
        mark = self.ids(self.MARK.decode())
        self.mark = mark[0] if len(mark) == 1 else None

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def learn(self, words: list[bytes]) -> None:
        """Memorise ids. A word of ASCII letters with one full stop or comma behind is the word's ids
        and the stop's, as the pattern parts letters from marks."""
        ended = [w for w in words if w[-1:] in self.ends and w[:-1].isalpha()]
        if ended:
            stems = {w[:-1] for w in ended} - self.memo.keys()
            words = list(stems.union(words).difference(ended))
        plain = [w for w in words if self.mark is not None and self.MARK not in w]
        for i in range(0, len(plain), 2048):
            part = plain[i : i + 2048]
            ids = self.ids((b" " + self.MARK + b" ").join(part).decode())
            at, raw = np.flatnonzero(ids == self.mark), ids.tobytes()
            self.memo.update(zip(part, (raw[4 * s : 4 * e] for s, e in zip([0, *(at + 1).tolist()], [*at.tolist(), len(ids)])), strict=True))
        for w in words:
            if w not in self.memo:
                self.memo[w] = self.ids(w.decode()).tobytes()
        for w in ended:
            self.memo[w] = self.memo[w[:-1]] + self.ends[w[-1:]]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        # the normaliser lower-cases; only special tokens are read before it
        words = [(t if b"<|" in t else t.lower()).split() for t in texts]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        memo, older, fresh = self.memo, self.older, []
        for w in set(chain.from_iterable(words)):
            if w not in memo:
                if w in older:
                    memo[w] = older[w]
                else:
                    fresh.append(w)
        self.learn(fresh)
        return [b"".join(map(memo.__getitem__, ws)) for ws in words]


def word_ids_of(path: str) -> WordIds:
    """One memo for a worker process, whatever tasks it runs."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def _texts(column: pa.Array) -> list[bytes]:
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def _pieces(path: str, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word_ids = word_ids_of(path)
        end = END_ID.to_bytes(4, "little")
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, pieces, starts, lengths, crcs, ids = [], [], [], [], [], []
                for i, b in enumerate(word_ids(_texts(part.column(1)))):
                    b += end
                    for piece, start in enumerate(range(0, len(b), 4 * capacity)):
                        cut_ = b[start : start + 4 * capacity]
                        rows.append(i)
                        pieces.append(piece)
                        starts.append(start // 4)
                        lengths.append(len(cut_) // 4)
                        crcs.append(zlib.crc32(cut_))
                        if keep_ids:
                            ids.append(cut_)
                arrays = [part.column(0).take(pa.array(rows, pa.int64())), pa.array(pieces, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(crcs, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(arrays + [pa.array(ids, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Tokenized pieces: doc_id, piece, start, length, ids_crc32 and, if asked for, ids as
    little-endian uint32 bytes."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer or default_tokenizer(), capacity, keep_ids), schema)


class Tightest:
    """Segment tree over remaining capacities 0..size: which capacities have open bins. `find(c)`
    gives the smallest capacity >= c with one, in logarithmic time, or None."""

    def __init__(self, size: int):
        self.base = 1 << size.bit_length()
        self.tree = [False] * (2 * self.base)

    def set(self, c: int, on: bool) -> None:
        i = c + self.base
        self.tree[i] = on
        while i > 1:
            i //= 2
            self.tree[i] = self.tree[2 * i] or self.tree[2 * i + 1]

    def find(self, c: int) -> int | None:
        i = c + self.base
        if not self.tree[i]:
            while i > 1 and (i % 2 or not self.tree[i + 1]):
                i //= 2
            if i == 1:
                return None
            i += 1
            while i < self.base:
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        return i - self.base


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Best-fit decreasing over lengths with their counts, equal lengths placed together.

    The tightest open bin of remaining capacity c >= L takes q = c // L pieces before the next
    tightest is due, so a run of f alike bins takes f * q pieces in one step. Steps are (length,
    first rank, pieces, f, first bin, offset): the piece of rank r goes to bin first + (r - rank)
    % f at offset + length * ((r - rank) // f). Returns the steps and the number of bins."""
    open_: dict[int, list[tuple[int, int]]] = {}
    tree, steps, bins = Tightest(capacity), [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            c = tree.find(length)
            if c is None:
                c, q = capacity, capacity // length
                first, have = bins, max(1, left // q)
                bins += have
            else:
                q = c // length
                first, have = open_[c].pop()
                if not open_[c]:
                    tree.set(c, False)
            full = min(have, left // q)
            take, f = (full * q, full) if full else (left, 1)
            steps.append((length, rank, take, f, first, capacity - c))
            rank, left = rank + take, left - take
            back = [(c - take // f * length, first, f)] + [(c, first + f, have - f)] * (have > f)
            for c, first, n in back:
                if c:
                    open_.setdefault(c, []).append((first, n))
                    tree.set(c, True)
    return steps, bins


def place(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to materialised pieces (doc_id, piece, length, ...)."""
    spark: SparkSession = rows.sparkSession
    histogram = {r["length"]: r["n"] for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    steps, _ = plan(histogram, capacity)
    table = spark.createDataFrame(steps, "length long, __rank long, __take long, __f long, __first long, __offset long")
    ranked = gapless_rank(rows, "length", ["doc_id", "piece", "ids_crc32"], "__r")
    t = small(table.withColumnRenamed("length", "__len"))
    at = F.col("__r") - F.col("__rank")
    placed = ranked.join(t, (F.col("length") == F.col("__len")) & (at >= 0) & (at < F.col("__take")))
    return placed.select(*rows.columns, (F.col("__first") + F.pmod(at, F.col("__f"))).alias("sequence_id"), (F.col("__offset") + F.col("length") * F.floor(at / F.col("__f"))).cast("long").alias("offset"))


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens by best-fit decreasing.

    A document is its ids and then END_ID; only longer ones are cut, into full pieces and a rest.
    The histogram of lengths (at most `capacity` numbers) is all that reaches the driver; the plan
    made from it equals best-fit decreasing over all pieces, and pieces find their places by their
    rank among equal lengths. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset
    (and ids), a row per piece. Null text counts as empty and is END_ID alone; repeated rows are
    packed as often as they come; other columns are ignored; an empty table gives an empty one."""
    lean_batches(docs.sparkSession)
    return place(cut(pieces(docs, tokenizer, capacity, keep_ids)), capacity)
