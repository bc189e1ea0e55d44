"""Phrase collocations by contiguous pattern growth, as PrefixSpan grows its prefixes.

Frequent words are counted first, then frequent pairs; what is left of the texts are occurrences of
frequent pairs, each with the words that may follow it: the projection of that prefix. Prefixes are
dealt to tasks, and a task extends each of its own to the right, depth first, over pointers into its
sorted projection. A prefix whose projection is too large for one task is counted by Spark instead
and its projection split by the next word, until the parts are small."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, lean_batches, small
from .hashing import _VALUE, mix, spans, values_of

LONGEST, LEAST, TOP = 3, 10, 2000
#: A candidate goes if a longer phrase around it is found in so many of 100 of its places.
INSIDE = 50
UNKNOWN = "und"
#: Scores are floor(SCALE * a * a / (l * r)).
SCALE = 1_000_000
#: Rows that one task grows, about, and rows of one prefix that it takes at most.
TASK_ROWS, PREFIX_ROWS = 1 << 18, 1 << 16
#: Bits of a filter: 16 for each of what it holds, at most 2 ** 27 (16 MiB).
LEAST_BITS, MOST_BITS = 16, 27
#: Pairs or windows that a task gathers before it counts and hands them on.
GATHER = 1 << 21
#: Parts in which a language's candidates are ranked first.
PARTS = 16
_GAP, _BREAK = np.zeros(256, dtype=bool), np.zeros(256, dtype=bool)
_BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
_GAP[:] = _BREAK
_GAP[[32, 9]] = True
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)


def _known(h: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Whether a filter may hold each hash: never false for what it holds."""
    at = h >> np.uint64(64 - (len(bits).bit_length() + 5))
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def bit_filter(hashes: DataFrame) -> np.ndarray:
    """A filter of the longs in the one column of a materialised table, of bounded size whatever the
    table's: the bits are set in Spark, and only their words reach the driver."""
    n = hashes.count()
    log = min(MOST_BITS, max(LEAST_BITS, (16 * n).bit_length()))
    h = F.col(hashes.columns[0])
    at = F.shiftrightunsigned(h, 64 - log)
    words = hashes.select(at.alias("b")).select(F.shiftright("b", 6).cast("int").alias("i"), F.expr("shiftleft(1L, cast(b & 63 AS int))").alias("w"))
    out = np.zeros(1 << (log - 6), dtype=np.uint64)
    got = words.groupBy("i").agg(F.bit_or("w").alias("w")).toArrow()
    out[got.column("i").to_numpy()] = got.column("w").to_numpy().view(np.uint64)
    return out


class _Tokens:
    """The words of a batch of (lang, text): hash, language and piece of each, and their spans.
    Languages are numbered through the task."""

    def __init__(self, names: dict[str, int], batch: pa.RecordBatch, values: np.ndarray):
        texts = [x or b"" for x in batch.column(1).cast(pa.large_binary()).to_pylist()]
        langs = [names.setdefault(UNKNOWN if x is None else x, len(names)) for x in batch.column(0).to_pylist()]
        self.data = b"\n".join(texts) + b"\n"
        raw = np.frombuffer(self.data, dtype=np.uint8)
        self.start, self.end, self.hash = spans(raw, _GAP, values)
        self.hash[self.hash == 0] = 1  # 0 stands for no word
        self.piece = np.searchsorted(np.flatnonzero(_BREAK[raw]), self.start)
        text = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), self.start, "right")
        self.lang = np.array(langs, dtype=np.int64)[text]

    def joined(self, words: np.ndarray) -> np.ndarray:
        """Whether each word and the next stand in one piece and may both be frequent."""
        ok = _known(self.hash, words)
        return (self.piece[1:] == self.piece[:-1]) & ok[1:] & ok[:-1]


def _runs(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal rows together, and where in it each distinct row begins."""
    order = np.lexsort(columns)
    new = np.zeros(len(order), dtype=bool)
    new[:1] = True
    for c in columns:
        c = c[order]
        new[1:] |= c[1:] != c[:-1]
    return order, np.flatnonzero(new)


def _salt(names: dict[str, int]) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8).digest(), "little") for x in names], dtype=np.uint64)


def _pair(t: _Tokens, names: dict[str, int], at: np.ndarray) -> np.ndarray:
    """Hashes of the pairs that begin at the places `at`, different for each language."""
    return mix(mix(t.hash[at] * _A + t.hash[at + 1]) + _salt(names)[t.lang[at]] * _B)


def _words(values: np.ndarray):
    """Of each batch the words, counted: lang, word, n. Here 128 bits tell them apart."""
    other = values_of(1 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: dict[str, int] = {}
        for batch in batches:
            t = _Tokens(names, batch, values)
            again = spans(np.frombuffer(t.data, dtype=np.uint8), _GAP, other)[2]
            order, first = _runs([again, t.hash, t.lang])
            n = np.diff(np.append(first, len(order)))
            one = order[first]
            low = t.data.lower()  # of bytes: A-Z only
            words = [low[s:e] for s, e in zip(t.start[one].tolist(), t.end[one].tolist())]
            langs = pa.array(list(names), pa.string()).take(pa.array(t.lang[one]))
            yield pa.RecordBatch.from_arrays([langs, pa.array(words, pa.binary()).cast(pa.string()), pa.array(n)], ["lang", "word", "n"])

    return run


def _hash_words(values: np.ndarray):
    """lang, word, n to lang, word, h, n: the hash that the word has in texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = _Tokens({}, pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["lang", "word"]), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(t.hash.view(np.int64)), batch.column(2)], ["lang", "word", "h", "n"])

    return run


def _pairs(values: np.ndarray, words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = {}, [], 0

        def counted():
            k, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n)], ["k", "n"])

        for batch in batches:
            t = _Tokens(names, batch, values)
            held.append(_pair(t, names, np.flatnonzero(t.joined(words.value))))
            size += len(held[-1])
            if size >= GATHER:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return run


def _windows(values: np.ndarray, words, pairs, hot, longest: int):
    """The places where a frequent pair begins, each with the words that may follow it (0: none does),
    counted: lang, w1.., n, and whether the pair may have too many places for one task."""
    cols = [f"w{i + 1}" for i in range(longest)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, held, size = {}, [], 0

        def counted():
            columns = [np.concatenate(c) for c in zip(*held)]
            order, first = _runs(columns[::-1])
            lang, large, *rest = (c[order[first]] for c in columns)
            n = np.diff(np.append(first, len(order)))
            langs = pa.array(list(names), pa.string()).take(pa.array(lang))
            return pa.RecordBatch.from_arrays([langs, *[pa.array(c.view(np.int64)) for c in rest], pa.array(n), pa.array(large)], ["lang", *cols, "n", "hot"])

        for batch in batches:
            t = _Tokens(names, batch, values)
            at = np.flatnonzero(t.joined(words.value))
            pair = _pair(t, names, at)
            some = _known(pair, pairs.value)
            at, pair = at[some], pair[some]
            go = np.zeros(len(t.hash) + 1, dtype=bool)  # a frequent pair begins here
            go[at] = True
            out, open_ = [t.lang[at], _known(pair, hot.value), t.hash[at], t.hash[at + 1]], np.ones(len(at), dtype=bool)
            for k in range(2, longest):
                open_ = open_ & go[np.minimum(at + k - 1, len(t.hash))]
                next_ = t.hash[np.minimum(at + k, len(t.hash) - 1)] if len(at) else t.hash[at]
                out.append(np.where(open_, next_, np.uint64(0)))
            held.append(out)
            size += len(at)
            if size >= GATHER // 4:
                yield counted()
                held, size = [], 0
        if size:
            yield counted()

    return run


def extend(lang: np.ndarray, words: list[np.ndarray], n: np.ndarray, depth: int, least: int) -> list[tuple[int, int, int]]:
    """Grow prefixes depth first over sorted rows of (lang, words...): the frequent ones, as (row that
    begins with it, length, count). `depth` words of every row are its prefix; a word 0 ends a row."""
    total = np.concatenate(([0], np.cumsum(n)))
    edge = np.zeros(len(lang) + 1, dtype=bool)
    edge[[0, -1]] = True
    for c in [lang, *words[:depth]]:
        edge[1:-1] |= c[1:] != c[:-1]
    at = np.flatnonzero(edge)
    found = []
    stack = [(lo, hi, depth) for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()) if total[hi] - total[lo] >= least]
    while stack:
        lo, hi, k = stack.pop()
        found.append((lo, k, int(total[hi] - total[lo])))
        if k == len(words):
            continue
        w = words[k][lo:hi]
        cuts = np.concatenate(([0], np.flatnonzero(w[1:] != w[:-1]) + 1, [hi - lo])) + lo
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
            if words[k][a] and total[b] - total[a] >= least:
                stack.append((a, b, k + 1))
    return found


def _grow(depth: int, longest: int, least: int):
    """Grow the prefixes of one bucket. Rows marked hot are parts of a prefix that other buckets have
    too; they are counted, and come out open."""
    cols = [f"w{i + 1}" for i in range(longest)]

    def run(table: pa.Table) -> pa.Table:
        langs = table.column("lang").combine_chunks().dictionary_encode()
        lang, words, n = langs.indices.to_numpy(), [table.column(c).to_numpy() for c in cols], table.column("n").to_numpy()
        hot = table.column("hot").to_numpy()
        order, first = _runs([*words[::-1], lang, hot])
        split = np.searchsorted(first, len(hot) - hot.sum())  # hot ones come last
        same = np.add.reduceat(n[order], first) if len(first) else n[:0]
        lang, words = lang[order[first]], [w[order[first]] for w in words]
        found = extend(lang[:split], [w[:split] for w in words], same[:split], depth, least)
        row, size, f = (np.array(x, dtype=np.int64) for x in zip(*found)) if found else (np.empty(0, np.int64),) * 3
        out = [np.concatenate([np.where(size > i, words[i][row], 0), words[i][split:]]) for i in range(longest)]
        names = langs.dictionary.take(pa.array(np.concatenate([lang[row], lang[split:]])))
        return pa.table([names, *[pa.array(c, pa.int64()) for c in out], pa.array(np.concatenate([f, same[split:]]), pa.int64()), pa.array(np.arange(len(names)) >= len(f))], ["lang", *cols, "f", "open"])

    return run


def grow(windows: DataFrame, tasks: int, longest: int, least: int) -> DataFrame:
    """lang, w1.. (0 where a phrase has ended) and f of all phrases of at least two words found at
    least `least` times, from windows (lang, w1.., n, hot). Windows are shuffled once, those of a
    prefix to one task; a hot prefix's are dealt over all, counted there, and go on in rounds: what
    Spark counts to be too many rows for one task is split by the next word."""
    cols = [f"w{i + 1}" for i in range(longest)]
    shape = f"lang string, {', '.join(f'{c} long' for c in cols)}, f long, open boolean"

    def deal(rows: DataFrame, depth: int, tasks: int) -> DataFrame:
        bucket = F.pmod(F.when(F.col("hot"), F.xxhash64("lang", *cols)).otherwise(F.xxhash64("lang", *cols[:depth])), F.lit(tasks))
        return cut(rows.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(_grow(depth, longest, least), shape))

    first = deal(windows, 2, tasks)
    grown, depth = first.filter("not open").drop("open"), 2
    rows = first.filter("open").withColumnRenamed("f", "n").drop("open")
    while not rows.isEmpty():
        prefix = ["lang", *cols[:depth]]
        large = cut(rows.groupBy(*prefix).agg(F.sum("n").alias("f"), F.count(F.lit(1)).alias("c")).filter(F.col("c") > PREFIX_ROWS).drop("c"))
        cold = rows.join(small(large.drop("f")), prefix, "left_anti").withColumn("hot", F.lit(False))
        grown = grown.unionByName(deal(cold, depth, max(1, -(-rows.count() // TASK_ROWS))).drop("open"))
        grown = grown.unionByName(large.filter(F.col("f") >= least).select("lang", *[c if c in prefix else F.lit(0).cast("long").alias(c) for c in cols], "f"))
        if depth == longest:  # every row is a phrase of its own
            break
        rows = cut(rows.join(small(large.drop("f")), prefix, "left_semi").filter(F.col(cols[depth]) != 0))
        depth += 1
    return grown


def count_words(texts: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The table of words (lang, word, h, n) and the byte values of their hash, by which no two words
    of a language are alike: should two be, other values are taken."""
    counted = texts.mapInArrow(_words(_VALUE), "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    seed, values = 0, _VALUE
    while True:
        words = cut(counted.mapInArrow(_hash_words(values), "lang string, word string, h long, n long"))
        if words.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").isEmpty():
            return words, values
        counted = words.select("lang", "word", "n")
        seed += 1
        values = values_of(seed)


def frequent(docs: DataFrame, longest: int = LONGEST, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The words (lang, word, h, n), all of them, and the frequent phrases (lang, g, f): g their words' hashes."""
    spark = docs.sparkSession
    lean_batches(spark)
    texts = docs.select(F.col("lang").cast("string").alias("lang"), "text")
    words, values = count_words(texts)
    send = spark.sparkContext.broadcast
    known = send(bit_filter(cut(words.filter(F.col("n") >= least).select("h").distinct())))
    pairs = cut(texts.mapInArrow(_pairs(values, known), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).filter(F.col("n") >= least))
    both, hot = send(bit_filter(pairs.select("k"))), send(bit_filter(pairs.filter(F.col("n") > PREFIX_ROWS).select("k")))
    places = pairs.agg(F.sum("n")).first()[0] or 0
    cols = [f"w{i + 1}" for i in range(longest)]
    windows = texts.mapInArrow(_windows(values, known, both, hot, longest), f"lang string, {', '.join(f'{c} long' for c in cols)}, n long, hot boolean")
    grams = grow(windows, max(1, -(-places // TASK_ROWS)), longest, least)
    return words, cut(grams.select("lang", F.filter(F.array(*cols), lambda x: x != 0).alias("g"), "f"))


def best_cut(grams: DataFrame, counts: DataFrame) -> DataFrame:
    """lang, g, a, l, r and score of each phrase at its lowest-scoring cut, ties to the earliest.
    counts (lang, g, f) has every frequent word and phrase, so both parts of a frequent one."""
    k, size = F.col("k"), F.size("g")
    cuts = grams.select("lang", "g", F.col("f").alias("a"), F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("*", F.slice("g", F.lit(1), k).alias("first"), F.slice("g", k + 1, size - k).alias("rest"))
    left, right = counts.select("lang", F.col("g").alias("first"), F.col("f").alias("l")), counts.select("lang", F.col("g").alias("rest"), F.col("f").alias("r"))
    exact = "decimal(38, 0)"
    score = F.expr(f"CAST(CAST({SCALE} AS {exact}) * CAST(a AS decimal(16, 0)) * CAST(a AS decimal(16, 0)) DIV (CAST(l AS decimal(18, 0)) * CAST(r AS decimal(18, 0))) AS bigint)")
    scored = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"]).withColumn("score", score)
    return scored.groupBy("lang", "g", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("b")).select("lang", "g", "a", "b.l", "b.r", "b.score")


def swallowed(grams: DataFrame, inside: int = INSIDE) -> DataFrame:
    """lang, g and most: the highest count of a longer frequent phrase around g."""
    at = F.explode(F.expr("flatten(transform(sequence(2, size(g) - 1), m -> transform(sequence(1, size(g) - m + 1), i -> slice(g, i, m))))"))
    return grams.filter(F.size("g") > 2).select("lang", at.alias("g"), "f").groupBy("lang", "g").agg(F.max("f").alias("most"))


def fits_rows(df: DataFrame, width: int) -> bool:
    """Whether a table with an array of at most `width` longs is small enough to broadcast."""
    return df.count() * (96 + 8 * width) <= BROADCAST_BYTES


def mine(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, inside: int = INSIDE, top: int = TOP) -> DataFrame:
    """The collocations of each language, best first.

    A-Z of the texts are lower-cased; they are split at .,;:!? and line breaks (\\x0A-\\x0D) into
    pieces, these at spaces and tabs into words. A phrase of 2 to `longest` words found a >= `least`
    times within pieces, overlaps included, is scored by its weakest cut into two parts with counts
    l and r: floor(1000000 * a * a / (l * r)). It goes if a longer phrase around it has at least
    `inside` hundredths of its count. Counts of all rows are exact: words are told apart by hashes
    that are checked to differ.

    Returns lang, rank (from 1), phrase, a, l, r, n (words of the language) and score, at most `top`
    rows a language by score, a (both descending) and phrase. Null lang is "und", null and empty
    texts hold nothing; repeated rows count as often as they are there. Other columns are ignored,
    whatever their names; an empty table gives an empty one."""
    words, grams = frequent(docs, longest, least)
    total = words.groupBy("lang").agg(F.sum("n").alias("n"))
    vocabulary = cut(words.filter(F.col("n") >= least))
    counts = cut(vocabulary.select("lang", F.array("h").alias("g"), F.col("n").alias("f")).unionByName(grams))
    counts = F.broadcast(counts) if fits_rows(counts, longest) else counts
    around = cut(swallowed(grams, inside))
    around = F.broadcast(around) if fits_rows(around, longest) else around
    stand = grams.join(around, ["lang", "g"], "left").filter(F.col("most").isNull() | (F.col("most") * 100 < F.col("f") * inside)).drop("most")
    scored = cut(best_cut(stand, counts))
    best = [F.col("score").desc(), F.col("a").desc()]
    part = F.pmod(F.xxhash64("g"), F.lit(PARTS)).alias("part")

    def head(df: DataFrame, rank: Column) -> DataFrame:
        return df.withColumn("rank", rank.cast("long")).filter(F.col("rank") <= top).drop("rank")

    few = head(scored.select("*", part), F.rank().over(Window.partitionBy("lang", "part").orderBy(*best)))
    spelt = few.select("*", F.posexplode("g").alias("i", "h")).join(small(vocabulary.select("lang", "h", "word")), ["lang", "h"])
    spelt = spelt.groupBy("lang", "part", "g", "a", "l", "r", "score").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    few = head(spelt, F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best, "phrase")))
    few = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best, "phrase")).cast("long")).filter(F.col("rank") <= top)
    return few.join(F.broadcast(total) if fits_rows(total, 0) else total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
