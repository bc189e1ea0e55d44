"""Mixing sources to target weights by the cube method (balanced sampling)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks_of, cut, n_words, small, unused, with_row_id

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2.0
FLIGHT = 1024
#: At least so many of a source's smallest units are kept from its last flight, to settle what that
#: leaves undecided; at most half of them.
LANDING = 16
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1
#: A probability this close to 0 or 1 counts as decided.
_EPS = 1e-9


def _coin(state: int) -> tuple[int, float]:
    """splitmix64: the next state and a number in [0, 1)."""
    state = (state + _PRIME) & _MASK
    z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
    z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
    return state, ((z ^ (z >> 31)) >> 11) / (1 << 53)


def flight(sizes: list[float], rows: list[float], probs: list[float], seed: int) -> list[float]:
    """Cube flight phase under two balancing equations, the sums of `sizes` and of `rows`.

    Three undecided units span a 2x3 constraint matrix with a null vector u; a martingale step
    along +u or -u decides at least one of them and keeps both sums. At most two stay undecided."""
    p, state = list(probs), seed & _MASK
    held: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        held.append(i)
        while len(held) == 3:
            a, b, c = held
            u = (sizes[b] * rows[c] - sizes[c] * rows[b], sizes[c] * rows[a] - sizes[a] * rows[c], sizes[a] * rows[b] - sizes[b] * rows[a])
            top = max(map(abs, u))
            if top <= 1e-12 * max(1.0, abs(sizes[a]), abs(sizes[b]), abs(sizes[c])):  # proportional rows: any exchange of two keeps both sums
                u, top = (rows[b], -rows[a], 0.0), max(rows[a], rows[b])
            u = tuple(x / top for x in u)
            up = min((1 - p[i]) / x if x > 0 else -p[i] / x for i, x in zip(held, u) if abs(x) > 1e-15)
            down = min(p[i] / x if x > 0 else (p[i] - 1) / x for i, x in zip(held, u) if abs(x) > 1e-15)
            state, r = _coin(state)
            step = up if r * (up + down) < down else -down
            for i, x in zip(held, u):
                p[i] += step * x
            left = [i for i in held if _EPS < p[i] < 1 - _EPS]
            if len(left) == 3:  # rounding: decide the nearest
                i = min(held, key=lambda i: min(p[i], 1 - p[i]))
                p[i] = round(p[i])
                left.remove(i)
            for i in held:
                if i not in left:
                    p[i] = float(round(p[i]))
            held = left
    return p


def land(sizes: list[float], probs: list[float], aim: float) -> list[float]:
    """Landing phase: the units left, at most half of a last chunk; greedy from the largest, each taken
    if that brings the running token sum nearer to `aim`."""
    out, sum_ = [0.0] * len(probs), 0.0
    for i in sorted(range(len(probs)), key=lambda i: -sizes[i]):
        if abs(sum_ + sizes[i] - aim) < abs(sum_ - aim):
            out[i], sum_ = 1.0, sum_ + sizes[i]
    return out


def _fly(last: bool):
    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable").reset_index(drop=True)
        sizes, rows, probs = (pdf[c].astype(float).tolist() for c in ("mass", "m", "p"))
        flown = len(pdf)
        if last:  # the smallest wait for the landing, as many as can make up for the largest
            play = 0.0
            while flown > len(pdf) - LANDING and flown or flown > len(pdf) // 2 and play < sizes[0]:
                flown -= 1
                play += sizes[flown] * min(probs[flown], 1 - probs[flown])
        p = flight(sizes[:flown], rows[:flown], probs[:flown], int(pdf["key"].iloc[0]) ^ len(pdf)) + probs[flown:]
        if last:
            open_ = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
            for i, x in zip(open_, land([sizes[i] for i in open_], [p[i] for i in open_], sum(sizes[i] * p[i] for i in open_))):
                p[i] = x
        return pdf.assign(p=p)

    return solve


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """Fill sources to their weights: target = min(cap * size, level * weight), the level such that
    targets add up to share * all sizes. sources: source, source_size. The weights repeat over
    sources in code point order, null last. Returns source, source_size, target.

    The level is found by sums over the source table; only scalars reach the driver. With every
    source at its cap (share > cap), all stop there."""
    dealt = sources.withColumn("__null", F.col("source").isNull()).repartitionByRange(8, "__null", "source").sortWithinPartitions("__null", "source")
    mid = F.monotonically_increasing_id()
    dealt = cut(dealt.select("source", "source_size", F.shiftright(mid, 33).alias("__part"), mid.bitwiseAND(F.lit((1 << 33) - 1)).alias("__row")))
    sizes = dict(dealt.groupBy("__part").count().collect())  # at most 8 rows
    before, offset = {}, 0
    for part in sorted(sizes):
        before[part], offset = offset, offset + sizes[part]
    offsets = F.coalesce(*[F.when(F.col("__part") == k, F.lit(v)) for k, v in before.items()], F.lit(0)) if before else F.lit(0)
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(offsets + F.col("__row"), F.lit(len(weights))) + 1).cast("int"))
    table = cut(dealt.select("source", "source_size", weight.alias("__w"), (F.col("source_size") * cap).alias("__cap")))
    total = (table.agg(F.sum("source_size")).first()[0] or 0) * share
    level = 0.0
    while True:
        full = F.col("__cap") <= F.col("__w") * level
        w, caps = table.agg(F.sum(F.when(~full, F.col("__w"))), F.sum(F.when(full, F.col("__cap")))).first()
        if not w:
            break
        new = max(0.0, (total - (caps or 0.0)) / w)
        if new <= level * (1 + 1e-15):
            break
        level = new
    return table.select("source", "source_size", F.least("__cap", F.col("__w") * level).cast("double").alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """Choose how often each document is taken so that sources meet their targets.

    A source's documents share one expected number of copies, target / source_size: its whole part
    is taken by all, its fraction is the inclusion probability moved by the cube method under two
    equations, tokens and documents. Sources are dealt by hash into chunks of about FLIGHT units;
    each chunk leaves at most two units undecided, which are gathered and flown again until one
    chunk a source is left, where the landing decides the last two and the smallest. So no source comes into one
    task whole, and the number of rounds is the logarithm of the corpus.

    Returns doc_id, source, size, source_size, target, copies, taken (= copies * size), one row per
    input row. Null or blank text has size 0 and is taken in its source's whole part or by its
    draw like any other; null source is a source of its own, last in order; rows equal in
    doc_id, source and size are one unit and get equal copies. The draw depends only on values and
    `seed`. Other columns are ignored; an empty table gives an empty one."""
    rows = cut(sizes_of(docs))
    return attach(rows, plan_mix(rows, weights, share, cap, seed))


def sizes_of(docs: DataFrame, *more) -> DataFrame:
    return docs.select(*more, "doc_id", "source", n_words(F.col("text")).alias("size"))


def attach(rows: DataFrame, units: DataFrame) -> DataFrame:
    """rows (doc_id, source, size and others) with what their units hold, and taken."""
    keys = ["doc_id", "source", "size"]
    u = units.select(*[F.col(c).alias(f"unit_{c}") if c in keys else c for c in units.columns])
    on = [F.col(c).eqNullSafe(F.col(f"unit_{c}")) for c in keys]
    return rows.join(small(u), on).drop(*[f"unit_{c}" for c in keys]).withColumn("taken", F.col("copies") * F.col("size"))


def plan_mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 17) -> DataFrame:
    """Of materialised rows (doc_id, source, size) the units: doc_id, source, size, each triple once,
    source_size, target and copies."""
    units = cut(rows.groupBy("source", "doc_id", "size").agg(F.count(F.lit(1)).alias("m")))
    sources = cut(units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.count(F.lit(1)).alias("__units")))
    goal = targets(sources.select("source", "source_size"), weights, share, cap)
    goal = cut(goal.join(sources.select(F.col("source").alias("__src"), "__units"), F.col("source").eqNullSafe(F.col("__src"))).drop("__src"))
    g = small(goal.withColumnRenamed("source", "__src"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    units = units.join(g, F.col("source").eqNullSafe(F.col("__src"))).drop("__src")
    key = F.xxhash64(F.lit(seed), "doc_id", "size")
    units = units.withColumn("__rate", rate).withColumn("whole", F.floor(F.col("__rate") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("__rate") - F.col("whole")))
    units = cut(units.withColumn("key", key).withColumn("mass", F.col("size") * F.col("m").cast("double")).drop("__rate"))
    names = [c for c in units.columns if c != "__units"]
    decided = []
    open_, most = units, goal.agg(F.max("__units")).first()[0] or 0
    if most == 0:
        return units.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("copies"))
    chunk = chunks_of(F.col("__units"), FLIGHT)
    while True:
        last = most <= FLIGHT
        dealt = open_.withColumn("__chunk", F.pmod(F.xxhash64(F.lit(seed + 1), "key"), chunk))
        flown = cut(dealt.groupBy("source", "__chunk").applyInPandas(_fly(last), dealt.schema))
        sure = (F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)
        if last:
            decided.append(flown.select(*names))
            break
        decided.append(flown.filter(sure).select(*names))
        rest = flown.filter(~sure).drop("__units", "__chunk")
        left = cut(rest.groupBy("source").agg(F.count(F.lit(1)).alias("__units")))
        most = left.agg(F.max("__units")).first()[0]
        if not most:
            break
        left = small(left.withColumnRenamed("source", "__src"))
        open_ = rest.join(left, F.col("source").eqNullSafe(F.col("__src"))).drop("__src")
    out = decided[0]
    for x in decided[1:]:
        out = out.unionByName(x)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") + F.round("p")).cast("long").alias("copies"))


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: each document as often as `mix` takes it, columns as they came, whatever
    the names of others than doc_id, source and text. Words are counted once; documents meet their
    copies by row ids."""
    rid, copies = unused(docs, "rid", "copies")
    docs_ = with_row_id(docs, rid)
    rows = cut(sizes_of(docs_, F.col(rid).alias("rid")))
    taken = cut(attach(rows, plan_mix(rows, **how)).filter("copies > 0").select(F.col("rid").alias(rid), F.col("copies").cast("int").alias(copies)))
    again = F.explode(F.sequence(F.lit(1), F.col(copies)))
    return docs_.join(small(taken), rid).drop(rid).withColumn(copies, again).drop(copies)
