"""Agglomeration of regions over their adjacency table: blocks of regions merge each in a task.

Adjacency: i < j, d (how unlike two regions are) and w (how much they touch). The distance of merged
regions follows from that of their parts: the mean of d by w, its maximum or its minimum. None of these
brings a region nearer than its parts were, so regions that are each other's nearest merge whatever others
do, and a block of regions with all their edges merges the nearest first, up to those whose nearest is
in another block, as it would among all. Regions that lead to each other by their nearest share a block,
and what is left after a round is dealt anew. By the minimum, `single` goes by a rule of its own (see
`_single`)."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Edges that merge in one task, about (a region's own are never parted); so many and fewer are one block.
BLOCK = 1 << 18
#: Steps, as a power of two, in which regions are followed by their nearest to share a block.
HOPS = 3
LINKAGES = {"average": (F.sum, F.sum), "complete": (F.max, F.sum), "single": (F.min, F.sum)}


def region_adjacency(pixels: DataFrame) -> DataFrame:
    """i, j, d, w of regions of a raster (iy, ix, label, v): labels that are neighbours up, down, left
    or right, the Euclidean distance of their mean features, and the pixel sides between them."""
    n = pixels.agg(F.max(F.size("v"))).first()[0] or 0
    mean = F.array(*[F.avg(F.get("v", F.lit(k))) for k in range(n)])
    means = cut(pixels.groupBy("label").agg(mean.alias("m")))
    one = pixels.select("iy", "ix", "label")
    steps = F.explode(F.array(F.struct((F.col("iy") + 1).alias("iy"), F.col("ix").alias("ix")), F.struct(F.col("iy").alias("iy"), (F.col("ix") + 1).alias("ix")))).alias("s")
    other = one.select(F.col("label").alias("other"), steps).select("other", "s.*")
    pairs = one.join(other, ["iy", "ix"]).filter("label <> other").groupBy(F.least("label", "other").alias("i"), F.greatest("label", "other").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    a, b = means.toDF("i", "mi"), means.toDF("j", "mj")
    d2 = F.aggregate(F.zip_with("mi", "mj", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)
    return pairs.join(a, "i").join(b, "j").select("i", "j", F.sqrt(d2).alias("d"), "w")


def merges(adjacency: DataFrame, linkage: str = "average", stop: float | None = None) -> DataFrame:
    """All merges of the regions of a materialised adjacency (i, j, d, w): into, from (the larger id,
    which ends), height and round. Ends where no regions touch or the nearest are over `stop` apart.
    Equal distances go by ids. Where merges rest on each other, `round` tells their order."""
    if linkage == "single":
        return _single(adjacency, stop)
    over, total = LINKAGES[linkage]
    mean = linkage == "average"
    held = F.col("d") * F.col("w") if mean else F.col("d")
    edges = cut(adjacency.filter("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), held.cast("double").alias("s"), F.col("w").cast("double").alias("w")).groupBy("i", "j").agg(over("s").alias("s"), total("w").alias("w")))
    kind = adjacency.schema["i"].dataType.simpleString()

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        here = pdf["block"].iloc[0]
        outside = set(pdf["i"][pdf["bi"] != here]) | set(pdf["j"][pdf["bj"] != here])
        return _merged(pdf, outside, mean, stop)

    out, turns = None, 0
    while n := edges.count():
        if n <= BLOCK:
            parts = edges.select("*", F.lit(0).alias("bi"), F.lit(0).alias("bj"), F.lit(0).alias("block"))
        else:
            home = _homes(edges, F.col("s") / F.col("w") if mean else F.col("s"), -(-16 * n // BLOCK), stop)
            parts = edges.join(home.toDF("i", "bi").hint("merge"), "i").join(home.toDF("j", "bj").hint("merge"), "j")
            parts = parts.withColumn("block", F.explode(F.array_distinct(F.array("bi", "bj"))))
        new = cut(parts.groupBy("block").applyInPandas(run, f"into {kind}, from {kind}, height double, round int, end {kind}"))
        last = new.agg(F.max("round")).first()[0]
        if last is None:
            break
        found = new.select("into", "from", "height", (F.col("round") + turns).alias("round"))
        out = found if out is None else out.unionByName(found)
        if n <= BLOCK:
            break
        to, turns = new.select("from", "end"), turns + last + 1
        moved = edges.join(to.toDF("i", "ti").hint("merge"), "i", "left").join(to.toDF("j", "tj").hint("merge"), "j", "left").select(F.coalesce("ti", "i").alias("x"), F.coalesce("tj", "j").alias("y"), "s", "w").filter("x <> y")
        edges = cut(moved.groupBy(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(over("s").alias("s"), total("w").alias("w")))
    return adjacency.sparkSession.createDataFrame([], f"into {kind}, from {kind}, height double, round int") if out is None else out


def _homes(edges: DataFrame, d: Column, blocks: int, stop: float | None) -> DataFrame:
    """id and block of all regions: those that reach one region by their nearest share a block, which
    two that are each other's nearest always do. What would be over BLOCK edges is dealt over several."""
    rows = edges.select("i", "j", d.alias("d"))
    near = F.struct("d", "i", "j") if stop is None else F.when(F.col("d") <= stop, F.struct("d", "i", "j"))
    ends = rows.select(F.col("i").alias("id"), near.alias("k"), F.col("j").alias("to")).unionByName(rows.select(F.col("j").alias("id"), near.alias("k"), F.col("i").alias("to")))
    best = cut(ends.groupBy("id").agg(F.count(F.lit(1)).alias("c"), F.min_by("to", "k").alias("to")).withColumn("to", F.coalesce("to", "id")))
    both = F.col("back") == F.col("id")
    at = cut(best.join(best.select(F.col("id").alias("to"), F.col("to").alias("back")).hint("merge"), "to").select("id", "c", both.alias("both"), F.when(both, F.least("id", "to")).otherwise(F.col("to")).alias("p")))
    for _ in range(HOPS):
        at = cut(at.join(at.select(F.col("id").alias("p"), F.col("p").alias("pp")).hint("merge"), "p").select("id", "c", "both", F.col("pp").alias("p")))
    size = at.groupBy("p").agg(F.ceil(F.sum("c") / BLOCK).alias("n"))
    piece = F.when(F.col("both"), F.lit(0)).otherwise(F.pmod(F.xxhash64("id"), F.col("n")))
    return cut(at.join(size.hint("merge"), "p").select("id", F.pmod(F.xxhash64("p", piece.cast("long")), F.lit(blocks)).cast("int").alias("block")))


def _merged(edges: pd.DataFrame, held: set, mean: bool, stop: float | None) -> pd.DataFrame:
    """into, from, height and round (their order) of the merges among edges (i, j, s, w), the nearest
    first, and the region in which each one ends. Of held regions not all edges are here, so they merge
    with none, nor does what has its nearest among them."""
    near: dict = {}
    for i, j, s, w in zip(*(edges[c].tolist() for c in "ijsw")):
        near.setdefault(i, {})[j] = near.setdefault(j, {})[i] = (s, w)
    far = (lambda t: t[0] / t[1]) if mean else (lambda t: t[0])
    heap = [(far(t), i, j) for i, ts in near.items() for j, t in ts.items() if i < j]
    heapq.heapify(heap)
    out, end = [], {}
    while heap:
        d, i, j = heapq.heappop(heap)
        if stop is not None and d > stop:
            break
        if i not in near or j not in near[i] or far(near[i][j]) != d:
            continue
        if i in held or j in held:
            held |= {i, j}
            continue
        out.append((i, j, d))
        end[j] = i
        mine, gone = near[i], near.pop(j)
        del mine[j], gone[i]
        for k, t in gone.items():
            others = near[k]
            del others[j]
            if (had := mine.get(k)) is not None:
                t = (had[0] + t[0] if mean else max(had[0], t[0]), had[1] + t[1])
            mine[k] = others[i] = t
            heapq.heappush(heap, (far(t), min(i, k), max(i, k)))
    for i, j, _ in reversed(out):
        end[j] = end.get(i, i)
    table = pd.DataFrame(out, columns=["into", "from", "height"])
    return table.assign(round=range(len(out)), end=[end[j] for j in table["from"]])


def _single(adjacency: DataFrame, stop: float | None) -> DataFrame:
    """Merges by the minimum. A region ends at the least distance that joins it to a smaller id. Its
    nearest edge is the first to join it to anything, so where that leads to a smaller id the region
    ends there and its other edges, all longer, become those of that id. All such regions end in one
    round, in chains too, as the nearest edges along a chain grow no longer. Equal distances go by the
    ids of the adjacency; `round` tells their order. Ids in no order leave some log n rounds."""
    rows = adjacency.filter("i <> j").select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("d").cast("double").alias("d"))
    rows = rows if stop is None else rows.filter(F.col("d") <= stop)
    edges = cut(rows.groupBy("i", "j").agg(F.min("d").alias("d")).select("i", "j", F.struct("d", "i", "j").alias("k")))
    ended = None
    while not edges.isEmpty():
        ends = edges.unionByName(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "k"))
        new = cut(ends.groupBy("i").agg(F.min(F.struct("k", "j")).alias("m")).filter("m.j < i").select(F.col("i").alias("from"), F.col("m.j").alias("into"), F.col("m.k").alias("k")))
        ended = new if ended is None else ended.unionByName(new)
        to = _followed(new.select("from", "into"))
        a, b = to.toDF("i", "ti"), to.toDF("j", "tj")
        moved = edges.join(a, "i", "left").join(b, "j", "left").select(F.coalesce("ti", "i").alias("x"), F.coalesce("tj", "j").alias("y"), "k").filter("x <> y")
        edges = cut(moved.groupBy(F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j")).agg(F.min("k").alias("k")))
    kind = adjacency.schema["i"].dataType.simpleString()
    if ended is None:
        return adjacency.sparkSession.createDataFrame([], f"into {kind}, from {kind}, height double, round int")
    # what a region joined may have ended before that: then it joined what that one had joined
    ended, late = cut(ended), True
    while late:
        at = ended.select(F.col("from").alias("into"), F.col("into").alias("then"), F.col("k").alias("ko"))
        early = F.coalesce(F.col("ko") < F.col("k"), F.lit(False))
        ended = cut(ended.join(at, "into", "left").select("from", F.when(early, F.col("then")).otherwise(F.col("into")).alias("into"), "k", early.alias("late")))
        late = not ended.filter("late").isEmpty()
        ended = ended.drop("late")
    order = Window.partitionBy("k.d").orderBy("k")
    return ended.select("into", "from", F.col("k.d").alias("height"), (F.row_number().over(order) - 1).alias("round"))


def _followed(to: DataFrame) -> DataFrame:
    """from, into with into at the end of its chain; a step doubles what is followed."""
    more = True
    while more:
        step = cut(to.join(to.toDF("into", "then"), "into", "left").select("from", F.coalesce("then", "into").alias("into"), F.col("then").isNotNull().alias("more")))
        more, to = not step.filter("more").isEmpty(), step.drop("more")
    return to


def regions(nodes: DataFrame, merged: DataFrame, count: int | None = None) -> DataFrame:
    """id and label (the smallest id of its region) of nodes (id) after all merges, or after as many of
    the lowest as leave `count` regions, if the regions hang together so far."""
    if count is not None:
        n = nodes.select("id").distinct().count()
        merged = _lowest(merged, max(0, n - count))
    from .communities import components

    found = components(cut(merged.select(F.col("into").alias("i"), F.col("from").alias("j"))))
    return nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("label", "id").alias("label"))


def _lowest(merged: DataFrame, n: int) -> DataFrame:
    """The n lowest merges, by sorting these or the others, whichever are fewer."""
    over, key = merged.count() - n, ["height", "round", "into"]
    if over <= 0 or n <= over:
        return merged.orderBy(*key).limit(n) if over > 0 else merged
    first = merged.orderBy(*[F.desc(c) for c in key]).limit(over).agg(F.min(F.struct(*key)).alias("k"))
    return merged.join(F.broadcast(first), F.struct(*key) < F.col("k")).drop("k")  # one row
