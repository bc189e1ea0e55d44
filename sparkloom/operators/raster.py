"""Rasters as rows (a pixel a row) and the pairing metrics over masks (mask, iy, ix)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import kernels
from ..storage import cut


def histogram(pts: DataFrame, x0: float, y0: float, dx: float, nx: int, ny: int) -> DataFrame:
    """Counts per cluster and pixel; bins are half open, the last closed; outside is dropped."""
    bin_ = lambda c, o, n: F.when(F.col(c) == o + n * dx, F.lit(n - 1)).otherwise(F.floor((F.col(c) - o) / dx))
    p = pts.select("cluster", bin_("x", x0, nx).alias("ix"), bin_("y", y0, ny).alias("iy"))
    return p.filter(F.col("ix").between(0, nx - 1) & F.col("iy").between(0, ny - 1)).groupBy("cluster", "iy", "ix").agg(F.count(F.lit(1)).alias("v"))


def channels(raster: DataFrame, cluster_weight: float = 0.6, density_weight: float = 1.0) -> DataFrame:
    """Composition (a cluster's share of its pixel) and density (log1p of the pixel's sum over its
    99 % quantile, at most 1), times the root of their weights: channel, iy, ix, v."""
    total = raster.groupBy("iy", "ix").agg(F.sum("v").alias("s"))
    q = total.agg(F.greatest(F.percentile(F.log1p("s"), F.lit(0.99)), F.lit(1e-8)).alias("q"))
    comp = raster.join(total, ["iy", "ix"]).select(F.col("cluster").alias("channel"), "iy", "ix", (F.col("v") / F.greatest("s", F.lit(1e-8)) * cluster_weight**0.5).alias("v"))
    dens = total.join(F.broadcast(q)).select(F.lit("density").alias("channel"), "iy", "ix", (F.least(F.lit(1.0), F.log1p("s") / F.col("q")) * density_weight**0.5).alias("v"))
    return comp.unionByName(dens)


def blur(raster: DataFrame, sigma: float, nx: int, ny: int, by: str = "cluster") -> DataFrame:
    """Separable Gaussian, radius int(4 sigma + 0.5), edges repeated. A pixel spreads along one
    axis to those that read it (an edge pixel once for each clamped reader), then is summed."""
    import math

    r = int(4 * sigma + 0.5)
    k = [math.exp(-0.5 * (i / sigma) ** 2) for i in range(-r, r + 1)]
    k = [w / sum(k) for w in k]

    def axis(df: DataFrame, c: str, n: int) -> DataFrame:
        # reader t reads clamp(t + i) with weight k[i]
        reads = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(w).alias("w")) for i, w in zip(range(-r, r + 1), k)])
        out = df.withColumn("t", F.explode(F.sequence(F.greatest(F.lit(0), F.col(c) - r), F.least(F.lit(n - 1), F.col(c) + r))))
        out = out.withColumn("w", F.aggregate(F.filter(reads, lambda e: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.col("t") + e["i"])) == F.col(c)), F.lit(0.0), lambda a, e: a + e["w"]))
        keep = [x for x in (by, "iy", "ix") if x != c]
        return out.groupBy(*keep, F.col("t").alias(c)).agg(F.sum(F.col("v") * F.col("w")).alias("v"))

    return axis(axis(raster, "iy", ny), "ix", nx).select(by, "iy", "ix", "v")


def areas(masks: DataFrame) -> DataFrame:
    return masks.groupBy("mask").agg(F.count(F.lit(1)).alias("area"))


def overlaps(a: DataFrame, b: DataFrame, least: int = 1) -> DataFrame:
    """Dice and IoU of all pairs that share `least` pixels, by an equality join on pixels: a, b,
    both, na, nb, dice, iou."""
    both = a.withColumnRenamed("mask", "a").join(b.withColumnRenamed("mask", "b"), ["iy", "ix"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("both")).filter(F.col("both") >= least)
    na, nb = areas(a).toDF("a", "na"), areas(b).toDF("b", "nb")
    r = both.join(na, "a").join(nb, "b")
    return r.withColumn("dice", 2 * F.col("both") / (F.col("na") + F.col("nb"))).withColumn("iou", F.col("both") / (F.col("na") + F.col("nb") - F.col("both")))


def boundary(masks: DataFrame, eight: bool = False) -> DataFrame:
    """Pixels with a neighbour (4 or 8) outside the mask, outside the raster counting so."""
    steps = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if (i or j) and (eight or not (i and j))]
    near = F.explode(F.array(*[F.struct((F.col("iy") + i).alias("y"), (F.col("ix") + j).alias("x")) for i, j in steps]))
    n = masks.withColumn("n", near).select("mask", F.col("n.y").alias("iy"), F.col("n.x").alias("ix"))
    inside = n.join(masks, ["mask", "iy", "ix"], "left_semi")  # counts, for each pixel, its neighbours in the mask
    counts = inside.groupBy("mask", "iy", "ix").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") == len(steps))
    return masks.join(counts, ["mask", "iy", "ix"], "left_anti")


def _read_fields(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """mask, iy, ix, d: distances of the wanted pixels (mask, iy, ix) to the mask's line of pixels. A
    mask is one task, on a raster of the box of its own lines and wanted pixels; only these leave it."""

    def run(line: pd.DataFrame, want: pd.DataFrame) -> pd.DataFrame:
        if line.empty or want.empty:
            return pd.DataFrame({c: pd.Series([], dtype=object) for c in ("mask", "iy", "ix", "d")})
        y0, x0 = (min(line[c].min(), want[c].min()) for c in ("iy", "ix"))
        y1, x1 = (max(line[c].max(), want[c].max()) for c in ("iy", "ix"))
        off = np.ones((y1 - y0 + 1, x1 - x0 + 1), bool)
        off[line["iy"] - y0, line["ix"] - x0] = False
        return want.assign(d=kernels.distance(off)[want["iy"] - y0, want["ix"] - x0])[["mask", "iy", "ix", "d"]]

    kind = lines.schema["mask"].dataType.simpleString()
    return lines.select("mask", "iy", "ix").groupBy("mask").cogroup(wanted.groupBy("mask")).applyInPandas(run, f"mask {kind}, iy int, ix int, d double")


def boundary_distance(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """For listed pairs (a, b), each boundary pixel's distance to the other boundary: a, b, side,
    iy, ix, d. Each boundary's distance transform is made once, in the box of the pixels that are
    asked of it, and read at these, so no pixel of one meets all pixels of the other."""
    p = pairs.select("a", "b").distinct()
    pixels = lambda lines, end: p.join(lines.select(F.col("mask").alias(end), "iy", "ix"), end)

    def read(asked: DataFrame, lines: DataFrame, other: str, side: str) -> DataFrame:
        asked = cut(asked)
        wanted = asked.select(F.col(other).alias("mask"), "iy", "ix").distinct()
        field = _read_fields(lines.toDF(*lines.columns), wanted).withColumnRenamed("mask", other)
        return asked.join(field, [other, "iy", "ix"]).select("a", "b", F.lit(side).alias("side"), "iy", "ix", "d")

    return read(pixels(a, "a"), b, "b", "a").unionByName(read(pixels(b, "b"), a, "a", "b"))


def surface(distances: DataFrame, d0: float = 25.0) -> DataFrame:
    """Chamfer distance (mean of both sides' means) and similarity exp(-chamfer / d0), average and
    greatest surface distance over both sides pooled."""
    side = distances.groupBy("a", "b", "side").agg(F.avg("d").alias("m"), F.sum("d").alias("s"), F.count(F.lit(1)).alias("n"), F.max("d").alias("x"))
    r = side.groupBy("a", "b").agg(F.avg("m").alias("chamfer"), (F.sum("s") / F.sum("n")).alias("asd"), F.max("x").alias("hd"))
    return r.withColumn("chamfer_sim", F.exp(-F.col("chamfer") / d0))


def polar_signature(masks: DataFrame, bins: int = 72) -> DataFrame:
    """Greatest distance from the centroid in each angle bin, over its maximum."""
    c = masks.groupBy("mask").agg(F.avg("iy").alias("cy"), F.avg("ix").alias("cx"))
    r = masks.join(c, "mask").withColumn("a", F.atan2(F.col("iy") - F.col("cy"), F.col("ix") - F.col("cx"))).withColumn("r", F.hypot(F.col("iy") - F.col("cy"), F.col("ix") - F.col("cx")))
    import math

    bin_ = F.least(F.lit(bins - 1), F.floor((F.col("a") + math.pi) / (2 * math.pi) * bins))
    s = r.groupBy("mask", bin_.alias("bin")).agg(F.max("r").alias("r"))
    return s.withColumn("r", F.col("r") / F.greatest(F.max("r").over(Window.partitionBy("mask")), F.lit(1e-12)))


def depth_profile_cosine(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Cosine of the row sums of two masks on one raster."""
    ra = a.groupBy(F.col("mask").alias("a"), "iy").agg(F.count(F.lit(1)).alias("x"))
    rb = b.groupBy(F.col("mask").alias("b"), "iy").agg(F.count(F.lit(1)).alias("y"))
    na, nb = ra.groupBy("a").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("na")), rb.groupBy("b").agg(F.sqrt(F.sum(F.col("y") * F.col("y"))).alias("nb"))
    dot = pairs.select("a", "b").join(ra, "a").join(rb, ["b", "iy"]).groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("xy"))
    return dot.join(na, "a").join(nb, "b").select("a", "b", (F.col("xy") / (F.col("na") * F.col("nb"))).alias("depth_cosine"))


def mirrored_overlap(masks: DataFrame, size: int, axis: str = "ix") -> DataFrame:
    """Dice of every mask with every other one mirrored about the raster's middle, a < b."""
    flip = masks.withColumn(axis, F.lit(size - 1) - F.col(axis))
    return overlaps(masks, flip).filter("a < b")


def union_masks(masks: DataFrame, groups: DataFrame) -> DataFrame:
    """Pixels of grouped masks: groups (group, mask)."""
    return masks.join(groups, "mask").select(F.col("group").alias("mask"), "iy", "ix").distinct()


def common_masks(masks: DataFrame, groups: DataFrame) -> DataFrame:
    """Pixels that all masks of a group share. A mask named twice counts once."""
    g = groups.select("group", "mask").distinct()
    rows = masks.select("mask", "iy", "ix").distinct().join(g, "mask").groupBy("group", "iy", "ix").agg(F.count(F.lit(1)).alias("c"))
    return rows.join(g.groupBy("group").agg(F.count(F.lit(1)).alias("n")), "group").filter("c = n").select(F.col("group").alias("mask"), "iy", "ix")


def differing_masks(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pixels in one mask of each listed pair (a, b) and not in the other: a, b, iy, ix."""
    p = pairs.select("a", "b").distinct()
    one = p.join(a.select(F.col("mask").alias("a"), "iy", "ix").distinct(), "a").select("a", "b", "iy", "ix")
    two = p.join(b.select(F.col("mask").alias("b"), "iy", "ix").distinct(), "b").select("a", "b", "iy", "ix")
    return one.unionByName(two).groupBy("a", "b", "iy", "ix").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").drop("c")


def difference_areas(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """a, b and area, the pixels in one mask of a listed pair and not in the other, by the areas and
    what the masks share; no pixel meets a pair. Pairs that differ nowhere have 0; a mask that has no
    pixels counts as empty."""
    one, two = a.select("mask", "iy", "ix").distinct(), b.select("mask", "iy", "ix").distinct()
    p = pairs.select("a", "b").distinct().join(areas(one).toDF("a", "na"), "a", "left").join(areas(two).toDF("b", "nb"), "b", "left")
    r = p.join(overlaps(one, two).select("a", "b", "both"), ["a", "b"], "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    return r.select("a", "b", (n("na") + n("nb") - 2 * n("both")).alias("area"))


def pair_unions(scores: DataFrame, k: int = 5) -> DataFrame:
    """Unordered pairs of the k best source masks of each target: b, a1, a2. scores: a, b, score."""
    w = Window.partitionBy("b").orderBy(F.desc("score"), "a")
    top = scores.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= k)
    x, y = top.select("b", F.col("a").alias("a1")), top.select("b", F.col("a").alias("a2"))
    return x.join(y, "b").filter("a1 < a2")


def label_transfer(pts: DataFrame, raster: DataFrame, names: DataFrame, nx: int, ny: int) -> DataFrame:
    """Read each point's label at its pixel (half to even, clipped into the raster) and join its
    name; label 0 or none is outside. pts: id, x, y in pixels; raster: iy, ix, label."""
    clip = lambda c, n: F.greatest(F.lit(0), F.least(F.lit(n - 1), F.rint(c).cast("int")))
    p = pts.select("id", clip("x", nx).alias("ix"), clip("y", ny).alias("iy"))
    return p.join(raster, ["iy", "ix"], "left").join(names, "label", "left").select("id", F.coalesce("label", F.lit(0)).alias("label"), F.coalesce("name", F.lit("outside")).alias("name"))


def cluster_label_map(pts: DataFrame, pairs: DataFrame, unmatched: str = "unassigned") -> DataFrame:
    """Each point (id, cluster) with the target of its cluster: label (the candidate's name, or
    `unmatched`), labels (its label ids), pair_type, score and matched. pairs: cluster, candidate,
    labels, score (and pair_type); of a cluster's pairs the best by score, then name, counts."""
    kind = F.col("pair_type") if "pair_type" in pairs.columns else F.lit("")
    best = pairs.groupBy("cluster").agg(F.min(F.struct((-F.col("score")).alias("k"), "candidate", "labels", kind.alias("pair_type"))).alias("p"))
    rows = pts.select("id", "cluster").join(best, "cluster", "left")
    return rows.select("id", "cluster", F.coalesce("p.candidate", F.lit(unmatched)).alias("label"), F.coalesce("p.labels", F.array().cast(pairs.schema["labels"].dataType)).alias("labels"), F.coalesce("p.pair_type", F.lit("")).alias("pair_type"), (-F.col("p.k")).alias("score"), F.col("p").isNotNull().alias("matched"))


def path_prefixes(paths: DataFrame, leaves: DataFrame, least: int = 2) -> DataFrame:
    """Every prefix of at least `least` steps of a hierarchy path, with the leaves under it.
    paths: id, path (/1/2/3/); leaves: id (present in the slice)."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    rows = paths.join(leaves, "id", "left_semi").withColumn("parts", parts).filter(F.size("parts") >= least)
    pre = rows.withColumn("k", F.explode(F.sequence(F.lit(least), F.size("parts")))).select("id", F.concat(F.lit("/"), F.array_join(F.slice("parts", F.lit(1), F.col("k")), "/"), F.lit("/")).alias("prefix"))
    return pre.groupBy("prefix").agg(F.array_sort(F.collect_set("id")).alias("leaves"), F.count_distinct("id").alias("n"))


def candidates(overlap: DataFrame, sets: DataFrame, cluster_area: DataFrame, label_area: DataFrame, least: float = 0.05, k: int = 30) -> DataFrame:
    """Cluster against label-set candidates: pixel overlaps (cluster, label, both) summed over the
    labels of each set (candidate, label): Dice, screened and the k best of a cluster."""
    both = overlap.join(sets, "label").groupBy("cluster", "candidate").agg(F.sum("both").alias("both"))
    size = sets.join(label_area, "label").groupBy("candidate").agg(F.sum("area").alias("ca"))
    d = both.join(size, "candidate").join(cluster_area, "cluster").withColumn("dice", 2 * F.col("both") / (F.col("ca") + F.col("area")))
    w = Window.partitionBy("cluster").orderBy(F.desc("dice"), "candidate")
    return d.filter(F.col("dice") >= least).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("cluster", "candidate", "dice", "rank")


def channel_weights(area: DataFrame, power: float = 0.5, low: float = 0.5, high: float = 2.0) -> DataFrame:
    """1 / area^p over its mean, clipped, over its mean again. area: channel, area (one row each)."""
    all_ = Window.partitionBy()
    w = area.withColumn("w", 1 / F.pow(F.greatest("area", F.lit(1)), F.lit(power))).withColumn("w", F.col("w") / F.avg("w").over(all_))
    w = w.withColumn("w", F.least(F.lit(high), F.greatest(F.lit(low), F.col("w"))))
    return w.withColumn("w", F.col("w") / F.avg("w").over(all_))


def greedy(scores: DataFrame, most: int | None = None) -> DataFrame:
    """Greedy one-to-one matching by score (ties by a, b): rounds of mutual best pairs, which equal
    the sequential greedy under a strict order. A round halves what is left at least in common
    cases; each is a window over survivors. scores: a, b, score."""
    left, done = cut(scores.select("a", "b", "score")), None
    order = [F.desc("score"), "a", "b"]
    while not left.isEmpty():
        ra, rb = F.row_number().over(Window.partitionBy("a").orderBy(*order)), F.row_number().over(Window.partitionBy("b").orderBy(*order))
        best = left.withColumn("ra", ra).withColumn("rb", rb).filter("ra = 1 AND rb = 1").select("a", "b", "score")
        best = cut(best)
        done = best if done is None else done.unionByName(best)
        left = cut(left.join(best.select("a"), "a", "left_anti").join(best.select("b"), "b", "left_anti"))
    done = scores.select("a", "b", "score").limit(0) if done is None else done
    return done.orderBy(*order).limit(most) if most else done


def pairing_groups(pairs: DataFrame, left: Column, right: Column) -> DataFrame:
    """Curated many-to-many pairs: one row a group with the sorted distinct ids of either side."""
    p = pairs.select("group_id", left.alias("l"), right.alias("r"))
    ids = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return p.groupBy("group_id").agg(ids("l").alias("source_ids"), ids("r").alias("target_ids"))
