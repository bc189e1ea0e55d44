"""Structures of an image from its feature grid (iy, ix, v, rgb)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from . import agglomerate
from .clustering import _matrix, _sums, kmeans, project
from .raster import mirrored_overlap

#: Weights of colour and place, clusters, and what a symmetry merge needs.
RGB_WEIGHT, XY_WEIGHT, CLUSTERS, MERGES, DICE_LEAST, GAIN_LEAST = 0.25, 0.05, 30, 2, 0.15, 0.02


def feature_vectors(grid: DataFrame) -> DataFrame:
    """z-scored blocks side by side: features, colour * RGB_WEIGHT, place * XY_WEIGHT. grid: iy, ix,
    v (features), rgb. Returns id, iy, ix, v."""
    rows = grid.select(F.concat_ws(",", "iy", "ix").alias("id"), "iy", "ix", F.concat("v", "rgb", F.array(F.col("iy").cast("double"), F.col("ix").cast("double"))).alias("v"))
    p = len(rows.first()["v"])
    s = _sums(rows.select("v"), lambda d: np.concatenate(([len(d)], (x := _matrix(d["v"])).sum(0), (x * x).sum(0))), 1 + 2 * p)
    mean = s[1 : p + 1] / s[0]
    sd = np.sqrt(np.maximum(s[p + 1 :] / s[0] - mean**2, 0))
    weight = np.concatenate([np.ones(p - 5), np.full(3, RGB_WEIGHT), np.full(2, XY_WEIGHT)])
    scale = np.where(sd > 1e-8, weight / np.maximum(sd, 1e-8), 0.0)
    return project(rows, lambda x: (x - mean) * scale)


def cluster_grid(grid: DataFrame, k: int = CLUSTERS, background: float | None = None, iterations: int = 11) -> DataFrame:
    """k-means structures of a feature grid: iy, ix, mask. With `background`, pixels whose colour is
    that bright on average are left out first."""
    if background is not None:
        grid = grid.filter(F.aggregate("rgb", F.lit(0.0), lambda a, x: a + x) / F.size("rgb") < background)
    v = feature_vectors(grid)
    labels, _ = kmeans(v.select("id", "v"), k, iterations)
    return v.join(labels, "id").select("iy", "ix", F.col("label").cast("string").alias("mask"))


def merge_structures(pixels: DataFrame, count: int, linkage: str = "average") -> DataFrame:
    """Structures of a raster (iy, ix, label, v) merged over their borders until `count` are left:
    iy, ix, label (that of the smallest merged one)."""
    adjacency = cut(agglomerate.region_adjacency(pixels))
    found = agglomerate.regions(pixels.select(F.col("label").alias("id")), agglomerate.merges(adjacency, linkage), count)
    return pixels.join(found.toDF("label", "merged"), "label").select("iy", "ix", F.col("merged").alias("label"))


def symmetric_merges(masks: DataFrame, size: int, axis: str = "ix", merges: int = MERGES) -> pd.DataFrame:
    """Pairs (a, b) that mirror each other best, greedy over the few dozen structures, each structure
    once; a merge needs DICE_LEAST and a gain over either one's own symmetry."""
    pairs = mirrored_overlap(masks, size, axis).select("a", "b", "dice").toPandas()
    flip = masks.withColumn(axis, F.lit(size - 1) - F.col(axis)).withColumn("hit", F.lit(1))
    self_ = masks.join(flip, ["mask", "iy", "ix"], "left").groupBy("mask").agg((F.count("hit") / F.count(F.lit(1))).alias("own")).toPandas()
    own = dict(zip(self_["mask"], self_["own"]))
    seen: set = set()
    out = []
    for a, b, dice in pairs.sort_values(["dice", "a", "b"], ascending=[False, True, True]).itertuples(index=False):
        if len(out) < merges and a not in seen and b not in seen and dice >= DICE_LEAST and dice - max(own[a], own[b]) >= GAIN_LEAST:
            out.append((a, b, dice))
            seen |= {a, b}
    return pd.DataFrame(out, columns=["a", "b", "dice"])


def drop_islands(masks: DataFrame, parts: DataFrame, least: int = 250) -> DataFrame:
    """Keep parts (mask, part, iy, ix) of at least `least` pixels, and each mask's largest."""
    size = parts.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n"))
    size = size.withColumn("rn", F.row_number().over(Window.partitionBy("mask").orderBy(F.desc("n"), "part")))
    keep = size.filter((F.col("n") >= least) | (F.col("rn") == 1)).select("mask", "part")
    return masks.join(parts.join(F.broadcast(keep), ["mask", "part"], "left_semi"), ["mask", "iy", "ix"], "left_semi")
