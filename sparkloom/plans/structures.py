"""Alignment of a point section to label structures: an atlas slice, a histology image, an ATAC
section. One plan with the scoring of its kind: masks, pairs, channels, registration, flow, labels."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.registration import flow, register
from ..operators import pairing, raster
from ..storage import cut


def point_masks(pts: DataFrame, shape: tuple[int, int], least: int = 30, sigma: float = 1.0) -> DataFrame:
    """Soft masks of clusters of at least `least` points (pixel coordinates): mask, iy, ix."""
    pixel = pts.select(F.col("cluster").alias("mask"), F.rint("y").cast("int").alias("iy"), F.rint("x").cast("int").alias("ix")).filter(F.col("iy").between(0, shape[0] - 1) & F.col("ix").between(0, shape[1] - 1))
    counts = pixel.groupBy("mask", "iy", "ix").agg(F.count(F.lit(1)).alias("n"))
    big = counts.groupBy("mask").agg(F.sum("n").alias("s")).filter(F.col("s") >= least).select("mask")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["n"].to_numpy()
        m = kernels.soft_mask(np.repeat(pdf["iy"], n), np.repeat(pdf["ix"], n), shape, sigma)
        y, x = np.nonzero(m)
        return pd.DataFrame({"mask": pdf["mask"].iloc[0], "iy": y.astype("int32"), "ix": x.astype("int32")})

    return counts.join(F.broadcast(big), "mask").groupBy("mask").applyInPandas(run, "mask string, iy int, ix int")


def pair_up(source: DataFrame, target: DataFrame, shape: tuple[int, int], how: pairing.Scoring) -> DataFrame:
    """One-to-one pairs of masks by gated score: a, b, score."""
    scored = pairing.score(pairing.measure(source, target, shape, how.d0, how.intersection_least), how)
    return raster.greedy(scored, how.pairs_most)


def _match(n: int, shape: tuple[int, int], clip: float, iterations: int):
    """Grouped map: pixels (side 0 or 1, channel, iy, ix) of n pairs to the velocity that matches
    their signed distances, small structures weighing more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        a = np.zeros((2, n, *shape), bool)
        a[pdf["side"], pdf["channel"], pdf["iy"], pdf["ix"]] = True
        area = np.sqrt(np.maximum(a[1].sum((1, 2)), 1.0))
        weight = np.clip(area.mean() / area, 0.5, 2.0)[:, None, None]
        s, t = (weight * np.stack([kernels.signed_distance(m, clip, 1.0) / clip for m in side]) for side in a)
        f, losses = register(s, t, 5, iterations, 4.0, sigma=0.05)
        return pd.DataFrame({"v": [f.v.astype("<f8").tobytes()], "first": [losses[0]], "last": [losses[-1]]})

    return run


def align_structures(pts: DataFrame, target: DataFrame, shape: tuple[int, int], how: pairing.Scoring, rounds: int = 3, iterations: int = 40, clip: float = 25.0) -> tuple[DataFrame, DataFrame]:
    """Coarse to fine: pair, match the pairs' signed distances, carry the points, and pair again
    until a round brings no pair more. pts: id, cluster, x, y in pixels of the target raster;
    target: mask, iy, ix. Returns points with x_aligned, y_aligned and the last pairs.

    Masks, metrics and points are DataFrames; the matched channels (at most pairs_most rasters) go
    to one task a round, and its velocity to every task that carries points."""
    now = pts.withColumn("x_aligned", F.col("x").cast("double")).withColumn("y_aligned", F.col("y").cast("double"))
    best: list = []
    for _ in range(rounds):
        masks = cut(point_masks(now.select("cluster", F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y")), shape))
        pairs = pair_up(masks, target, shape, how).select("a", "b", "score").collect()  # at most pairs_most rows
        if len(pairs) <= len(best):
            break
        best = pairs
        want = pts.sparkSession.createDataFrame([(r["a"], r["b"], i) for i, r in enumerate(pairs)], "a string, b string, channel int")
        src = masks.join(F.broadcast(want.select(F.col("a").alias("mask"), "channel")), "mask").select("channel", "iy", "ix", F.lit(0).alias("side"))
        tgt = target.join(F.broadcast(want.select(F.col("b").alias("mask"), "channel")), "mask").select("channel", "iy", "ix", F.lit(1).alias("side"))

        row = src.unionByName(tgt).withColumn("g", F.lit(0)).groupBy("g").applyInPandas(_match(len(pairs), shape, clip, iterations), "v binary, first double, last double").first()
        v = np.frombuffer(row["v"]).reshape(5, 2, *shape)

        def carry(batches, v=v):
            for pdf in batches:
                y, x = flow(v, pdf["y_aligned"], pdf["x_aligned"])
                yield pdf.assign(x_aligned=x, y_aligned=y)

        now = cut(now.mapInPandas(carry, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in now.schema)))
    schema = "a string, b string, score double"
    return now, pts.sparkSession.createDataFrame(best, schema)


def align_atlas(pts: DataFrame, labels: DataFrame, names: DataFrame, shape: tuple[int, int], **how) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Align to an atlas slice (iy, ix, label) and read each point's label: points, pairs, labels."""
    target = labels.filter("label <> 0").select(F.col("label").cast("string").alias("mask"), "iy", "ix")
    out, pairs = align_structures(pts, target, shape, pairing.ATLAS, **how)
    read = raster.label_transfer(out.select("id", F.col("x_aligned").alias("x"), F.col("y_aligned").alias("y")), labels, names, shape[1], shape[0])
    return out, pairs, read


def align_histology(pts: DataFrame, structures: DataFrame, shape: tuple[int, int], **how) -> tuple[DataFrame, DataFrame]:
    return align_structures(pts, structures, shape, pairing.HISTOLOGY, **how)


def align_atac(pts: DataFrame, reference: DataFrame, shape: tuple[int, int], **how) -> tuple[DataFrame, DataFrame]:
    """ATAC points to the masks of a reference section's clusters."""
    return align_structures(pts, point_masks(reference, shape, 80), shape, pairing.ATAC, **how)
