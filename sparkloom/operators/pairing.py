"""Pairing of structures: a metric bundle for mask pairs, scores with gates, greedy selections."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels
from ..functions.columns import composite, distance_gate, gate_factor
from ..storage import cut
from .raster import overlaps


@dataclass(frozen=True)
class Scoring:
    """Weights of the score and what a pair must reach."""

    sdf: float
    chamfer: float
    dice: float
    area: float
    thickness: float
    score_least: float
    asd_most: float
    d0: float
    dice_least: float = 0.0
    pairs_most: int = 30
    intersection_least: int = 20
    gates: bool = False
    distance_gated: bool = False


#: The three kinds of target.
ATLAS = Scoring(0.08, 0.06, 0.18, 0.47, 0.21, 0.50, 50.0, 25.0, gates=True)
HISTOLOGY = Scoring(0.20, 0.40, 0.15, 0.25, 0.00, 0.40, 30.0, 30.0)
ATAC = Scoring(0.35, 0.25, 0.10, 0.30, 0.00, 0.25, float("inf"), 30.0, dice_least=0.01, pairs_most=20, intersection_least=1, distance_gated=True)


def with_weights(how: Scoring, **weights: float) -> Scoring:
    """A scoring with the user's own weights (sdf, chamfer, dice, area, thickness); those not named
    stay. None may be under 0, and all must add up to 1."""
    names = ("sdf", "chamfer", "dice", "area", "thickness")
    if unknown := set(weights) - set(names):
        raise ValueError(f"no such weights: {sorted(unknown)}")
    out = replace(how, **{k: float(v) for k, v in weights.items()})
    values = [getattr(out, n) for n in names]
    if min(values) < 0 or not np.isfinite(values).all():
        raise ValueError("weights must be finite and at least 0")
    if abs(sum(values) - 1) > 1e-6:
        raise ValueError(f"weights must sum to 1.0, not {sum(values):g}")
    return out


def bundle(a: np.ndarray, b: np.ndarray, d0: float, eight: bool = True) -> dict[str, float]:
    """All shape metrics of two masks on one raster."""
    both, na, nb = int((a & b).sum()), int(a.sum()), int(b.sum())
    out = {"dice": 2 * both / (na + nb) if na + nb else 0.0, "iou": both / (na + nb - both) if na + nb else 0.0, "area_sim": float(np.exp(-abs(np.log(na / nb)))) if na and nb else 0.0}
    foot = kernels.footprint("box" if eight else "disk", 1)
    ea, eb = a & ~kernels.erode(a, foot), b & ~kernels.erode(b, foot)
    if ea.any() and eb.any():
        to_b, to_a = kernels.distance(~eb)[ea], kernels.distance(~ea)[eb]
        pooled = np.concatenate([to_a, to_b])
        chamfer = float((to_a.mean() + to_b.mean()) / 2)
        out |= {"chamfer": chamfer, "chamfer_sim": float(np.exp(-chamfer / d0)), "asd": float(pooled.mean()), "hd": float(pooled.max())}
    else:
        out |= {"chamfer": np.inf, "chamfer_sim": 0.0, "asd": np.inf, "hd": np.inf}
    ta, tb = kernels.thickness(a), kernels.thickness(b)
    perimeter = max(int(ea.sum()), 1)
    return out | {"sdf_corr": kernels.sdf_correlation(a, b), "thickness_sim": min(ta, tb) / max(ta, tb, 1e-12), "circularity": 4 * np.pi * na / perimeter**2}


METRICS = ["dice", "iou", "area_sim", "chamfer", "chamfer_sim", "asd", "hd", "sdf_corr", "thickness_sim", "circularity"]


def measure(a: DataFrame, b: DataFrame, shape: tuple[int, int], d0: float, least: int = 20) -> DataFrame:
    """Metrics of all pairs of masks that share `least` pixels; a pair is a task's group, its pixels
    the two masks (bounded by the raster)."""
    pairs = overlaps(a, b, least).select("a", "b")
    pa = pairs.join(a.withColumnRenamed("mask", "a"), "a").withColumn("side", F.lit("a"))
    pb = pairs.join(b.withColumnRenamed("mask", "b"), "b").withColumn("side", F.lit("b"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        masks = {}
        for side in "ab":
            masks[side] = np.zeros(shape, bool)
            s = pdf[pdf["side"] == side]
            masks[side][s["iy"], s["ix"]] = True
        return pd.DataFrame([{"a": pdf["a"].iloc[0], "b": pdf["b"].iloc[0]} | bundle(masks["a"], masks["b"], d0)])

    return pa.unionByName(pb).groupBy("a", "b").applyInPandas(run, "a string, b string, " + ", ".join(f"{m} double" for m in METRICS))


def score(metrics: DataFrame, how: Scoring) -> DataFrame:
    """Add score; keep pairs that reach the limits."""
    base: Column = composite([(how.sdf, F.col("sdf_corr")), (how.chamfer, F.col("chamfer_sim")), (how.dice, F.col("dice")), (how.area, F.col("area_sim")), (how.thickness, F.col("thickness_sim"))])
    if how.gates:
        low = lambda c, soft, power=1.0: (F.col(c) < soft, F.pow(F.col(c) / soft, F.lit(power)))
        base = base * gate_factor([low("dice", 0.25), low("sdf_corr", 0.55), (F.col("asd") > 50, 50 / F.col("asd")), low("thickness_sim", 0.65, 1.2)])
    if how.distance_gated:
        base = distance_gate(base, F.col("chamfer"))
    return metrics.withColumn("score", base).filter((F.col("score") >= how.score_least) & (F.col("asd") <= how.asd_most) & (F.col("dice") >= how.dice_least))


def disjoint_sets(scores: DataFrame) -> DataFrame:
    """Greedy by score: one candidate a cluster, candidates' label sets disjoint. scores: cluster,
    candidate, labels (array), score; ties by cluster, then candidate. In a round every row that is
    the best of its cluster and of all its labels is taken, and what shares a cluster or a label with
    it goes: what is taken is what one row at a time would take, and no task sees all rows."""
    left = cut(scores.select("cluster", "candidate", "labels", "score").withColumn("id", F.monotonically_increasing_id()))
    key = F.struct((-F.col("score")).alias("s"), "cluster", "candidate", "id")
    claim = F.concat(F.array(F.struct(F.lit("c").alias("kind"), F.col("cluster").cast("string").alias("what"))), F.transform(F.array_distinct("labels"), lambda x: F.struct(F.lit("l").alias("kind"), x.cast("string").alias("what"))))
    out = None
    while not left.isEmpty():
        claims = cut(left.select("id", key.alias("k"), F.explode(claim).alias("on")))
        first = claims.groupBy("on").agg(F.min("k").alias("k"))
        best = claims.join(first.withColumnRenamed("k", "first"), "on").groupBy("id").agg(F.bool_and(F.col("k.id") == F.col("first.id")).alias("ok")).filter("ok").select("id")
        taken = cut(left.join(best, "id", "left_semi"))
        out = taken if out is None else out.unionByName(taken)
        held = claims.join(best, "id", "left_semi").select("on").distinct()
        clash = claims.join(held, "on", "left_semi").select("id").distinct()
        left = cut(left.join(clash, "id", "left_anti"))
    return (left if out is None else out).select("cluster", "candidate", "labels", "score")


def layers_then_rest(scores: DataFrame, layer: Column) -> DataFrame:
    """Layers are chosen first and lock their clusters and labels; then the rest."""
    rows = scores.withColumn("is_layer", layer)
    first = disjoint_sets(rows.filter("is_layer"))
    taken = first.select(F.explode("labels").alias("l")).distinct()
    rest = rows.filter(~F.col("is_layer")).join(first.select("cluster"), "cluster", "left_anti")
    clash = rest.select("cluster", "candidate", F.explode("labels").alias("l")).join(taken, "l").select("cluster", "candidate").distinct()
    return first.unionByName(disjoint_sets(rest.join(clash, ["cluster", "candidate"], "left_anti")))


def cluster_labels(pairs: DataFrame) -> DataFrame:
    """Per cluster the union of its labels and its best score. pairs: cluster, labels, score."""
    return pairs.groupBy("cluster").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("labels")))).alias("labels"), F.max("score").alias("score"))
