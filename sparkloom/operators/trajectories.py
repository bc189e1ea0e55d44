"""Clusters of curves over ordered contrasts: features, smoothing on the grid graph, all numbers of
clusters and all starts in the same passes, and a choice of the number by silhouettes."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .clustering import _distances, _matrix, _seeds, _sums, nearest_centres


def curve_features(curves: DataFrame, level_weight: float = 1.0, shape_weight: float = 1.0) -> DataFrame:
    """id and v of curves (id, ord, value): the z-scored level, and the course about it, scaled to the
    length of one (flat curves: zeros), with a place for every ord. A missing value counts as the
    curve's level. Curves without a value are left out. Ords are few: a curve is one array."""
    rows = curves.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    level = rows.groupBy("id").agg(F.avg("value").alias("level"))
    scale = level.agg(F.avg("level").alias("m"), F.stddev_pop("level").alias("s"))
    ords = sorted(r[0] for r in rows.select("ord").distinct().collect())  # one row a contrast
    held = rows.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("ord", "value"))).alias("at")).join(level, "id").join(F.broadcast(scale))
    course = F.array(*[F.coalesce(F.try_element_at("at", F.lit(o)) - F.col("level"), F.lit(0.0)) for o in ords])
    norm = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, x: s + x * x))
    held = held.withColumn("c", course).withColumn("n", norm)
    z = F.when(F.col("s") > 1e-12, (F.col("level") - F.col("m")) / F.col("s")).otherwise(F.lit(0.0))
    shape = F.transform("c", lambda x: F.when(F.col("n") > 1e-12, shape_weight * x / F.col("n")).otherwise(F.lit(0.0)))
    return held.select("id", F.concat(F.array(z * level_weight), shape).alias("v"))


def smooth_features(vectors: DataFrame, edges: DataFrame, own: float = 0.5) -> DataFrame:
    """Each vector mixed with the weighted mean of its neighbours': own * v + (1 - own) * mean. edges:
    directed qid, nid, w. Vectors without neighbours stay. Neighbours are summed place by place, so
    no task gathers a neighbourhood."""
    near = edges.filter("qid <> nid").join(vectors.select(F.col("id").alias("nid"), F.posexplode("v").alias("k", "x")), "nid")
    mean = near.groupBy("qid", "k").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("x"))
    mean = mean.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda e: e["x"]).alias("near"))
    mixed = F.zip_with("v", "near", lambda a, b: own * a + (1 - own) * b)
    return vectors.join(mean.withColumnRenamed("qid", "id"), "id", "left").select("id", F.when(F.col("near").isNull(), F.col("v")).otherwise(mixed).alias("v"))


def silhouettes(vectors: DataFrame, labels: list[np.ndarray]) -> np.ndarray:
    """Mean silhouette (squared Euclidean) of the nearest-centre labels of several sets of centres, in
    two passes: a cluster's size, sum and sum of squares give the mean distance to its members."""
    p = labels[0].shape[1]

    def gather(pdf: pd.DataFrame) -> np.ndarray:
        x, parts = _matrix(pdf["v"]), []
        for c in labels:
            out = np.zeros((len(c), p + 2))
            np.add.at(out, _distances(x, c).argmin(1), np.column_stack([np.ones(len(x)), x, (x * x).sum(1)]))
            parts.append(out.ravel())
        return np.concatenate(parts)

    sums, stats, at = _sums(vectors.select("v"), gather, sum(len(c) for c in labels) * (p + 2)), [], 0
    for c in labels:
        stats.append(sums[at : at + len(c) * (p + 2)].reshape(len(c), p + 2))
        at += len(c) * (p + 2)

    def score(pdf: pd.DataFrame) -> np.ndarray:
        x, out = _matrix(pdf["v"]), [float(len(pdf))]
        for c, s in zip(labels, stats):
            own, n = _distances(x, c).argmin(1), s[:, 0]
            # sum over members of |x - y|^2
            total = n * (x * x).sum(1)[:, None] - 2 * x @ s[:, 1 : p + 1].T + s[:, p + 1]
            rows = np.arange(len(x))
            with np.errstate(divide="ignore", invalid="ignore"):
                a = np.maximum(total[rows, own], 0) / (n[own] - 1)
                b = np.where(n > 0, np.maximum(total, 0) / n, np.inf)
            b[rows, own] = np.inf
            b = b.min(1)
            with np.errstate(invalid="ignore"):
                one = np.where((n[own] > 1) & np.isfinite(b) & (np.maximum(a, b) > 0), (b - a) / np.maximum(a, b), 0.0)
            out.append(np.nan_to_num(one).sum())
        return np.array(out)

    got = _sums(vectors.select("v"), score, 1 + len(labels))
    return got[1:] / max(got[0], 1)


class Sweep(NamedTuple):
    """labels: id, label of the chosen number; table: k, within, silhouette, smallest (share of the
    smallest cluster); k: the chosen number; centres."""

    labels: DataFrame
    table: pd.DataFrame
    k: int
    centres: np.ndarray


def sweep(vectors: DataFrame, ks: list[int], starts: int = 4, iterations: int = 60, seed: int = 7, near_best: float = 0.97, least_share: float = 0.0) -> Sweep:
    """k-means for every k of ks and several starts, all as parts of the same passes over the rows;
    chosen is the smallest k whose silhouette is at least near_best of the highest, among those whose
    smallest cluster has least_share of the rows. A start's first k picks seed its run for k."""
    rows = cut(vectors.select(F.xxhash64("id").alias("h"), "id", "v", F.lit(1.0).alias("weight")))
    seeds = _seeds(rows.drop("id"), max(ks), seed, starts)
    if not seeds:
        raise ValueError("no rows to cluster")
    runs = [(k, s[:k].copy()) for k in ks for s in seeds if len(s) >= k]
    if not runs:
        raise ValueError(f"fewer than {min(ks)} different rows")
    p, moving = seeds[0].shape[1], list(range(len(runs)))
    for _ in range(iterations):

        def step(pdf: pd.DataFrame, cs=tuple(runs[i][1] for i in moving)) -> np.ndarray:
            x, parts = _matrix(pdf["v"]), []
            for c in cs:
                out = np.zeros((len(c), p + 1))
                np.add.at(out, _distances(x, c).argmin(1), np.column_stack([np.ones(len(x)), x]))
                parts.append(out.ravel())
            return np.concatenate(parts)

        sums, at, still = _sums(rows.select("v"), step, sum(len(runs[i][1]) for i in moving) * (p + 1)).reshape(-1, p + 1), 0, []
        for i in moving:
            k, c = runs[i]
            s = sums[at : at + k]
            at += k
            new = np.where(s[:, :1] > 0, s[:, 1:] / np.maximum(s[:, :1], 1e-300), c)
            if np.abs(new - c).max() >= 1e-9:
                still.append(i)
            runs[i] = k, new
        moving = still
        if not moving:
            break

    def within(pdf: pd.DataFrame) -> np.ndarray:
        x, out = _matrix(pdf["v"]), []
        for k, c in runs:
            d = _distances(x, c)
            out += [d.min(1).sum(), *np.bincount(d.argmin(1), minlength=k)]
        return np.array(out)

    got, at, best = _sums(rows.select("v"), within, sum(k + 1 for k, _ in runs)), 0, {}
    for k, c in runs:
        total, sizes = got[at], got[at + 1 : at + 1 + k]
        at += k + 1
        if k not in best or total < best[k][0]:
            best[k] = total, c, sizes.min() / max(sizes.sum(), 1)
    order = sorted(best)
    table = pd.DataFrame({"k": order, "within": [best[k][0] for k in order], "silhouette": silhouettes(rows, [best[k][1] for k in order]), "smallest": [best[k][2] for k in order]})
    fit = table[table["smallest"] >= least_share]
    fit = fit if len(fit) else table
    top = fit["silhouette"].max()
    k = int(fit["k"][fit["silhouette"] >= (near_best * top if top > 0 else top)].min())
    return Sweep(nearest_centres(vectors, best[k][1]), table, k, best[k][1])


def trajectory_clusters(curves: DataFrame, edges: DataFrame | None, ks: list[int], level_weight: float = 1.0, own: float = 0.5, **how) -> Sweep:
    """Clusters of curves (id, ord, value), such as the adjusted effects of grid cells: features,
    smoothed over the grid graph (edges qid, nid, w) if there is one, and the sweep over ks."""
    v = curve_features(curves, level_weight)
    return sweep(cut(smooth_features(v, edges, own) if edges is not None else v), ks, **how)
