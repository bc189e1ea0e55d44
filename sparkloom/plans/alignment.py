"""Cross-sample alignment: similarity by shared centroids, then diffeomorphic refinement."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registration import Field, descend, flow, mismatch
from ..operators import contracts, geometry, neighbours, raster
from ..storage import cut


@dataclass(frozen=True)
class Config:
    """Raster, blur and matching. `spacing` is the side of a raster cell in the points' units, as many cells as their
    extent takes; `cells`, where given, is a fixed number of cells a side instead. `iterations` is the most that a
    matching takes; it ends before where steps hardly lower the loss. `sigma` and `smoothness` are in cells."""

    spacing: float = 30.0
    cells: int | None = None
    sigma: float = 1.5
    steps: int = 5
    iterations: int = 500
    smoothness: float = 3.0
    match_sigma: float = 0.02
    expand: float = 1.1


def prealign(pts: DataFrame, query: str, reference: str, manual: tuple[float, float, float, float] | None = None) -> DataFrame:
    """Points with x_prealigned, y_prealigned: the query by the similarity of shared centroids (or a
    given scale, theta, tx, ty), the reference unchanged. At least two shared clusters."""
    q, r = pts.filter(F.col("sample_id") == query), pts.filter(F.col("sample_id") == reference)
    if manual is not None:
        fit = pts.sparkSession.createDataFrame([(*map(float, manual), 1.0)], "scale double, theta double, tx double, ty double, mirror double")
    else:
        shared = cut(geometry.shared_centroids(q, r))
        if shared.limit(2).count() < 2:
            raise ValueError("fewer than two shared clusters")
        fit = cut(geometry.procrustes(shared))
    return geometry.transform(q, fit).unionByName(r.withColumn("x_prealigned", F.col("x")).withColumn("y_prealigned", F.col("y")))


def rasters(pixels: DataFrame, n: int) -> DataFrame:
    """Pixels (side, channel, iy, ix, v) as channel, query, reference: a row a channel that both sides have, with its
    two rasters of n x n doubles, and a file a row, so that tasks share the channels."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["side"].nunique() < 2:
            return pd.DataFrame()
        a = np.zeros((2, n, n))
        a[(pdf["side"] == "reference").to_numpy(int), pdf["iy"].to_numpy(), pdf["ix"].to_numpy()] = pdf["v"].to_numpy()
        q, r = (side.astype("<f8").tobytes() for side in a)
        return pd.DataFrame({"channel": [pdf["channel"].iloc[0]], "query": [q], "reference": [r]})

    rows = cut(pixels.groupBy("channel").applyInPandas(run, "channel string, query binary, reference binary"))
    return cut(rows.repartitionByRange(max(rows.count(), 1), "channel"))


def match(fields: DataFrame, n: int, config: Config) -> tuple[np.ndarray, list[float]]:
    """The velocities (steps, 2, n, n) that carry the query's channels to the reference's, and the loss by iteration.

    A step is a job: tasks take the map that the velocities make, add up mismatch and pull over their channels, and a
    second stage adds these up. The driver holds the velocities of the last steps, which the raster bounds."""
    sc = fields.sparkSession.sparkContext

    def look(end: np.ndarray) -> tuple[float, np.ndarray]:
        sent = sc.broadcast(end)

        def share(batches):
            total, pulled, first = 0.0, np.zeros((2, n, n)), None
            for pdf in batches:
                for name, *pair in zip(pdf["channel"], pdf["query"], pdf["reference"]):
                    q, r = (np.frombuffer(side, "<f8").reshape(1, n, n) for side in pair)
                    off, pull = mismatch(q, r, sent.value, config.match_sigma)
                    total, pulled, first = total + off, pulled + pull, first or name
            if first is not None:
                yield pd.DataFrame({"axis": [0, 1], "first": first, "off": [total, 0.0], "pull": [p.astype("<f8").tobytes() for p in pulled]})

        def add(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("first")  # sums in one order, whatever comes first
            p = sum(np.frombuffer(x, "<f8") for x in pdf["pull"])
            return pd.DataFrame({"axis": [pdf["axis"].iloc[0]], "off": [pdf["off"].sum()], "pull": [p.astype("<f8").tobytes()]})

        parts = fields.mapInPandas(share, "axis int, first string, off double, pull binary").repartition(2, "axis")
        rows = sorted(parts.groupBy("axis").applyInPandas(add, "axis int, off double, pull binary").collect(), key=lambda r: r["axis"])
        sent.destroy()
        return sum(r["off"] for r in rows), np.stack([np.frombuffer(r["pull"], "<f8").reshape(n, n) for r in rows])

    f = Field((n, n), config.steps, config.smoothness)
    losses = descend(f, look, config.iterations)
    return f.v, losses


def move(pts: DataFrame, query: str, reference: str, config: Config = Config(), manual=None) -> DataFrame:
    """Aligned points (x_aligned, y_aligned; reference rows unchanged). pts: sample_id, cluster, x, y and more.

    Points are materialised once and aggregated to pixels in Spark; channels are matched by all tasks; the velocities
    are applied to the query's points as they stream."""
    pts = cut(pts)
    contracts.check_points(pts, query, reference)
    pre = prealign(pts, query, reference, manual)
    box = geometry.shared_box(pre.select(F.col("x_prealigned").alias("x"), F.col("y_prealigned").alias("y")), 1.0, config.expand).first()
    side = max(box["x1"] - box["x0"], box["y1"] - box["y0"])
    n = config.cells or max(2, math.ceil(side / config.spacing))
    x0, y0, dx = box["x0"], box["y0"], side / n if config.cells else config.spacing
    sides = []
    for name, sample in (("query", query), ("reference", reference)):
        p = pre.filter(F.col("sample_id") == sample).select("cluster", F.col("x_prealigned").alias("x"), F.col("y_prealigned").alias("y"))
        pixels = cut(raster.blur(cut(raster.histogram(p, x0, y0, dx, n, n).withColumn("v", F.col("v").cast("double"))), config.sigma, n, n))
        sides.append(raster.channels(pixels).withColumn("side", F.lit(name)))
    v, _ = match(rasters(sides[0].unionByName(sides[1]), n), n, config)

    def carry(batches):
        for pdf in batches:
            y, x = flow(v, (pdf["y_prealigned"] - y0) / dx - 0.5, (pdf["x_prealigned"] - x0) / dx - 0.5)
            yield pdf.assign(x_aligned=(x + 0.5) * dx + x0, y_aligned=(y + 0.5) * dx + y0)

    moved = pre.filter(F.col("sample_id") == query).mapInPandas(carry, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pre.schema) + ", x_aligned double, y_aligned double")
    still = pre.filter(F.col("sample_id") == reference)
    return moved.unionByName(still.withColumn("x_aligned", F.col("x_prealigned")).withColumn("y_aligned", F.col("y_prealigned")))


def align(pts: DataFrame, query: str, reference: str, config: Config = Config(), manual=None) -> tuple[DataFrame, DataFrame]:
    """The points of `move`, and the 1-NN agreement before and after, which joins all points of both
    samples at three stages."""
    out = cut(move(pts, query, reference, config, manual))
    ref = out.filter(F.col("sample_id") == reference).select("id", "x", "y", "cluster")
    stage = lambda name, x, y: neighbours.agreement(out.filter(F.col("sample_id") == query).select("id", F.col(x).alias("x"), F.col(y).alias("y"), "cluster"), ref).withColumn("stage", F.lit(name))
    return out, stage("before", "x", "y").unionByName(stage("prealigned", "x_prealigned", "y_prealigned")).unionByName(stage("aligned", "x_aligned", "y_aligned"))
