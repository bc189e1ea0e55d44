"""Centroids, similarity registration, boxes and thinning of 2-D points (sample_id, cluster, x, y)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def centroids(pts: DataFrame, least: int = 1, by=("sample_id", "cluster")) -> DataFrame:
    return pts.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def shared_centroids(query: DataFrame, reference: DataFrame, least: int = 1) -> DataFrame:
    """Clusters of both point sets with both centroids: one row a cluster."""
    q = centroids(query, least, ("cluster",)).toDF("cluster", "qx", "qy", "qn")
    r = centroids(reference, least, ("cluster",)).toDF("cluster", "rx", "ry", "rn")
    return q.join(r, "cluster")


def procrustes(pairs: DataFrame, weight: Column | None = None, reflection: bool = False) -> DataFrame:
    """Closed-form weighted similarity from (qx, qy) to (rx, ry): one row scale, theta, tx, ty, n.

    With p, P the centred points, a = sum w (xX + yY) and b = sum w (xY - yX) give the rotation and
    sqrt(a^2 + b^2) / sum w |p|^2 the scale. With `reflection`, the mirrored solution is taken when
    its norm is larger; then y counts negative before the turn (mirror = -1)."""
    w = F.lit(1.0) if weight is None else weight
    rows = pairs.withColumn("w", w)
    c = rows.agg(*[(F.sum(F.col("w") * F.col(k)) / F.sum("w")).alias(f"m_{k}") for k in ("qx", "qy", "rx", "ry")], F.count(F.lit(1)).alias("n"))
    d = rows.join(F.broadcast(c))  # one row
    x, y, X, Y, w = F.col("qx") - F.col("m_qx"), F.col("qy") - F.col("m_qy"), F.col("rx") - F.col("m_rx"), F.col("ry") - F.col("m_ry"), F.col("w")
    s = d.groupBy("m_qx", "m_qy", "m_rx", "m_ry", "n").agg(F.sum(w * (x * X + y * Y)).alias("a"), F.sum(w * (x * Y - y * X)).alias("b"), F.sum(w * (x * X - y * Y)).alias("am"), F.sum(w * (x * Y + y * X)).alias("bm"), F.sum(w * (x * x + y * y)).alias("v"))
    mirrored = (F.hypot("am", "bm") > F.hypot("a", "b")) if reflection else F.lit(False)
    s = s.withColumn("mirror", F.when(mirrored, F.lit(-1.0)).otherwise(F.lit(1.0)))
    s = s.withColumn("pa", F.when(F.col("mirror") < 0, F.col("am")).otherwise(F.col("a"))).withColumn("pb", F.when(F.col("mirror") < 0, F.col("bm")).otherwise(F.col("b")))
    s = s.withColumn("scale", F.when(F.col("v") > 0, F.hypot("pa", "pb") / F.col("v")).otherwise(F.lit(1.0))).withColumn("theta", F.atan2("pb", "pa"))
    k, t, my = F.col("scale"), F.col("theta"), F.col("m_qy") * F.col("mirror")
    return s.select("scale", "theta", (F.col("m_rx") - k * (F.cos(t) * F.col("m_qx") - F.sin(t) * my)).alias("tx"), (F.col("m_ry") - k * (F.sin(t) * F.col("m_qx") + F.cos(t) * my)).alias("ty"), "mirror", "n")


def procrustes_by(pairs: DataFrame, by: list[str], weight: Column | None = None, reflection: bool = False) -> DataFrame:
    """`procrustes` for every group at once: by..., scale, theta, tx, ty, mirror, n, and the weighted
    root mean square distance of the pairs before (rmse_before) and after (rmse). Groups whose
    points are all in one place get the scale 1 and no turn."""
    rows = pairs.withColumn("w", F.lit(1.0) if weight is None else weight)
    m = rows.groupBy(*by).agg(*[(F.sum(F.col("w") * F.col(k)) / F.sum("w")).alias(f"m_{k}") for k in ("qx", "qy", "rx", "ry")], F.count(F.lit(1)).alias("n"))
    x, y, X, Y, w = F.col("qx") - F.col("m_qx"), F.col("qy") - F.col("m_qy"), F.col("rx") - F.col("m_rx"), F.col("ry") - F.col("m_ry"), F.col("w")
    dx, dy = F.col("qx") - F.col("rx"), F.col("qy") - F.col("ry")
    terms = {"a": x * X + y * Y, "b": x * Y - y * X, "am": x * X - y * Y, "bm": x * Y + y * X, "v": x * x + y * y, "gap": dx * dx + dy * dy}
    s = rows.join(m, by).groupBy(*by, "m_qx", "m_qy", "m_rx", "m_ry", "n").agg(*[F.sum(w * e).alias(k) for k, e in terms.items()], F.sum(w).alias("w"))
    mirrored = (F.hypot("am", "bm") > F.hypot("a", "b")) if reflection else F.lit(False)
    s = s.withColumn("mirror", F.when(mirrored, F.lit(-1.0)).otherwise(F.lit(1.0)))
    pa, pb = (F.when(F.col("mirror") < 0, F.col(f"{c}m")).otherwise(F.col(c)) for c in "ab")
    s = s.withColumn("norm", F.hypot(pa, pb)).withColumn("theta", F.atan2(pb, pa)).withColumn("scale", F.when(F.col("v") > 0, F.col("norm") / F.col("v")).otherwise(F.lit(1.0)))
    k, t, my = F.col("scale"), F.col("theta"), F.col("m_qy") * F.col("mirror")
    fit = s.select(*by, "scale", "theta", (F.col("m_rx") - k * (F.cos(t) * F.col("m_qx") - F.sin(t) * my)).alias("tx"), (F.col("m_ry") - k * (F.sin(t) * F.col("m_qx") + F.cos(t) * my)).alias("ty"), "mirror", "n", F.sqrt(F.col("gap") / F.col("w")).alias("rmse_before"))
    # the pairs are moved for what is left: the closed form of it would lose its digits
    qy = F.col("qy") * F.col("mirror")
    ex = F.col("scale") * (F.cos("theta") * F.col("qx") - F.sin("theta") * qy) + F.col("tx") - F.col("rx")
    ey = F.col("scale") * (F.sin("theta") * F.col("qx") + F.cos("theta") * qy) + F.col("ty") - F.col("ry")
    left = rows.join(fit, by).groupBy(*by).agg(F.sqrt(F.sum(F.col("w") * (ex * ex + ey * ey)) / F.sum("w")).alias("rmse"))
    return fit.join(left, by)


def transform(pts: DataFrame, how: DataFrame, x: str = "x_prealigned", y: str = "y_prealigned") -> DataFrame:
    """Apply a one-row similarity table to all points: no shuffle, columns added."""
    h = F.broadcast(how.select("scale", "theta", "tx", "ty", "mirror"))
    py = F.col("y") * F.col("mirror")
    c, s = F.cos("theta"), F.sin("theta")
    return pts.join(h).withColumn(x, F.col("scale") * (c * F.col("x") - s * py) + F.col("tx")).withColumn(y, F.col("scale") * (s * F.col("x") + c * py) + F.col("ty")).drop("scale", "theta", "tx", "ty", "mirror")


def typical_size(pts: DataFrame) -> DataFrame:
    """Median over samples of the number of finite points."""
    ok = pts.filter(~F.isnan("x") & ~F.isnan("y"))
    return ok.groupBy("sample_id").agg(F.count(F.lit(1)).alias("n")).agg(F.median("n").alias("n_typical"))


def shared_box(pts: DataFrame, dx: float, expand: float = 1.05) -> DataFrame:
    """Bounding box over all samples, grown about its centre, and the cells of side dx."""
    b = pts.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    g = lambda lo, hi, s: (F.col(lo) + F.col(hi)) / 2 + s * (F.col(hi) - F.col(lo)) / 2 * expand
    b = b.select(g("x0", "x1", -1).alias("x0"), g("x0", "x1", 1).alias("x1"), g("y0", "y1", -1).alias("y0"), g("y0", "y1", 1).alias("y1"))
    return b.withColumn("nx", F.ceil((F.col("x1") - F.col("x0")) / dx)).withColumn("ny", F.ceil((F.col("y1") - F.col("y0")) / dx))


def thin(pts: DataFrame, cell: float, order: list) -> DataFrame:
    """One point a cluster and grid cell, first in `order`."""
    w = Window.partitionBy("cluster", F.floor(F.col("x") / cell), F.floor(F.col("y") / cell)).orderBy(*order)
    return pts.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def half_crop(pts: DataFrame, axis: str = "x", quantile: float = 0.5, low: bool = True) -> DataFrame:
    """The half plane on one side of a quantile, both inclusive."""
    q = pts.agg(F.percentile(axis, F.lit(quantile)).alias("q"))
    keep = F.col(axis) <= F.col("q") if low else F.col(axis) >= F.col("q")
    return pts.join(F.broadcast(q)).filter(keep).drop("q")


def shape_pca(pts: DataFrame, by=("cluster",)) -> DataFrame:
    """Eigenvalues of the 2x2 covariance: elongation sqrt(l1 / l2), anisotropy (l1 - l2) / (l1 + l2)."""
    c = pts.groupBy(*by).agg(F.var_samp("x").alias("vx"), F.var_samp("y").alias("vy"), F.covar_samp("x", "y").alias("vxy"))
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.col("vxy") * F.col("vxy"))
    c = c.withColumn("l1", half + root).withColumn("l2", F.greatest(half - root, F.lit(0.0)))
    return c.select(*by, "l1", "l2", F.sqrt(F.col("l1") / F.greatest("l2", F.lit(1e-12))).alias("elongation"), ((F.col("l1") - F.col("l2")) / F.greatest(F.col("l1") + F.col("l2"), F.lit(1e-12))).alias("anisotropy"))


def quartile_box(pts: DataFrame, by=("cluster",)) -> DataFrame:
    """Inter-quartile width, height, aspect and area."""
    q = lambda c, p: F.percentile(c, F.lit(p))
    b = pts.groupBy(*by).agg((q("x", 0.75) - q("x", 0.25)).alias("width"), (q("y", 0.75) - q("y", 0.25)).alias("height"))
    return b.withColumn("aspect", F.col("width") / F.greatest("height", F.lit(1e-12))).withColumn("area", F.col("width") * F.col("height"))


def ellipse(pts: DataFrame, by=("sample_id",)) -> DataFrame:
    """Second-moment ellipse: centre, half axes (2 sqrt of eigenvalues) and angle."""
    c = pts.groupBy(*by).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    half, root = (F.col("vx") + F.col("vy")) / 2, F.sqrt(F.pow((F.col("vx") - F.col("vy")) / 2, 2) + F.col("vxy") * F.col("vxy"))
    return c.select(*by, "cx", "cy", (2 * F.sqrt(half + root)).alias("major"), (2 * F.sqrt(F.greatest(half - root, F.lit(0.0)))).alias("minor"), (0.5 * F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy"))).alias("angle"))


def iou_sweep(query: DataFrame, reference: DataFrame, cell: float, step: float, scales=(0.9, 0.95, 1.0, 1.05, 1.1), grain: int | None = None) -> DataFrame:
    """IoU of occupied cells for each rotation and scale of the query about its own mean, moved to
    the reference's mean: angle, scale, iou. Places that repeat are turned once; with `grain`, points
    are first put in the middle of cells that many times finer, so what is turned is bounded by the
    query's area and not by its points."""
    n = round(360 / step)
    spark = query.sparkSession
    cand = spark.range(n).select((F.col("id") * step).alias("angle")).withColumn("scale", F.explode(F.array(*map(F.lit, scales))))
    qm = query.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    rm = reference.agg(F.avg("x").alias("rx"), F.avg("y").alias("ry"))
    places = query.select("x", "y") if grain is None else query.select(*[((F.floor(F.col(c) * grain / cell) + 0.5) * cell / grain).alias(c) for c in ("x", "y")])
    cells = places.distinct().join(F.broadcast(qm)).join(F.broadcast(rm)).join(F.broadcast(cand))
    t = F.radians("angle")
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    px = F.floor((F.col("scale") * (F.cos(t) * x - F.sin(t) * y) + F.col("rx")) / cell)
    py = F.floor((F.col("scale") * (F.sin(t) * x + F.cos(t) * y) + F.col("ry")) / cell)
    moved = cells.select("angle", "scale", px.alias("px"), py.alias("py")).distinct()
    there = reference.select(F.floor(F.col("x") / cell).alias("px"), F.floor(F.col("y") / cell).alias("py")).distinct().withColumn("hit", F.lit(1))
    size = there.agg(F.count(F.lit(1)).alias("nr"))
    hit = moved.join(there, ["px", "py"], "left").groupBy("angle", "scale").agg(F.count(F.lit(1)).alias("nq"), F.count("hit").alias("both"))
    return hit.join(F.broadcast(size)).select("angle", "scale", (F.col("both") / (F.col("nq") + F.col("nr") - F.col("both"))).alias("iou"))


def grid_resolution(raw: int, typical: float, occupancy: float, bounds=(1.0, 2.0), explicit: int | None = None) -> tuple[int, str]:
    """Grid points a side so that points inside tissue (n * n * occupancy) lie within the bounds
    times the typical sample size; an explicit number wins."""
    if explicit is not None:
        return explicit, "explicit"
    low, high = (b * typical / max(occupancy, 1e-12) for b in bounds)
    if low <= raw * raw <= high:
        return raw, "r_driven"
    aim, rule = (low, "lower_bound") if raw * raw < low else (high, "upper_bound")
    n = max(2, round(math.sqrt(aim)))
    best = min((m for m in (n - 1, n, n + 1) if m >= 2), key=lambda m: (abs(m * m - aim), m))
    return best, rule


def map_radius(spacing: float, configured: float | None = None, multiplier: float = 1.5) -> float:
    if configured is not None:
        if configured <= 0:
            raise ValueError("a radius must be over 0")
        return configured
    return multiplier * spacing


def search_similarity(query: DataFrame, reference: DataFrame, cell: float, steps=(30.0, 5.0, 1.0)) -> tuple[float, float, float]:
    """Turn and scale of the query about its mean that overlap the reference's occupied cells best:
    a coarse sweep of all angles, then finer ones about the best. Returns angle, scale, IoU."""
    angle, scale, best = 0.0, 1.0, -1.0
    for i, step in enumerate(steps):
        turned = rotate(query, angle) if i else query
        rows = iou_sweep(turned, reference, cell, step, (scale * 0.95, scale, scale * 1.05), grain=4)
        if i:  # only angles about the best so far
            near = 2 * steps[i - 1]
            rows = rows.filter((F.col("angle") <= near) | (F.col("angle") >= 360 - near))
        r = rows.orderBy(F.desc("iou"), "angle", "scale").first()
        if r["iou"] > best:
            best, scale, angle = r["iou"], r["scale"], (angle + r["angle"]) % 360
    return angle, scale, best


def rotate(pts: DataFrame, angle: float) -> DataFrame:
    """Turn points about their mean by degrees."""
    m = pts.agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    c, s = math.cos(math.radians(angle)), math.sin(math.radians(angle))
    x, y = F.col("x") - F.col("mx"), F.col("y") - F.col("my")
    return pts.join(F.broadcast(m)).withColumn("x2", c * x - s * y + F.col("mx")).withColumn("y2", s * x + c * y + F.col("my")).drop("x", "y", "mx", "my").withColumnsRenamed({"x2": "x", "y2": "y"})
