"""Tissue outlines with holes from occupied cells, points inside them, and kernel mass within them.

An outline is a table of directed edges (by..., x1, y1, x2, y2) with the tissue on their left, so outer
rings turn left and holes right. Points and kernels meet edges by buckets of y: what decides about a
point are the edges that its horizontal line crosses, never the whole outline."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

from ..functions.special import normal_cdf
from ..storage import cut
from .communities import components

#: A kernel is taken to end at so many bandwidths: its mass beyond is under 1e-8.
REACH = 6.0


def boundary(cells: DataFrame, by: tuple[str, ...] = (), x0: float = 0.0, y0: float = 0.0, side: float = 1.0) -> DataFrame:
    """Edges between cells (by..., iy, ix) that are tissue and those that are not: each cell gives its
    four sides, and sides of two cells go. Cell (0, 0) has its lower corner at x0, y0."""
    x, y = F.col("ix"), F.col("iy")
    sides = [("h", x, y, 1), ("h", x, y + 1, -1), ("v", x, y, -1), ("v", x + 1, y, 1)]  # which, place, along or against it
    side_ = F.explode(F.array(*[F.struct(F.lit(o).alias("__o"), a.cast("long").alias("__a"), b.cast("long").alias("__b"), F.lit(d).alias("__d")) for o, a, b, d in sides]))
    rows = cells.select(*by, "iy", "ix").distinct().select(*by, side_.alias("__side")).select(*by, "__side.*")
    rows = rows.groupBy(*by, "__o", "__a", "__b").agg(F.count(F.lit(1)).alias("__n"), F.sum("__d").alias("__d")).filter("__n = 1")
    a, b, along = F.col("__a"), F.col("__b"), F.col("__d") > 0
    far_x, far_y = a + (F.col("__o") == "h").cast("int"), b + (F.col("__o") == "v").cast("int")
    put = lambda near, far, o: (F.when(along, near).otherwise(far) * side + o).cast("double")
    return rows.select(*by, put(a, far_x, x0).alias("x1"), put(b, far_y, y0).alias("y1"), put(far_x, a, x0).alias("x2"), put(far_y, b, y0).alias("y2"))


def rings(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The edges as closed rings: by..., ring, pos (0, 1, ... along it), x, y (where the edge begins).
    Edges are joined head to tail; where two rings touch the sharpest turn to the left is taken, so
    that each stays around its own cells. Places along a ring are found by following pointers twice
    as far in each step."""
    e = cut(edges.select(*by, "x1", "y1", "x2", "y2").withColumn("id", F.monotonically_increasing_id()))
    nxt = e.select(*by, F.col("x1").alias("x2"), F.col("y1").alias("y2"), F.col("x2").alias("x3"), F.col("y2").alias("y3"), F.col("id").alias("next"))
    ax, ay, bx, by_ = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("x3") - F.col("x2"), F.col("y3") - F.col("y2")
    turn = F.atan2(ax * by_ - ay * bx, ax * bx + ay * by_)
    after = cut(e.join(nxt, [*by, "x2", "y2"]).groupBy("id").agg(F.max(F.struct(turn.alias("t"), "next")).alias("m")).select("id", F.col("m.next").alias("next")))
    ring = cut(components(after.select(F.col("id").alias("i"), F.col("next").alias("j"))).withColumnRenamed("label", "ring"))
    # the way from each edge to the last one of its ring, whose next is the ring's first
    way = cut(after.join(ring, "id").select("id", "ring", F.when(F.col("next") != F.col("ring"), F.col("next")).alias("to"), F.when(F.col("next") != F.col("ring"), 1).otherwise(0).cast("long").alias("n")))
    while not way.filter("to IS NOT NULL").isEmpty():
        ahead = way.select(F.col("id").alias("to"), F.col("to").alias("to2"), F.col("n").alias("n2"))
        way = cut(way.join(ahead, "to", "left").select("id", "ring", F.col("to2").alias("to"), (F.col("n") + F.coalesce("n2", F.lit(0))).alias("n")))
    size = way.groupBy("ring").agg(F.max("n").alias("last"))
    return e.join(way.join(size, "ring"), "id").select(*by, "ring", (F.col("last") - F.col("n")).alias("pos"), F.col("x1").alias("x"), F.col("y1").alias("y"))


def ring_areas(ring: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., ring, n, area (signed: over 0 outer, under 0 a hole) and hole."""
    w = Window.partitionBy(*by, "ring").orderBy("pos")
    nx, ny = (F.coalesce(F.lead(c).over(w), F.first(c).over(w)) for c in ("x", "y"))
    steps = ring.select(*by, "ring", (F.col("x") * ny - nx * F.col("y")).alias("c"))
    out = steps.groupBy(*by, "ring").agg(F.count(F.lit(1)).alias("n"), (F.sum("c") / 2).alias("area"))
    return out.withColumn("hole", F.col("area") < 0)


def _band(edges: DataFrame, width: float) -> DataFrame:
    """Edges that are not level, once for each bucket of y that they reach into."""
    lo, hi = F.floor(F.least("y1", "y2") / width), F.floor(F.greatest("y1", "y2") / width)
    return edges.filter("y1 <> y2").withColumn("first", lo).withColumn("bucket", F.explode(F.sequence(lo, hi)))


def _height(edges: DataFrame) -> float:
    return edges.filter("y1 <> y2").agg(F.avg(F.abs(F.col("y2") - F.col("y1")))).first()[0] or 1.0


def crossings(points: DataFrame, edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., id, n (edges that the line from a point to the right crosses) and inside (n is odd), a
    row a point. An edge takes in its lower end and not its upper one."""
    width = _height(edges)
    p = points.select(*by, "id", "x", "y").withColumn("bucket", F.floor(F.col("y") / width))
    met = p.join(_band(edges, width), [*by, "bucket"], "left")
    over = (F.col("y1") <= F.col("y")) != (F.col("y2") <= F.col("y"))
    at = F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1"))
    n = F.count_if(F.coalesce(over & (F.col("x") < at), F.lit(False)))
    return met.groupBy(*by, "id").agg(n.alias("n")).withColumn("inside", F.col("n") % 2 == 1)


def upright(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Upright edges that follow each other in one line joined to one: all that crossings and mass
    need of an outline of cells, which has no slanted ones."""
    rows = edges.filter("x1 = x2").withColumn("up", F.col("y2") > F.col("y1")).withColumn("lo", F.least("y1", "y2")).withColumn("hi", F.greatest("y1", "y2"))
    w = Window.partitionBy(*by, "x1", "up").orderBy("lo")
    new = F.coalesce(F.col("lo") > F.lag("hi").over(w) + 1e-9, F.lit(True)).cast("int")
    runs = rows.withColumn("new", new).withColumn("run", F.sum("new").over(w)).groupBy(*by, "x1", "up", "run").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    return runs.select(*by, "x1", F.when(F.col("up"), F.col("lo")).otherwise(F.col("hi")).alias("y1"), F.col("x1").alias("x2"), F.when(F.col("up"), F.col("hi")).otherwise(F.col("lo")).alias("y2"))


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(16)


@pandas_udf(DoubleType())
def _edge_mass(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
    """The integral of Phi(x) phi(y) dy along edges, in bandwidths from the kernel's centre: in closed
    form along upright ones, by 16 points along others."""
    a, b, c, d = (v.to_numpy(float) for v in (x1, y1, x2, y2))
    out = normal_cdf(a) * (normal_cdf(d) - normal_cdf(b))
    slant = a != c
    if slant.any():
        t = (_NODES + 1) / 2
        x = a[slant, None] + t * (c - a)[slant, None]
        y = b[slant, None] + t * (d - b)[slant, None]
        out[slant] = (normal_cdf(x) * np.exp(-y * y / 2) * _WEIGHTS).sum(1) / math.sqrt(2 * math.pi) * (d - b)[slant] / 2
    return pd.Series(out)


def mass(queries: DataFrame, edges: DataFrame, h: float, by: tuple[str, ...] = ()) -> DataFrame:
    """by..., id and mass: how much of a round Gaussian of bandwidth h at each query (by..., id, x, y)
    lies within the outline, by integrals along its edges (Green's theorem). A query meets the edges
    between REACH bandwidths below and above it that do not lie as far to its left."""
    width = max(h, _height(edges))
    lo, hi = F.floor((F.col("y") - REACH * h) / width), F.floor((F.col("y") + REACH * h) / width)
    q = queries.select(*by, "id", "x", "y").withColumn("from", lo).withColumn("bucket", F.explode(F.sequence(lo, hi)))
    once = F.col("bucket") == F.greatest("from", "first")  # of the buckets that both reach into
    met = q.join(_band(edges, width), [*by, "bucket"]).filter(once & (F.greatest("x1", "x2") > F.col("x") - REACH * h))
    to = lambda c, o: (F.col(c) - F.col(o)) / h
    part = met.groupBy(*by, "id").agg(F.sum(_edge_mass(to("x1", "x"), to("y1", "y"), to("x2", "x"), to("y2", "y"))).alias("m"))
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce("m", F.lit(0.0))))
    return queries.select(*by, "id").join(part, [*by, "id"], "left").select(*by, "id", value.alias("mass"))


def grid_inside(edges: DataFrame, spacing: float) -> DataFrame:
    """A square grid over the outline's box, its points inside the outline and not in its holes: id,
    gy, gx, x, y."""
    b = edges.agg(F.min("x1").alias("x0"), F.max("x1").alias("x1"), F.min("y1").alias("y0"), F.max("y1").alias("y1")).first()
    if b["x0"] is None:
        return edges.sparkSession.createDataFrame([], "id long, gy long, gx long, x double, y double")
    nx, ny = (max(1, math.ceil((hi - lo) / spacing)) for lo, hi in ((b["x0"], b["x1"]), (b["y0"], b["y1"])))
    g = edges.sparkSession.range(nx * ny).select("id", F.floor(F.col("id") / nx).alias("gy"), (F.col("id") % nx).alias("gx"))
    g = g.withColumn("x", (F.col("gx") + 0.5) * spacing + b["x0"]).withColumn("y", (F.col("gy") + 0.5) * spacing + b["y0"])
    return g.join(crossings(g, edges).filter("inside").select("id"), "id")


def density(edges_w: DataFrame, queries: DataFrame, outline: DataFrame, h: float, floor: float = 0.05) -> DataFrame:
    """Kernel density of points at queries (id, x, y), corrected for the outline: the sum of weights
    over the kernel's mass within it (at least `floor`), 0 outside. edges_w: qid, w."""
    s = edges_w.groupBy(F.col("qid").alias("id")).agg(F.sum("w").alias("s"))
    rows = queries.join(mass(queries, outline, h), "id").join(crossings(queries, outline).select("id", "inside"), "id").join(s, "id", "left")
    return rows.select("id", "mass", F.when(F.col("inside"), F.coalesce("s", F.lit(0.0)) / F.greatest("mass", F.lit(floor))).otherwise(F.lit(0.0)).alias("density"))
