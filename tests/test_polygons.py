"""Outlines of cells: rings and holes, points inside, kernel mass against a fine sum."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import polygons


def annulus(n=24, r=10.0, hole=4.0):
    return [(y, x) for y in range(n) for x in range(n) if hole**2 <= (x + 0.5 - n / 2) ** 2 + (y + 0.5 - n / 2) ** 2 <= r * r]


def cells_of(spark, cells):
    return spark.createDataFrame(cells, "iy int, ix int")


def test_a_ring_keeps_its_hole(spark):
    cells = annulus()
    e = polygons.boundary(cells_of(spark, cells), x0=3.0, y0=-1.0, side=0.5)
    ring = polygons.rings(e).toPandas()
    areas = polygons.ring_areas(polygons.rings(e)).toPandas()
    assert sorted(areas["hole"]) == [False, True] and areas["area"].sum() == pytest.approx(len(cells) * 0.25)
    for _, g in ring.groupby("ring"):
        g = g.sort_values("pos")
        assert g["pos"].tolist() == list(range(len(g)))
        step = np.abs(np.diff(np.vstack([g[["x", "y"]], g[["x", "y"]].iloc[:1]]), axis=0)).sum(1)
        assert np.allclose(step, 0.5)


def test_cells_that_touch_at_a_corner_are_two_rings(spark):
    e = polygons.boundary(cells_of(spark, [(0, 0), (1, 1), (5, 5)]))
    areas = polygons.ring_areas(polygons.rings(e)).toPandas()
    assert sorted(areas["area"]) == [1.0, 1.0, 1.0] and sorted(areas["n"]) == [4, 4, 4]
    # of a block without its middle diagonal cells the holes touch, and stay one for each way round
    block = [(y, x) for y in range(4) for x in range(4) if (y, x) not in ((1, 1), (2, 2))]
    areas = polygons.ring_areas(polygons.rings(polygons.boundary(cells_of(spark, block)))).toPandas()
    assert areas["area"].sum() == 14.0 and areas["hole"].sum() >= 1


def test_points_inside(spark):
    rng = np.random.default_rng(2)
    cells = annulus()
    e = polygons.boundary(cells_of(spark, cells))
    pts = [(i, float(x), float(y)) for i, (x, y) in enumerate(rng.random((400, 2)) * 28 - 2)]
    want = {i: (math.floor(y), math.floor(x)) in set(cells) for i, x, y in pts}
    df = spark.createDataFrame(pts, "id long, x double, y double")
    for edges in (e, polygons.upright(e)):
        assert {r["id"]: r["inside"] for r in polygons.crossings(df, edges).collect()} == want
    tri = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 1.0, 5.0), (1.0, 5.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    got = {r["id"]: r["inside"] for r in polygons.crossings(df, tri).collect()}
    assert got == {i: y > 0 and 5 * x - y > 0 and 5 * x + 3 * y < 20 for i, x, y in pts}


def test_groups_have_their_own_outlines(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("b", 0, 1), ("b", 0, 2)], "s string, iy int, ix int")
    e = polygons.boundary(cells, ("s",))
    pts = spark.createDataFrame([("a", 1, 0.5, 0.5), ("b", 2, 0.5, 0.5), ("b", 3, 1.5, 0.5)], "s string, id long, x double, y double")
    assert {r["id"]: r["inside"] for r in polygons.crossings(pts, e, ("s",)).collect()} == {1: True, 2: False, 3: True}
    assert polygons.upright(e, ("s",)).count() == 4 and polygons.ring_areas(polygons.rings(e, ("s",)), ("s",)).count() == 2


@pytest.mark.parametrize("h", [0.7, 2.5])
def test_mass_equals_a_fine_sum(spark, h):
    cells = annulus()
    e = polygons.boundary(cells_of(spark, cells))
    at = [(0, 12.0, 12.0), (1, 12.0, 5.0), (2, 2.2, 12.0), (3, 21.9, 12.3), (4, 30.0, 30.0), (5, 12.0, 16.1)]
    q = spark.createDataFrame(at, "id long, x double, y double")
    got = {r["id"]: r["mass"] for r in polygons.mass(q, polygons.upright(e), h).collect()}
    fine = 40
    y, x = ((np.array(c)[:, None] + (np.arange(fine) + 0.5) / fine) for c in zip(*cells))
    for i, qx, qy in at:
        gy, gx = np.exp(-(((y - qy) / h) ** 2) / 2), np.exp(-(((x - qx) / h) ** 2) / 2)
        want = (gy.sum(1) * gx.sum(1)).sum() / fine**2 / (2 * math.pi * h * h)
        assert got[i] == pytest.approx(want, abs=1e-3)
    tri = spark.createDataFrame([(0.0, 0.0, 4.0, 0.0), (4.0, 0.0, 1.0, 5.0), (1.0, 5.0, 0.0, 0.0)], "x1 double, y1 double, x2 double, y2 double")
    gx, gy = np.meshgrid((np.arange(2000) + 0.5) / 400, (np.arange(2000) + 0.5) / 400)
    inside = (5 * gx - gy > 0) & (5 * gx + 3 * gy < 20)
    want = (np.exp(-((gx - 2) ** 2 + (gy - 1) ** 2) / (2 * h * h)) * inside).sum() / 400**2 / (2 * math.pi * h * h)
    one = spark.createDataFrame([(9, 2.0, 1.0)], "id long, x double, y double")
    assert polygons.mass(one, tri, h).first()["mass"] == pytest.approx(want, abs=1e-3)


def test_density_is_flat_up_to_the_edge(spark):
    cells = annulus()
    e = polygons.upright(polygons.boundary(cells_of(spark, cells)))
    grid = polygons.grid_inside(e, 1.0)
    assert {(r["gy"], r["gx"]) for r in grid.select("gy", "gx").collect()} <= {(y - 2, x - 2) for y, x in cells} and grid.count() == len(cells)
    pts = spark.createDataFrame([(i, x + (k % 4 + 0.5) / 4, y + (k // 4 + 0.5) / 4) for i, (y, x) in enumerate(cells) for k in range(16)], "i long, x double, y double")
    pts = pts.withColumn("id", F.monotonically_increasing_id())
    from sparkloom.operators import neighbours

    h = 1.5
    near = neighbours.radius_edges(pts, grid, 6 * h, scale=h).withColumn("w", F.col("w") / (2 * math.pi * h * h))
    got = polygons.density(near, grid, e, h).toPandas()
    assert got["density"].between(14.5, 17.5).all() and got["density"].mean() == pytest.approx(16, rel=0.02)
