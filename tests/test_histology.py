import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import geometry, histology
from sparkloom.sources import tables


def test_cluster_grid_finds_regions(spark):
    rng = np.random.default_rng(0)
    rows = [(y, x, [float(v) for v in rng.normal(3.0 * (x >= 8), 0.1, 4)], [100.0 + 50 * (y >= 8)] * 3) for y in range(16) for x in range(16)]
    grid = spark.createDataFrame(rows, "iy int, ix int, v array<double>, rgb array<double>")
    got = histology.cluster_grid(grid, 2).toPandas()
    assert got[got["ix"] < 8]["mask"].nunique() == 1 and got["mask"].nunique() == 2
    assert histology.cluster_grid(grid, 2, background=120.0).count() == 128


def test_mirrored_structures_merge(spark):
    rows = [("l", y, x) for y in range(4) for x in range(4)] + [("r", y, 19 - x) for y in range(4) for x in range(4)] + [("mid", y, x) for y in range(10, 14) for x in range(8, 12)]
    got = histology.symmetric_merges(spark.createDataFrame(rows, "mask string, iy int, ix int"), 20)
    assert [tuple(r[:2]) for r in got.itertuples(index=False)] == [("l", "r")]


def test_search_recovers_a_turn(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((2500, 2)) * [20, 6]
    t = np.radians(-40)
    turned = xy @ np.array([[np.cos(t), -np.sin(t)], [np.sin(t), np.cos(t)]]).T
    df = lambda a: spark.createDataFrame([(float(x), float(y)) for x, y in a], "x double, y double")
    angle, scale, iou = geometry.search_similarity(df(turned), df(xy), 1.0)
    assert abs((angle - 40 + 90) % 180 - 90) <= 6 and 0.9 <= scale <= 1.11 and iou > 0.8


def test_arrays_and_legacy(spark, tmp_path):
    for i in (1, 2):
        np.savez(tmp_path / f"lddmm_input_rep{i}.npz", I=np.full((2, 3), i), x=np.arange(2))
    got = {(r["repeat"], r["name"]): (r["shape"], r["values"]) for r in tables.read_arrays(spark, str(tmp_path), {"I": "source"}).collect()}
    assert got[2, "source"] == ([2, 3], [2.0] * 6) and got[1, "x"] == ([2], [0.0, 1.0])
    meta = spark.createDataFrame([("s1", "V1", 3)], "obs string, slide string, age int")
    m, e = tables.legacy_batch(meta, spark.createDataFrame([("g", "5")], "gene string, s1 string"), "A", 4)
    assert m.first()["sample_id"] == "A_sample4_V1_age3" and tuple(e.first()) == ("g", "s1", 5.0)
    assert e.filter(F.col("value") != 5).count() == 0 and pytest
