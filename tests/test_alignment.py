"""Cross-sample alignment does its whole job: all rows, the raster at its spacing, matched until no step helps."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom import queries_models, registry  # noqa: F401
from sparkloom.functions.registration import Field, mismatch, register
from sparkloom.plans import alignment


def test_channels_in_tasks_match_as_in_one_process(spark):
    """The matching of channels that tasks share equals that of all channels in one process."""
    n, (y, x) = 20, np.mgrid[:20, :20]
    blob = lambda cy, cx, w: np.exp(-((y - cy) ** 2 + (x - cx) ** 2) / w)
    sides = {"query": [blob(8, 8, 20), blob(12, 11, 30), blob(9, 12, 25)], "reference": [blob(10, 9, 24), blob(13, 12, 30), blob(10, 14, 25)]}
    rows = [(side, str(c), i, j, float(a[i, j])) for side, all_ in sides.items() for c, a in enumerate(all_) for i in range(n) for j in range(n)]
    rows.append(("query", "alone", 0, 0, 1.0))
    fields = alignment.rasters(spark.createDataFrame(rows, "side string, channel string, iy int, ix int, v double"), n)
    assert sorted(r["channel"] for r in fields.collect()) == ["0", "1", "2"]
    assert len(fields.inputFiles()) >= 3  # a channel a file, so that no task need take all
    config = alignment.Config(iterations=12, smoothness=2.0)
    v, losses = alignment.match(fields, n, config)
    f, want = register(np.stack(sides["query"]), np.stack(sides["reference"]), config.steps, 12, 2.0, sigma=config.match_sigma)
    assert losses == pytest.approx(want) and losses[-1] < 0.5 * losses[0]
    assert np.abs(f.v).max() > 0.1 and np.allclose(v, f.v, atol=1e-9)


def test_pull_is_the_gradient_of_the_loss():
    """The gradient by the velocities is that of the transport as it is computed, so that steps go on to lower the loss."""
    rng = np.random.default_rng(0)
    source, target = rng.random((2, 3, 9, 11))
    f = Field((9, 11), 4, 2.0)
    f.v = rng.normal(size=f.v.shape) * 0.4

    def loss(v):
        f.v = v
        return mismatch(source, target, f.back()[-1], 0.5)[0]

    v, h = f.v, rng.normal(size=f.v.shape)
    back = f.back()
    got = (f.through(back, mismatch(source, target, back[-1], 0.5)[1]) * h).sum() / len(v)
    assert got == pytest.approx((loss(v + 1e-6 * h) - loss(v - 1e-6 * h)) / 2e-6, rel=1e-5)


def test_matching_ends_where_steps_hardly_lower_the_loss():
    y, x = np.mgrid[:24, :24]
    a, b = (np.exp(-((y - c) ** 2 + (x - c) ** 2) / 40.0)[None] for c in (11, 12))
    most = alignment.Config().iterations
    f, losses = register(a, b, iterations=most)
    assert 10 < len(losses) - 1 < most == 500
    assert losses[-1] < 360.1  # descent along the continuous gradient ended at 362.2
    rng = np.random.default_rng(0)
    end = f.v.copy()
    for _ in range(20):  # no small smooth change is better
        f.v = end + 1e-2 * f.smooth(rng.normal(size=end.shape), 0.5)
        assert f.energy() / 2 + mismatch(a, b, f.back()[-1], 0.02)[0] > losses[-1]


def test_the_query_moves_all_rows_on_a_raster_of_its_spacing(spark, tmp_path, monkeypatch):
    """Rows in one place count each, no parameter cuts iterations, and the raster has a cell a unit."""
    li = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    li.unionByName(li.withColumn("l_orderkey", F.col("l_orderkey") + 10**7)).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen = []

    def match(fields, n, config):
        seen.append((n, config))
        return np.zeros((config.steps, 2, n, n)), []

    monkeypatch.setattr(alignment, "match", match, raising=False)
    out = registry.QUERIES["cross_sample_alignment"](spark, str(tmp_path))
    got = {r["sample_id"]: r["n"] for r in out.groupBy("sample_id").agg(F.sum("n").alias("n")).collect()}
    assert got == {r["s"]: 2 * r["n"] for r in li.filter("l_returnflag in ('A', 'N')").groupBy(F.col("l_returnflag").alias("s")).agg(F.count(F.lit(1)).alias("n")).collect()}
    (n, config), = seen
    a = li.filter("l_returnflag = 'A'").agg((F.max("l_extendedprice") - F.min("l_extendedprice")).alias("e")).first()["e"] / 1000
    assert n >= math.floor(1.1 * a) > 48 and config.iterations == alignment.Config().iterations


def test_spacing_gives_the_number_of_cells(spark, monkeypatch):
    rows = [(s, str(i % 2), float(i % 9) * 10 + s.count("b"), float(i % 7) * 5) for s in ("a", "b") for i in range(63)]
    pts = spark.createDataFrame(rows, "sample_id string, cluster string, x double, y double")
    seen = []
    monkeypatch.setattr(alignment, "match", lambda fields, n, config: (seen.append(n), (np.zeros((config.steps, 2, n, n)), []))[1])
    for spacing, cells, want in ((4.0, None, 22), (30.0, None, 3), (4.0, 16, 16)):
        out = alignment.move(pts, "a", "b", alignment.Config(spacing=spacing, cells=cells)).collect()
        assert seen.pop() == want
        assert max(abs(r["x_aligned"] - r["x_prealigned"]) for r in out) < 1e-9
