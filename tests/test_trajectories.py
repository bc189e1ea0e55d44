"""Trajectory clusters: planted shapes, and silhouettes against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import trajectories


def test_planted_shapes_are_found(spark):
    rng = np.random.default_rng(1)
    t = np.linspace(0, 1, 6)
    shapes = [t - 0.5, 0.5 - t, np.where(t < 0.5, t, 1 - t) - 0.2]
    rows, truth = [], {}
    for i in range(150):
        s = i % 3
        truth[i] = s
        y = 3 * shapes[s] * (1 + rng.random()) + rng.normal(size=6) * 0.15 + 10
        rows += [(i, k, float(v)) for k, v in enumerate(y) if (i + k) % 17]
    curves = spark.createDataFrame(rows, "id long, ord int, value double")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(150) for j in ((i + 3) % 150, (i - 3) % 150)], "qid long, nid long, w double")
    out = trajectories.trajectory_clusters(curves, edges, [2, 3, 4, 5, 6], level_weight=0.0)
    assert out.k == 3 and out.table["k"].tolist() == [2, 3, 4, 5, 6]
    got = {r["id"]: r["label"] for r in out.labels.collect()}
    assert len({(truth[i], got[i]) for i in got}) == 3 and len(got) == 150
    assert (np.diff(out.table["within"]) <= 1e-6).all()


def test_features(spark):
    df = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0), (2, 0, 5.0), (2, 1, 5.0), (3, 0, None), (4, 0, 4.0)], "id long, ord int, value double")
    got = {r["id"]: r["v"] for r in trajectories.curve_features(df).collect()}
    assert set(got) == {1, 2, 4} and got[2][1:] == [0.0, 0.0] and got[4][1:] == [0.0, 0.0]
    assert got[1][1:] == pytest.approx([-(0.5**0.5), 0.5**0.5])
    assert sum(v[0] for v in got.values()) == pytest.approx(0) and sum(v[0] ** 2 for v in got.values()) == pytest.approx(3)
    v = spark.createDataFrame([(1, [0.0, 2.0]), (2, [4.0, 0.0]), (3, [1.0, 1.0])], "id long, v array<double>")
    e = spark.createDataFrame([(1, 2, 1.0), (1, 3, 3.0), (1, 1, 9.0)], "qid long, nid long, w double")
    got = {r["id"]: r["v"] for r in trajectories.smooth_features(v, e).collect()}
    assert got == {1: pytest.approx([0.875, 1.375]), 2: [4.0, 0.0], 3: [1.0, 1.0]}


def test_silhouettes_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.5, (25, 3)) for c in ((0, 0, 0), (3, 0, 0), (0, 4, 0))])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "v array<double>").repartition(3)
    sets = [np.array([[0, 0, 0], [3, 0, 0], [0, 4, 0]], float), np.array([[1, 1, 0], [9, 9, 9]], float), np.array([[0, 2, 0], [3, 0, 0]], float)]
    got = trajectories.silhouettes(df, sets)
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    for c, value in zip(sets, got):
        own = ((x[:, None] - c[None]) ** 2).sum(2).argmin(1)
        s = []
        for i in range(len(x)):
            mean = [d2[i, own == k].sum() / max((own == k).sum() - (k == own[i]), 1) if (own == k).any() else np.inf for k in range(len(c))]
            a, b = mean[own[i]], min([m for k, m in enumerate(mean) if k != own[i]], default=np.inf)
            s.append(0.0 if (own == own[i]).sum() < 2 or not np.isfinite(b) else (b - a) / max(a, b))
        assert value == pytest.approx(np.mean(s), abs=1e-9)


def test_sweep_on_few_rows(spark):
    df = spark.createDataFrame([(1, [0.0]), (2, [0.0]), (3, [5.0])], "id long, v array<double>")
    out = trajectories.sweep(df, [2, 3])
    assert out.k == 2 and out.table["k"].tolist() == [2]
    with pytest.raises(ValueError):
        trajectories.sweep(df.limit(0), [2])
    assert trajectories.sweep(df.filter(F.col("id") < 3), [1]).k == 1
