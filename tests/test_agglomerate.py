"""Agglomeration against one merge at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import agglomerate, histology


def one_at_a_time(adjacency, linkage, stop=None):
    """Merges (into, from, height) of {(i, j): (d, w)}, the nearest first."""
    e = {k: (d * w if linkage == "average" else d, w) for k, (d, w) in adjacency.items()}
    out = []
    far = lambda k: e[k][0] / e[k][1] if linkage == "average" else e[k][0]
    join = {"average": lambda a, b: a + b, "complete": max, "single": min}[linkage]
    while e:
        i, j = min(e, key=lambda k: (far(k), k))
        if stop is not None and far((i, j)) > stop:
            break
        out.append((i, j, round(far((i, j)), 9)))
        new = {}
        for (a, b), (s, w) in e.items():
            a, b = sorted((i if a == j else a, i if b == j else b))
            if a != b:
                t = new.get((a, b))
                new[a, b] = (s, w) if t is None else (join(t[0], s), t[1] + w)
        e = new
    return out


@pytest.mark.parametrize("linkage", ["average", "complete", "single"])
def test_merges_equal_one_at_a_time(spark, linkage):
    rng = np.random.default_rng(3)
    adjacency = {(i, j): (float(rng.random()), float(rng.integers(1, 9))) for i in range(30) for j in range(i + 1, 30) if rng.random() < 0.15}
    df = spark.createDataFrame([(i, j, d, w) for (i, j), (d, w) in adjacency.items()], "i long, j long, d double, w double")
    for stop in (None, 0.4):
        got = agglomerate.merges(df, linkage, stop).collect()
        assert sorted((r["into"], r["from"], round(r["height"], 9)) for r in got) == sorted(one_at_a_time(adjacency, linkage, stop))
    want = one_at_a_time(adjacency, linkage)[:22]
    label = {i: i for i in range(30)}
    for i, j, _ in want:
        label = {k: i if v == j else v for k, v in label.items()}
    nodes = spark.range(30)
    found = agglomerate.regions(nodes, agglomerate.merges(df, linkage), 8).collect()
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups({r["id"]: r["label"] for r in found}) == groups(label)


def test_ties_and_nothing(spark):
    df = spark.createDataFrame([(0, 1, 1.0, 1.0), (1, 2, 1.0, 1.0), (2, 3, 1.0, 1.0)], "i long, j long, d double, w double")
    assert [(r["into"], r["from"]) for r in agglomerate.merges(df).orderBy("round").collect()] == [(0, 1), (0, 2), (0, 3)]
    assert agglomerate.merges(df.limit(0)).count() == 0 and agglomerate.merges(df, stop=0.5).count() == 0
    assert {r["label"] for r in agglomerate.regions(spark.range(4), agglomerate.merges(df, stop=0.5)).collect()} == {0, 1, 2, 3}


def test_structures_of_a_raster(spark):
    """Four strips in two shades merge within their shade, not across."""
    rows = [(y, x, x // 3, [float(x // 6) * 10 + (x // 3) % 2, float(y % 2)]) for y in range(6) for x in range(12)]
    px = spark.createDataFrame(rows, "iy int, ix int, label long, v array<double>")
    a = {(r["i"], r["j"]): (round(r["d"], 6), r["w"]) for r in agglomerate.region_adjacency(px).collect()}
    assert a == {(0, 1): (1.0, 6.0), (1, 2): (9.0, 6.0), (2, 3): (1.0, 6.0)}
    got = histology.merge_structures(px, 2).groupBy("label").agg(F.min("ix").alias("lo"), F.max("ix").alias("hi")).collect()
    assert {(r["label"], r["lo"], r["hi"]) for r in got} == {(0, 0, 5), (2, 6, 11)}
