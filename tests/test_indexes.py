"""Adaptive cells, the metric index and communities against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import cells, communities, metric, neighbours


def nearest(data, query, k=None, radius=None, include_self=True):
    out = set()
    for q, x, y in query:
        e = sorted(((a - x) ** 2 + (b - y) ** 2, i) for i, a, b in data if include_self or i != q)
        e = [z for z in e if radius is None or z[0] <= radius * radius]
        out |= {(q, i, round(d2**0.5, 9)) for d2, i in e[:k]}
    return out


def frame(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double")


def numbered(xy, first=0):
    return [(first + i, float(a), float(b)) for i, (a, b) in enumerate(xy)]


RNG = np.random.default_rng(0)
CORE = numbered(np.vstack([RNG.random((540, 2)) * 0.1, RNG.random((60, 2))]))
COPIES = numbered([(i % 5, i % 3) for i in range(300)] + [(0.5, 0.5)] * 200)
FAR = numbered(RNG.random((60, 2)) * 3 - 1, 10_000)


@pytest.fixture
def small(monkeypatch):
    """Leaves and tasks of a few rows."""
    monkeypatch.setattr(cells.build, "__defaults__", (20,))
    monkeypatch.setattr(cells, "QUERIES", 30)
    monkeypatch.setattr(cells, "DATA", 40)


@pytest.mark.parametrize("data, query, k, radius, include_self", [(CORE, CORE, 6, None, True), (CORE, CORE, 3, None, False), (COPIES, COPIES, 7, None, True), (COPIES, COPIES, 4, None, False), (CORE, FAR, 5, None, True), (CORE, FAR, None, 0.05, True), (COPIES, COPIES, None, 0.0, True), (CORE, CORE, 4, 0.01, True), (CORE[:3], FAR, 5, None, True)])
def test_cells_are_exact(spark, small, data, query, k, radius, include_self):
    got = cells.neighbours(frame(spark, data), frame(spark, query), [], k, radius, include_self)
    assert {(r["qid"], r["nid"], round(r["d2"] ** 0.5, 9)) for r in got.collect()} == nearest(data, query, k, radius, include_self)


def test_dense_cores_are_many_leaves(spark):
    """Nine of ten points in a hundredth of the area: no leaf over the bound, and few near-empty ones."""
    xy = np.vstack([RNG.random((9000, 2)) * 0.1, RNG.random((1000, 2))])
    tree, most = cells.build(frame(spark, numbered(xy)), [], 100)
    leaves = tree[()]
    held = np.diff(leaves.before)
    assert most == 100 and held.max() <= 100 and held.sum() == 10_000 and len(held) < 16 * 10_000 / 100
    where = leaves.locate(leaves.code(xy[:, 0], xy[:, 1]))
    assert (np.bincount(where, minlength=len(held)) == held).all()


def test_cells_by_group_skip_what_has_no_place(spark):
    rows = [(i, "ab"[i % 2], float(i % 7), float(i % 4)) for i in range(40)] + [(90, "a", None, 1.0), (91, None, 1.0, 1.0), (92, "a", float("nan"), 1.0), (93, "a", float("inf"), 0.0)]
    df = spark.createDataFrame(rows, "id long, s string, x double, y double")
    got = neighbours.knn(df, df, 3, ("s",)).collect()
    for s in "ab":
        own = [(i, x, y) for i, g, x, y in rows[:40] if g == s]
        assert {(r["qid"], r["nid"], round(r["d"], 9)) for r in got if r["s"] == s} == nearest(own, own, 3)
    assert len(got) == 120
    assert neighbours.knn(df.limit(0), df, 3, ("s",)).count() == 0 and neighbours.knn(df, df.limit(0), 3, ("s",)).count() == 0
    named = spark.createDataFrame([("p", 0.0, 0.0), ("q", 1.0, 0.0)], "id string, x double, y double")
    assert {(r["qid"], r["nid"]) for r in neighbours.knn(named, named, 1, include_self=False).collect()} == {("p", "q"), ("q", "p")}


def test_metric_index_is_exact(spark, monkeypatch):
    monkeypatch.setattr(metric, "SLICE", 30)
    monkeypatch.setattr(metric, "QUERIES", 25)
    monkeypatch.setattr(metric, "MEMBERS", 20)
    x = np.vstack([RNG.normal(size=(120, 6)) * 0.1 + RNG.normal(size=6) * 3 for _ in range(5)])
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(5000 + i, rows[7][1]) for i in range(40)] + [(6000, [0.0] * 6), (6001, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = {(r["qid"], r["nid"], r["rank"]) for r in metric.knn(df, 9).collect()}
    ids, v = np.array([i for i, a in rows if a]), np.array([a for _, a in rows if a])
    want = set()
    for i, a in zip(ids, v):
        d2 = ((v - a) ** 2).sum(1)
        d2[ids == i] = -1
        want |= {(int(i), int(ids[j]), t + 1) for t, j in enumerate(np.lexsort((ids, d2))[:9])}
    assert got == want
    found, met, index = metric.search(df.filter("id < 5000"), 9)
    assert met.agg(F.avg("met")).first()[0] < 0.5 * len(index.pivot)
    assert metric.knn(df.limit(0), 3).count() == 0
    assert {(r["qid"], r["nid"]) for r in metric.knn(df.filter("id < 2"), 5).collect()} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_components(spark):
    chain = [(i, i + 1) for i in range(60) if i % 20 != 19] + [(100, 101), (101, 100), (7, 7), (300, 300)]
    got = {r["id"]: r["label"] for r in communities.components(spark.createDataFrame(chain, "i long, j long")).collect()}
    assert got[101] == 100 and got[300] == 300 and all(got[i] == i // 20 * 20 for i in range(60))


def test_parts_are_connected(spark):
    """A community of two cliques that only a third community's node joins is taken apart."""
    e = [(i, j, 1.0) for g in (0, 10) for i in range(g, g + 5) for j in range(i + 1, g + 5)] + [(4, 20, 1.0), (10, 20, 1.0)]
    graph = spark.createDataFrame([*e, *[(j, i, w) for i, j, w in e]], "i long, j long, w double")
    total = graph.agg(F.sum("w")).first()[0]
    nodes = graph.groupBy("i").agg(F.sum("w").alias("k")).withColumn("c", F.when(F.col("i") == 20, 20).otherwise(0).cast("long"))
    parts = communities.refine(graph, nodes, total, 1.0, 12, 0).toPandas()
    assert parts.groupby("s")["i"].agg(lambda i: len({n // 10 for n in i})).max() == 1
    assert parts.loc[parts["i"] == 20, "s"].item() == 20


def test_communities_on_planted_groups(spark):
    rng = np.random.default_rng(4)
    e = [(int(i), int(j), 1.0) for i in range(90) for j in range(i + 1, 90) if rng.random() < (0.5 if i // 15 == j // 15 else 0.02)]
    edges = spark.createDataFrame(e, "i long, j long, w double")
    found = communities.communities(edges)
    got = {r["id"]: r["label"] for r in found.collect()}
    planted = spark.createDataFrame([(i, i // 15 * 15) for i in got], "id long, label long")
    assert communities.modularity(edges, found) >= communities.modularity(edges, planted) - 0.02
    assert sum(got[i] == i // 15 * 15 for i in got) > 0.9 * len(got)
    for label in set(got.values()):
        reached, todo = {label}, [label]
        while todo:
            at = todo.pop()
            near = {b for a, b, _ in e if a == at and got[b] == label} | {a for a, b, _ in e if b == at and got[a] == label}
            todo += near - reached
            reached |= near
        assert reached == {i for i in got if got[i] == label}
