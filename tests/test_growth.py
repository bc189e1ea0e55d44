"""Queries that failed on larger tables: what made them grow is gone, their results are the same."""

from sparkloom.operators import cells
from sparkloom.plans import alignment


def test_aligned_points_need_no_neighbours(spark, monkeypatch):
    """Moving points makes no neighbour join; agreement, which does, is a part of `align` alone."""

    def fail(*args, **kwargs):
        raise AssertionError("neighbours were joined")

    monkeypatch.setattr(cells, "neighbours", fail)
    rows = [(100 * s + i, name, str(i % 3), float(i % 5) + s, float(i % 7)) for s, name in enumerate("ab") for i in range(60)]
    pts = spark.createDataFrame(rows, "id long, sample_id string, cluster string, x double, y double")
    out = alignment.move(pts, "a", "b", alignment.Config(cells=16, iterations=2)).collect()
    assert len(out) == 120 and all(r["x_aligned"] == r["x"] for r in out if r["sample_id"] == "b")


def test_single_linkage_takes_few_rounds(spark, monkeypatch):
    """One region that takes all others one by one costs no round each, and the merges are the same."""
    from sparkloom.operators import agglomerate
    from tests.test_agglomerate import one_at_a_time

    # a path of ever longer steps, its ids in no order: mutual nearest pairs would be one a round
    ids = [(i * 37) % 61 for i in range(61)]
    adjacency = {tuple(sorted(p)): (1.0 + i, 1.0) for i, p in enumerate(zip(ids, ids[1:]))}
    df = spark.createDataFrame([(i, j, d, w) for (i, j), (d, w) in adjacency.items()], "i long, j long, d double, w double")
    cuts, cut = [], agglomerate.cut
    monkeypatch.setattr(agglomerate, "cut", lambda x: cuts.append(1) or cut(x))
    got = agglomerate.merges(df, "single").collect()
    assert sorted((r["into"], r["from"], r["height"]) for r in got) == sorted(one_at_a_time(adjacency, "single"))
    assert len(cuts) < 60


def test_a_query_is_sent_to_blocks_not_to_slices(spark, monkeypatch):
    """On vectors without clusters every slice is met, yet a query's vector goes to a few blocks only."""
    import numpy as np
    from pyspark.sql import functions as F

    from sparkloom.operators import metric

    for name, value in {"SLICE": 20, "QUERIES": 25, "MEMBERS": 15, "BLOCK": 150, "LEAST_QUERIES": 60}.items():
        monkeypatch.setattr(metric, name, value)
    x = np.random.default_rng(5).normal(size=(400, 24))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    sent, cut = [], metric.cut
    monkeypatch.setattr(metric, "cut", lambda t: (sent.append(out := cut(t)), out)[1])
    found, met, index = metric.search(df, 7)
    got = {(r["qid"], r["nid"], r["rank"]) for r in found.collect()}
    want = set()
    for i, a in enumerate(x):
        d2 = ((x - a) ** 2).sum(1)
        d2[i] = -1
        want |= {(i, int(j), t + 1) for t, j in enumerate(np.lexsort((np.arange(400), d2))[:7])}
    assert got == want
    assert met.agg(F.avg("met")).first()[0] > 0.9 * len(index.pivot) > 10
    most = max(t.filter("size(v) > 0").groupBy("qid").count().agg(F.max("count")).first()[0] for t in sent if "qid" in t.columns)
    assert most <= 5


def test_geometry_of_places_with_many_points(spark):
    """Places that hold more than k points each have a geometry too, and copies count one by one."""
    from sparkloom.operators import tissue

    grid = [(60 * p + c, "s", float(p % 10), float(p // 10)) for p in range(100) for c in range(60)]
    g = tissue.auto_geometry(spark.createDataFrame(grid, "id long, sample_id string, x double, y double"))
    # most places have 299 others within 1, and within the radius that covers 18 of them the 60 of a place
    assert abs(g["radius"] - (18 / 299) ** 0.5) < 1e-9 and (g["grid_n"], g["neff_min"], g["k_max"]) == (165, 25, 65)
    one = [(i, "s", 1.0, 2.0) for i in range(9)]
    assert tissue.auto_geometry(spark.createDataFrame(one, "id long, sample_id string, x double, y double"))["radius"] == 0.0


def test_fits_are_not_rounded(spark):
    """A replicate's fit is good to the last digits: places it moves do not change in the tenth."""
    import pytest

    from sparkloom.plans import replicates

    rows = [(i, str(i % 5), (i % 5) * 1000.0 + i % 7 / 7, (i * 3 % 5) * 1000.0 + i % 11 / 11) for i in range(100)]
    ref = spark.createDataFrame(rows, "id long, cluster string, x double, y double")
    query = ref.selectExpr("id", "cluster", "3 * y + 17 AS x", "11 - 3 * x AS y")
    points, fits = replicates.align(query, ref, [0], 1.0)
    assert fits.first()["scale"] == pytest.approx(1 / 3, rel=1e-15)
    got = points.join(ref.selectExpr("id", "x AS rx", "y AS ry"), "id").selectExpr("max(abs(x - rx)) AS x", "max(abs(y - ry)) AS y").first()
    assert got["x"] < 1e-11 and got["y"] < 1e-11


def test_communities_broadcast_no_table(spark, monkeypatch):
    """No join of the rounds sends a table of nodes through the driver, however small it is here."""
    from sparkloom.operators import communities

    plans, cut = [], communities.cut
    monkeypatch.setattr(communities, "cut", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), cut(df))[1])
    e = [(i, j, 1.0) for g in (0, 10) for i in range(g, g + 5) for j in range(i + 1, g + 5)] + [(4, 10, 1.0)]
    out = communities.communities(spark.createDataFrame(e, "i long, j long, w double"), levels=2, rounds=2)
    plans.append(out._jdf.queryExecution().executedPlan().toString())
    assert sum("SortMergeJoin" in p for p in plans) > 5 and not any("Broadcast" in p for p in plans)


def test_regions_merge_in_blocks(spark, monkeypatch):
    """A path of ever longer steps costs no round for each merge, and however small the blocks are the
    merges are those of one at a time."""
    import numpy as np

    from sparkloom.operators import agglomerate
    from tests.test_agglomerate import one_at_a_time

    frame = lambda a: spark.createDataFrame([(i, j, d, w) for (i, j), (d, w) in a.items()], "i long, j long, d double, w double")
    path = {(i, i + 1): (1.0 + i, 1.0) for i in range(40)}
    cuts, cut = [], agglomerate.cut
    monkeypatch.setattr(agglomerate, "cut", lambda x: cuts.append(1) or cut(x))
    assert [(r["into"], r["from"]) for r in agglomerate.merges(frame(path)).orderBy("round").collect()] == [(0, i + 1) for i in range(40)]
    assert len(cuts) < 10
    monkeypatch.setattr(agglomerate, "BLOCK", 25)
    rng = np.random.default_rng(8)
    some = {(i, j): (float(rng.random()), float(rng.integers(1, 9))) for i in range(40) for j in range(i + 1, 40) if rng.random() < 0.12}
    for linkage, stop in (("average", None), ("complete", 0.5)):
        rows = agglomerate.merges(frame(some), linkage, stop).collect()
        want = one_at_a_time(some, linkage, stop)
        assert sorted((r["into"], r["from"], round(r["height"], 9)) for r in rows) == sorted(want)
        first = {r["from"]: r["round"] for r in rows}
        assert all(first[r["into"]] > r["round"] for r in rows if r["into"] in first)  # a region ends after what it took
    left = {r["label"] for r in agglomerate.regions(spark.range(40), agglomerate.merges(frame(some)), 30).collect()}
    assert len(left) == 30


def test_neighbours_are_found_once_for_features(spark):
    """Neighbourhood features take their neighbours in one pass, and are those of a plain sum."""
    import numpy as np

    from sparkloom.operators import clustering

    xy = {i: (float(i % 4), float(i * i % 7)) for i in range(12)}
    pairs = [(i, j, float(np.hypot(xy[i][0] - xy[j][0], xy[i][1] - xy[j][1]))) for i in xy for j in ((i + 1) % 12, (i + 5) % 12, (i + 7) % 12)]
    expr = {(i, g): float(i + 3 * k) for i in range(11) for k, g in enumerate("ab") if (i + k) % 3}
    taken = spark.sparkContext.accumulator(0)

    def seen(batches):
        for pdf in batches:
            taken.add(len(pdf))
            yield pdf

    nn = spark.createDataFrame(pairs, "qid long, nid long, d double").mapInPandas(seen, "qid long, nid long, d double")
    points = spark.createDataFrame([(i, *p) for i, p in xy.items()], "id long, x double, y double")
    got = {(r["id"], r["feature"]): r["value"] for r in clustering.banksy(nn, spark.createDataFrame([(*k, v) for k, v in expr.items()], "id long, gene string, value double"), points).collect()}
    assert taken.value == len(pairs)
    want = {}
    for g in "ab":
        own, mean, agf = np.zeros(12), np.zeros(12), np.zeros(12)
        for i in xy:
            own[i] = expr.get((i, g), 0.0)
            near = [(j, d) for q, j, d in pairs if q == i]
            w = np.exp(-0.5 * (np.array([d for _, d in near]) / np.median([d for _, d in near])) ** 2)
            z = sum(a * expr.get((j, g), 0.0) * np.exp(1j * np.arctan2(xy[j][1] - xy[i][1], xy[j][0] - xy[i][0])) for a, (j, _) in zip(w / w.sum(), near))
            mean[i], agf[i] = sum(a * expr.get((j, g), 0.0) for a, (j, _) in zip(w / w.sum(), near)), abs(z)
        for name, v, c in (("own", own, 0.2), ("mean", mean, 1.6 / 3), ("agf", agf, 0.8 / 3)):
            want |= {(i, f"{name}:{g}"): c**0.5 * (v[i] - v.mean()) / v.std() for i in xy}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
