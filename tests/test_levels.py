"""Coarse-to-fine pairs: greedy sets, the levels of a hierarchy, and when the continuation ends."""

import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import pairing
from sparkloom.plans import levels

SCHEMA = "cluster string, candidate string, labels array<long>, score double"


def one_at_a_time(rows):
    clusters, labels, out = set(), set(), []
    for c, name, ls, s in sorted(rows, key=lambda r: (-r[3], r[0], r[1])):
        if c not in clusters and not labels & set(ls):
            out.append((c, name))
            clusters.add(c)
            labels |= set(ls)
    return sorted(out)


def test_disjoint_sets_equal_one_at_a_time(spark):
    rng = np.random.default_rng(9)
    rows = [(f"c{i % 9}", f"n{i}", sorted({int(x) for x in rng.integers(0, 25, 3)}), float(rng.integers(0, 12))) for i in range(120)]
    got = pairing.disjoint_sets(spark.createDataFrame(rows, SCHEMA))
    assert sorted((r["cluster"], r["candidate"]) for r in got.collect()) == one_at_a_time(rows)
    assert got.columns == ["cluster", "candidate", "labels", "score"]
    assert pairing.disjoint_sets(spark.createDataFrame([], SCHEMA)).count() == 0
    free = pairing.disjoint_sets(spark.createDataFrame([("a", "x", [], 1.0), ("b", "x", [], 1.0)], SCHEMA))
    assert free.count() == 2


def test_levels_and_where_they_end(spark):
    """Two clusters, then four; the continuation wins a pair once, then none."""
    calls = []

    def score(stage, level):
        calls.append((stage, level))
        rows = [("ab", "left", [1, 2], 0.9), ("cd", "right", [3, 4], 0.8), ("ab", "right", [3, 4], 0.85)] if level == 0 else [("a", "one", [1], 0.9), ("b", "two", [2], 0.4 + 0.3 * (stage > 1)), ("c", "three", [3], 0.7), ("d", "three too", [3], 0.6)]
        return spark.createDataFrame(rows, SCHEMA)

    seen = []
    state = levels.run(score, 2, least=0.5, after=lambda stage, pairs: seen.append((stage, pairs.count())))
    assert seen == [(0, 2), (1, 2), (2, 3)] and calls == [(0, 0), (1, 1), (2, 1), (3, 1)]
    assert {(r["cluster"], r["candidate"]) for r in levels.final_pairs(state).collect()} == {("a", "one"), ("b", "two"), ("c", "three")}
    used = levels.used_labels(state)
    assert used.groupBy("stage", "label").count().filter("count > 1").isEmpty() and used.filter("stage = 0").count() == 4


def test_layers_first(spark):
    rows = [("a", "layer 1", [1], 0.5), ("b", "area", [1, 2], 0.9), ("b", "other", [3], 0.6)]
    got = levels.accepted(spark.createDataFrame(rows, SCHEMA), F.col("candidate").startswith("layer"))
    assert {(r["cluster"], r["candidate"]) for r in got.collect()} == {("a", "layer 1"), ("b", "other")}
    assert {(r["cluster"], r["candidate"]) for r in levels.accepted(spark.createDataFrame(rows, SCHEMA)).collect()} == {("b", "area")}
