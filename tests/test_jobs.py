"""The jobs on growing, repeated and broken input."""

import json
import math

import pytest
from pyspark.sql import functions as F

from jobs import common, count_intake, register_cohort


def rows_of(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=str)


# intake


DOCS = [(i, f"{'the ' * (i % 9)}alpha beta gamma delta number eps zeta eta theta iota kappa lam " * 2 + f"own{chr(97 + i)}", "s1" if i % 3 else None, "en") for i in range(20)]
DOCS += [(20, "", "s1", "en"), (21, None, "s2", "en"), (None, "lost its id " * 20, "s1", "en")]
SCHEMA = "doc_id long, text string, source string, lang string"


def intake(spark, at, **settings):
    count_intake.run(spark, f"{at}/in", f"{at}/out", f"{at}/checkpoint", settings or None)
    return count_intake.result(spark, f"{at}/out")


def test_intake_of_growing_input(spark, tmp_path):
    add = lambda rows: spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    add(DOCS[:8])
    first = rows_of(intake(spark, tmp_path))
    assert rows_of(intake(spark, tmp_path)) == first
    batches = lambda: {r[0] for r in count_intake.table(spark, f"{tmp_path}/out", "observations").select("batch").distinct().collect()}
    assert batches() == {0}
    add(DOCS[8:])
    second = rows_of(intake(spark, tmp_path))
    assert batches() == {0, 1} and len(second) > len(first)
    assert rows_of(intake(spark, tmp_path)) == second
    add(DOCS[2:5])  # delivered again: known, skipped
    assert rows_of(intake(spark, tmp_path)) == second
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(f"{tmp_path}/whole/in")
    assert rows_of(intake(spark, f"{tmp_path}/whole")) == second
    seen = {r["name"]: r for r in intake(spark, tmp_path).filter("kind = 'observation'").collect()}
    assert len(seen) == 22 and not seen["20"]["kept"] and not seen["21"]["kept"] and seen["0"]["sample_id"] == "unknown"
    assert seen["1"]["counts"] == 25 and seen["1"]["kept"] and not seen["8"]["kept"]  # 16 controls to 25 counts
    support = {(r["sample_id"], r["name"]): r for r in intake(spark, tmp_path).filter("kind = 'gene'").collect()}
    kept = [i for i in range(20) if seen[str(i)]["kept"] and i % 3]
    assert support["s1", "alpha"]["genes"] == len(kept) and support["s1", "alpha"]["counts"] == 2 * len(kept)


def test_intake_repeats_a_batch(spark, tmp_path):
    """A batch that is taken again, as after a failure, replaces itself."""
    docs = spark.createDataFrame(DOCS[:6], SCHEMA)
    docs.write.parquet(f"{tmp_path}/in")
    want = rows_of(intake(spark, tmp_path))
    count_intake.take(docs, 0, common.config_of(count_intake.__file__), f"{tmp_path}/out")
    assert rows_of(count_intake.result(spark, f"{tmp_path}/out")) == want


def test_intake_in_several_batches(spark, tmp_path):
    spark.createDataFrame(DOCS, SCHEMA).repartition(5).write.parquet(f"{tmp_path}/in")
    spark.createDataFrame(DOCS, SCHEMA).write.parquet(f"{tmp_path}/one/in")
    got = rows_of(intake(spark, tmp_path, files_per_batch=2))
    assert count_intake.table(spark, f"{tmp_path}/out", "observations").select("batch").distinct().count() > 1
    assert got == rows_of(intake(spark, f"{tmp_path}/one"))


def test_intake_refuses_repeated_ids(spark, tmp_path):
    spark.createDataFrame([DOCS[0], DOCS[0]], SCHEMA).coalesce(1).write.parquet(f"{tmp_path}/in")
    with pytest.raises(Exception, match="observations that repeat"):
        intake(spark, tmp_path)


# cohort


def points(spark, samples):
    """Three clusters of nine points; each sample is the reference turned, scaled and moved."""
    base = [(c, cx + dx / 10, cy + dy / 10) for c, (cx, cy) in {"a": (0, 0), "b": (4, 0), "c": (1, 3)}.items() for dx in (-1, 0, 1) for dy in (-1, 0, 1)]
    out = []
    for name, (scale, theta, tx, ty) in samples.items():
        out += [(name, c, (math.cos(theta) * (x - tx) + math.sin(theta) * (y - ty)) / scale, (math.cos(theta) * (y - ty) - math.sin(theta) * (x - tx)) / scale) for c, x, y in base]
    return spark.createDataFrame(out, "sample_id string, cluster string, x double, y double")


PLAIN = {"columns": {c: c for c in ("sample_id", "cluster", "x", "y")}, "reference": "r"}


def test_cohort_recovers_fits(spark, tmp_path):
    known = {"r": (1.0, 0.0, 0.0, 0.0), "7": (1.5, 0.7, 2.0, -1.0), "q": (0.5, -2.0, 0.0, 5.0)}
    df = points(spark, known)
    bad = spark.createDataFrame([("7", "a", None, 1.0), ("7", "nan", 1.0, 1.0), (None, "a", 1.0, 1.0), ("7", "b", float("inf"), 0.0), ("lone", "a", 1.0, 2.0)], df.schema)
    df.union(bad).write.parquet(f"{tmp_path}/in")
    register_cohort.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", PLAIN)
    out = register_cohort.result(spark, f"{tmp_path}/out")
    first = rows_of(out)
    register_cohort.run(spark, f"{tmp_path}/in", f"{tmp_path}/out", PLAIN)
    out = register_cohort.result(spark, f"{tmp_path}/out")  # the first run's files are gone
    assert rows_of(out) == first
    got = {r["sample_id"]: r for r in out.select("sample_id", "status", "scale", "theta", "rmse", "clusters").distinct().collect()}
    for name in ("7", "q"):
        scale, theta, *_ = known[name]
        assert got[name]["status"] == "aligned" and got[name]["scale"] == pytest.approx(scale) and got[name]["theta"] == pytest.approx(theta) and got[name]["rmse"] < 1e-6
    assert got["lone"]["status"] == "too few clusters" and got["lone"]["scale"] is None and got["r"]["status"] == "reference"
    assert out.count() == 3 * 27 + 1
    here = out.filter("sample_id <> 'lone'").groupBy("cluster", F.round("x_aligned", 6).alias("x"), F.round("y_aligned", 6).alias("y")).count()
    assert here.count() == 27 and here.filter("count <> 3").isEmpty()


def test_cohort_sample_by_sample(spark, tmp_path):
    known = {"r": (1.0, 0.0, 0.0, 0.0), "p": (1.5, 0.7, 2.0, -1.0), "q": (0.5, -2.0, 0.0, 5.0)}
    points(spark, known).write.parquet(f"{tmp_path}/in")
    for s in ("p", "q"):
        register_cohort.run(spark, f"{tmp_path}/in", f"{tmp_path}/one", PLAIN | {"samples": [s]})
    register_cohort.run(spark, f"{tmp_path}/in", f"{tmp_path}/all", PLAIN)
    assert rows_of(register_cohort.result(spark, f"{tmp_path}/one")) == rows_of(register_cohort.result(spark, f"{tmp_path}/all"))
    with pytest.raises(ValueError, match="no points of the reference"):
        register_cohort.run(spark, f"{tmp_path}/in", f"{tmp_path}/all", PLAIN | {"reference": "none"})


def test_settings(tmp_path):
    assert json.loads(json.dumps(common.config_of(register_cohort.__file__)))["reference"] == "A"
    with pytest.raises(ValueError, match="no such settings"):
        common.config_of(register_cohort.__file__, {"refrence": "B"})


def test_intake_counts_within_a_row(spark):
    """Counting the words of a text shuffles nothing, and equals a plain count."""
    from collections import Counter

    texts = {"a": "b a B c a a", "b": "", "c": None, "d": "12 !?", "e": "x", "f": "z y z y z"}
    out = count_intake.count_features(spark.createDataFrame([("s", k, t) for k, t in texts.items()], "sample_id string, obs string, text string"), "[a-z]+")
    assert "Exchange" not in out._jdf.queryExecution().executedPlan().toString()
    want = {(k, g, float(n)) for k, t in texts.items() for g, n in Counter(w for w in (t or "").lower().split() if w.isalpha()).items()}
    assert {(r["obs"], r["gene"], r["value"]) for r in out.collect()} == want
