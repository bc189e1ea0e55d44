"""Rows that are made from one row of a file are still rows of their own."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import common, exact_dedup, line_dedup, mixing, near_dedup

WAYS = ["explode", "join", "union", "path twice", "nested path", "view"]


@pytest.fixture(scope="module")
def at(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("ids")) + "/docs"
    rows = [(i, f"text number {i} of {i % 4} " * 8, f"s{i % 2}") for i in range(30)] + [(99, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2).write.parquet(path)
    return path


def twice(spark, at, way):
    docs = spark.read.parquet(at)
    if way == "explode":
        return docs.withColumn("z", F.explode(F.array(F.lit(1), F.lit(2)))).drop("z")
    if way == "join":
        return docs.join(spark.createDataFrame([(0, 1), (1, 2), (0, 3), (1, 4)], "k int, z int"), F.coalesce(docs.doc_id % 2, F.lit(0)) == F.col("k")).drop("k", "z")
    if way == "union":
        return docs.union(docs)
    if way == "path twice":
        return spark.read.parquet(at, at)
    if way == "nested path":
        one = [r[0] for r in docs.select("_metadata.file_path").distinct().collect()]
        return spark.read.parquet(*one, *one)
    docs.union(docs).createOrReplaceTempView("docs_twice")
    return spark.table("docs_twice")


@pytest.mark.parametrize("way", WAYS)
def test_ids_are_unique(spark, at, way):
    docs = twice(spark, at, way)
    assert docs.count() == 62
    ids = common.with_row_id(docs, "rid")
    assert ids.select("rid").distinct().count() == 62
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == 62 and all(r["group_size"] == 2 for r in got) and sum(r["kept"] for r in got) == 31
    assert exact_dedup.drop_copies(docs).count() == 31


def test_plain_scans_keep_their_places(spark, at):
    docs = spark.read.parquet(at)
    assert common.is_scan(docs) and common.is_scan(docs.select("doc_id", "text").filter("doc_id > 3"))
    docs.createOrReplaceTempView("docs_once")
    assert common.is_scan(spark.table("docs_once"))
    assert not common.is_scan(docs.filter(F.rand() > 0.5)) and not common.is_scan(spark.range(3))
    clash = docs.withColumn("_metadata", F.lit(1))
    assert common.with_row_id(clash, "rid").select("rid").distinct().count() == 31


@pytest.mark.parametrize("way", ["join", "path twice"])
def test_other_callers(spark, at, way):
    docs = twice(spark, at, way)
    near = near_dedup.near_dedup(docs).collect()
    assert len(near) == 62 and all(n == 1 for n in Counter(r["component_id"] for r in near if r["kept"] and r["n_shingles"]).values())
    kept = near_dedup.drop_near(docs, 2).count()
    assert kept == sum(r["kept"] for r in near)
    whole = mixing.mix(docs).groupBy().sum("copies").first()[0]
    assert mixing.take_mix(docs).count() == whole
    lines = line_dedup.line_dedup(docs, 2).collect()
    assert len(lines) == 62 and all(r["n_dropped"] == 1 for r in lines if r["doc_id"] != 99)


def test_ids_as_bits(spark, tmp_path, monkeypatch):
    """Where ids are too many to broadcast, their bits find the same rows; else all are hashed."""
    rows = [(i, f"twice {i // 2}" if i < 4000 else f"once {i}") for i in range(5000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    ids = common.cut(common.with_row_id(docs, "rid").filter("doc_id % 3 = 0").select("rid"))
    want = sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect())
    assert len(want) == 3000
    for most, left in ((64 << 10, True), (1, False)):
        monkeypatch.setattr(common, "BROADCAST_BYTES", most)
        assert not common.fits(ids) and common.fits(common.row_bits(ids)) == left
        alive = common.only_rows(common.with_row_id(docs, "rid"), "rid", ids)
        assert (alive is not None) == left
        if left:
            assert sorted(alive.columns) == ["doc_id", "rid", "text"]
            assert sorted(r["doc_id"] for r in alive.collect()) == list(range(0, 5000, 3))
            plan = alive._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
        gone = common.without_rows(common.with_row_id(docs, "rid"), "rid", ids)
        assert sorted(r["doc_id"] for r in gone.collect()) == [i for i in range(5000) if i % 3]
        assert sorted(r["doc_id"] for r in exact_dedup.drop_copies(docs).collect()) == want
        assert sum(r["kept"] for r in exact_dedup.exact_dedup(docs).collect()) == 3000
