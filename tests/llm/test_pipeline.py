"""The pipeline's stages: columns, effect, empty tables, against the operators' own verdicts."""

import re
from collections import Counter

import corpus_pipeline

from .conftest import make


def test_stages(spark, docs, none, tmp_path):
    now, counts = docs, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, now, "").write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert out.columns == docs.columns
        now = out
        counts.append(now.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] < counts[2] and counts[4] >= 1
    mixed = Counter(r["doc_id"] for r in spark.read.parquet(f"{tmp_path}/mixture").collect())
    packed = Counter(r["doc_id"] for r in now.filter("piece = 0").collect())
    assert mixed == packed
    texts = [re.sub(r"\s", "", r["text"]) for r in spark.read.parquet(f"{tmp_path}/exact").collect()]
    assert len(texts) == len(set(texts))


def test_empty(spark, none, tmp_path):
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_all_rejected(spark, tmp_path):
    make(spark, [(1, "short", "en", "s"), (2, None, None, None)]).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_on_the_smallest_tables(spark, sf):
    out = corpus_pipeline.run(spark, sf)
    assert out.count() > 50 and out.groupBy("sequence_id").sum("length").filter("`sum(length)` > 4096").isEmpty()
