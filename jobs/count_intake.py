"""Take new observations into count tables as their files arrive, with quality control.

An observation is a row of text with an id and a sample; its features are the text's words, counted
as transcripts of genes are. The job follows a folder of Parquet files as a file stream with a
checkpoint: a run takes the files that earlier runs have not seen, in batches, and ends. `documents`
is a folder or a glob (of a single file too: file streams take no plain file). Written are

  counts/batch=.../sample_id=...         obs, gene, value
  observations/batch=.../sample_id=...   obs, counts, genes, control, kept (by quality control)
  support/batch=.../sample_id=...        gene, detected_spots, total_counts over kept observations

Support adds up over batches, so growing input costs its new rows only. A batch that is repeated after
a failure replaces its own partitions. Observations that an earlier batch holds are skipped; an id
twice in one batch is an error, a row without id is left out.

    spark-submit jobs/count_intake.py --documents DIR --output OUT --checkpoint CP [--config FILE]"""

from __future__ import annotations

import os
import sys

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import config_of, log, main, replace  # noqa: E402
from sparkloom.operators import contracts, expression  # noqa: E402

SCHEMAS = {
    "counts": "obs string, gene string, value double, batch long, sample_id string",
    "observations": "obs string, counts double, genes long, control double, kept boolean, batch long, sample_id string",
    "support": "gene string, detected_spots long, total_counts double, batch long, sample_id string",
}
AZ, az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{output}/{name}")


def counted(rows: DataFrame, pattern: str) -> DataFrame:
    """rows (sample_id, obs, text), text by its features: an array of gene and value, in the row itself.
    The words of a text are sorted, so those that are equal are a run of places."""
    words = F.sort_array(F.regexp_extract_all(F.translate(F.coalesce("text", F.lit("")), AZ, az), F.lit(pattern), F.lit(0)))
    rows = rows.select("sample_id", "obs", words.alias("words")).withColumn("n", F.size("words"))
    places = F.when(F.col("n") > 0, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array().cast("array<int>"))
    rows = rows.withColumn("first", F.filter(places, lambda i: (i == 0) | (F.get("words", i) != F.get("words", i - 1))))
    after = F.concat(F.slice("first", 2, F.greatest(F.size("first"), F.lit(1))), F.array("n"))
    runs = F.transform(F.arrays_zip(F.col("first").alias("a"), after.alias("b")), lambda r: F.struct(F.get("words", r["a"]).alias("gene"), (r["b"] - r["a"]).cast("double").alias("value")))
    return rows.select("sample_id", "obs", F.when(F.col("n") > 0, runs).otherwise(F.slice(runs, 1, 0)).alias("features"))


def count_features(rows: DataFrame, pattern: str) -> DataFrame:
    """sample_id, obs, gene, value of rows (sample_id, obs, text)."""
    return long_form(counted(rows, pattern))


def long_form(rows: DataFrame) -> DataFrame:
    return rows.select(*[c for c in rows.columns if c != "features"], F.explode("features").alias("f")).select("*", "f.*").drop("f")


def take(batch: DataFrame, number: int, c: dict, output: str) -> None:
    """One batch: its new observations into the three tables. An observation is one row until it is
    written, so neither its counts nor its quality need a join or a shuffle of single counts."""
    spark = batch.sparkSession
    sample = F.coalesce(F.col(c["sample"]).cast("string"), F.lit("unknown"))
    rows = batch.select(sample.alias("sample_id"), F.col(c["observation"]).cast("string").alias("obs"), F.col(c["text"]).alias("text")).filter("obs IS NOT NULL")
    contracts.require_empty(contracts.duplicates(rows.select("obs"), "obs"), f"observations that repeat in batch {number}")
    known = table(spark, output, "observations").filter(F.col("batch") != number).select("obs")
    total = lambda ok: F.aggregate(F.filter("features", lambda f: ok(f["gene"].isin(*c["controls"]))), F.lit(0.0), lambda s, f: s + f["value"])
    fresh = counted(rows.join(known, "obs", "left_anti").repartition("obs"), c["feature"]).withColumn("batch", F.lit(number).cast("long"))
    fresh = fresh.withColumns({"counts": total(lambda control: ~control), "control": total(lambda control: control), "genes": F.size(F.filter("features", lambda f: ~f["gene"].isin(*c["controls"]))).cast("long")})
    passed = expression.passes("counts", "genes", "control", F.col("counts") + F.col("control"), c["least_counts"], c["least_features"], c["most_control"])
    fresh = fresh.withColumn("kept", (F.size("features") > 0) & passed).persist(StorageLevel.DISK_ONLY)
    try:
        replace(fresh.select("sample_id", "obs", "features", "batch"), f"{output}/counts", "batch", "sample_id", files=c["files"], then=long_form, key=("obs",))
        support = expression.gene_support(long_form(fresh.filter("kept").select("batch", "sample_id", "features")), by=("batch", "sample_id"))
        replace(support, f"{output}/support", "batch", "sample_id", files=c["files"])
        # last, as what is kept of fresh was read beside this table and ends when it changes
        replace(fresh.drop("features"), f"{output}/observations", "batch", "sample_id", files=c["files"])
    finally:
        fresh.unpersist()
    written = lambda name: table(spark, output, name).filter(F.col("batch") == number)
    n, kept = written("observations").agg(F.count(F.lit(1)), F.count_if("kept")).first()
    log.info("count_intake batch %s: read %s rows, wrote %s observations (%s kept), %s counts", number, batch.count(), n, kept, written("counts").count())


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict | None = None) -> None:
    """Take what is new under `documents`, and end when all of it is taken."""
    c = config_of(__file__, settings)
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.mode("ignore").partitionBy("batch", "sample_id").parquet(f"{output}/{name}")
    stream = spark.readStream.schema(spark.read.parquet(documents).schema).option("maxFilesPerTrigger", c["files_per_batch"]).parquet(documents)
    query = stream.writeStream.foreachBatch(lambda batch, number: take(batch, number, c, output)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("count_intake has taken all of %s", documents)


def result(spark: SparkSession, output: str) -> DataFrame:
    """The tables as they stand: an observation a row, and the support of each sample's genes."""
    seen = table(spark, output, "observations").select(F.lit("observation").alias("kind"), "sample_id", F.col("obs").alias("name"), "counts", "genes", "kept")
    support = table(spark, output, "support").groupBy("sample_id", "gene").agg(F.sum("total_counts").alias("counts"), F.sum("detected_spots").alias("genes"))
    return seen.unionByName(support.select(F.lit("gene").alias("kind"), "sample_id", F.col("gene").alias("name"), "counts", "genes", F.lit(True).alias("kept")))


if __name__ == "__main__":
    main(run, __doc__, ["documents", "output", "checkpoint"])
