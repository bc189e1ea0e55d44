"""Register every sample of a cohort to one reference sample by the clusters they share.

Reads points (Parquet) through the column expressions of the config, leaves out points without finite
coordinates or a label, fits one similarity for each sample to the reference's centroids and writes

  points/sample_id=...   cluster, x, y, x_aligned, y_aligned (null where a sample has no fit)
  fits/sample_id=...     status, clusters, scale, theta, tx, ty, mirror, rmse_before, rmse

A run replaces the samples that it reads and leaves others, so a cohort can be registered sample by
sample, and running again gives the same tables.

    spark-submit jobs/register_cohort.py --points lineitem.parquet --output OUT [--config FILE]"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from jobs.common import config_of, log, main, replace  # noqa: E402
from sparkloom.functions.columns import complete  # noqa: E402
from sparkloom.operators import geometry  # noqa: E402

FIT = ["scale", "theta", "tx", "ty", "mirror"]


def usable(points: DataFrame) -> DataFrame:
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return points.filter(F.col("sample_id").isNotNull() & complete(F.col("cluster")) & finite("x") & finite("y"))


def fits(points: DataFrame, reference: str, least_points: int, least_clusters: int, reflection: bool) -> DataFrame:
    """One row a sample: the similarity to the reference, weighted by the smaller cluster, and the
    root mean square distance of shared centroids before and after. The reference is the identity.
    Numbers are rounded to ten places, so that the order of a sum does not tell one run from another."""
    centres = geometry.centroids(points, least_points)
    r = centres.filter(F.col("sample_id") == reference).select("cluster", F.col("cx").alias("rx"), F.col("cy").alias("ry"), F.col("n").alias("rn"))
    q = centres.filter(F.col("sample_id") != reference).select("sample_id", "cluster", F.col("cx").alias("qx"), F.col("cy").alias("qy"), F.col("n").alias("qn"))
    pairs = q.join(r, "cluster").withColumn("w", F.least("qn", "rn").cast("double"))
    found = geometry.procrustes_by(pairs, ["sample_id"], F.col("w"), reflection).filter(F.col("n") >= least_clusters)
    every = points.select("sample_id").distinct()
    is_reference = F.col("sample_id") == reference
    status = F.when(is_reference, "reference").when(F.col("scale").isNotNull(), "aligned").otherwise("too few clusters")
    one = {"scale": 1.0, "theta": 0.0, "tx": 0.0, "ty": 0.0, "mirror": 1.0, "rmse_before": 0.0, "rmse": 0.0}
    out = every.join(found, "sample_id", "left").withColumn("status", status)
    return out.select("sample_id", "status", F.coalesce("n", F.lit(0)).cast("long").alias("clusters"), *[F.when(is_reference, F.lit(v)).otherwise(F.round(c, 10)).alias(c) for c, v in one.items()])


def run(spark: SparkSession, points: str, output: str, settings: dict | None = None) -> None:
    c = config_of(__file__, settings)
    rows = spark.read.parquet(points).select(*[F.expr(e).alias(name) for name, e in c["columns"].items()])
    rows = rows.withColumns({"sample_id": F.col("sample_id").cast("string"), "cluster": F.col("cluster").cast("string"), "x": F.col("x").cast("double"), "y": F.col("y").cast("double")})
    if c["samples"]:
        rows = rows.filter(F.col("sample_id").isin(*c["samples"], c["reference"]))
    if rows.filter(F.col("sample_id") == c["reference"]).isEmpty():
        raise ValueError(f"no points of the reference {c['reference']}")
    fit = fits(usable(rows), c["reference"], c["least_points"], c["least_clusters"], c["reflection"])
    replace(fit, f"{output}/fits", "sample_id")
    fit = spark.read.parquet(f"{output}/fits").withColumn("sample_id", F.col("sample_id").cast("string"))
    read, wrote = Observation("read"), Observation("wrote")
    used = usable(rows.observe(read, F.count(F.lit(1)).alias("n")))
    py = F.col("y") * F.col("mirror")
    moved = used.join(fit.select("sample_id", *FIT), "sample_id").select(
        "sample_id", "cluster", "x", "y",
        (F.col("scale") * (F.cos("theta") * F.col("x") - F.sin("theta") * py) + F.col("tx")).alias("x_aligned"),
        (F.col("scale") * (F.sin("theta") * F.col("x") + F.cos("theta") * py) + F.col("ty")).alias("y_aligned"),
    )
    replace(moved.observe(wrote, F.count(F.lit(1)).alias("n")), f"{output}/points", "sample_id", files=c["files"])
    log.info("register_cohort read %s points from %s, wrote %s to %s/points", read.get["n"], points, wrote.get["n"], output)
    for r in fit.groupBy("status").count().collect():  # at most three rows
        log.info("register_cohort: %s samples %s", r["count"], r["status"])


def result(spark: SparkSession, output: str) -> DataFrame:
    """The written points, each with its sample's fit."""
    # a partition's name would else be read back as a number where it looks like one
    points = spark.read.schema("cluster string, x double, y double, x_aligned double, y_aligned double, sample_id string").parquet(f"{output}/points")
    fits_ = spark.read.schema(f"status string, clusters long, {', '.join(f'{c} double' for c in FIT)}, rmse_before double, rmse double, sample_id string").parquet(f"{output}/fits")
    return points.join(fits_.select("sample_id", "status", "clusters", "scale", "theta", "rmse_before", "rmse"), "sample_id")


if __name__ == "__main__":
    main(run, __doc__, ["points", "output"])
