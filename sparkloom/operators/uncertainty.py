"""Variability of points over replicate transforms (repeat, point, x, y)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def point_spread(reps: DataFrame) -> DataFrame:
    """Per point: n, means, variances (one replicate: 0), and the mean, variance and maximum of the
    distance to the mean. Two aggregates over one shuffle key."""
    m = reps.groupBy("point").agg(F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"))
    d = F.hypot(F.col("x") - F.col("mean_x"), F.col("y") - F.col("mean_y"))
    var = lambda c: F.coalesce(F.var_samp(c), F.lit(0.0))
    s = reps.join(m, "point").withColumn("d", d).groupBy("point", "mean_x", "mean_y").agg(F.count(F.lit(1)).alias("n"), var("x").alias("var_x"), var("y").alias("var_y"), F.avg("d").alias("dist_mean"), var("d").alias("dist_var"), F.max("d").alias("dist_max"))
    return s.withColumn("std_total", F.sqrt(F.col("var_x") + F.col("var_y")))


def fixed_support(reps: DataFrame) -> DataFrame:
    """The rows of points that every replicate has. reps: repeat, point, ..."""
    n = reps.agg(F.count_distinct("repeat").alias("all"))
    seen = reps.groupBy("point").agg(F.count_distinct("repeat").alias("has")).join(F.broadcast(n), F.col("has") == F.col("all")).select("point")
    return reps.join(seen, "point", "left_semi")


def modal_label(reps: DataFrame) -> DataFrame:
    """Most frequent label of a point, the smallest of equals. reps has label."""
    c = reps.groupBy("point", "label").agg(F.count(F.lit(1)).alias("c"))
    return c.withColumn("rn", F.row_number().over(Window.partitionBy("point").orderBy(F.desc("c"), "label"))).filter("rn = 1").select("point", "label")


def report(df: DataFrame, value: str) -> DataFrame:
    """median, p95, max and how many reach p95."""
    q = df.agg(F.median(value).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max"))
    return df.join(F.broadcast(q)).groupBy("median", "p95", "max").agg(F.count_if(F.col(value) >= F.col("p95")).alias("n_tail"))
