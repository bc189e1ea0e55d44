"""Views of the driver's tables in the shapes that the operators take."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def points(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as points of three samples and two clusters; no unique id."""
    return table(spark, d, "lineitem").select(F.col("l_returnflag").alias("sample_id"), F.col("l_linestatus").alias("cluster"), F.col("l_quantity").alias("x"), (F.col("l_extendedprice") / 1000).alias("y"))


THETA, SCALE, SHIFT = math.radians(18), 1.08, (0.8, -0.4)


def similar(spark: SparkSession, d: str, sample: str) -> DataFrame:
    """points of a sample with 15 block clusters; sample N is moved by a known similarity."""
    p = points(spark, d).filter(F.col("sample_id") == sample)
    p = p.withColumn("cluster", F.concat_ws("_", F.floor((F.col("x") - 1) / 10), F.floor(F.col("y") / 35)))
    if sample != "N":
        return p
    x, y, c, s = F.col("x") - SHIFT[0], F.col("y") - SHIFT[1], math.cos(THETA), math.sin(THETA)
    return p.withColumn("xr", (x * c + y * s) / SCALE).withColumn("yr", (y * c - x * s) / SCALE).select("sample_id", "cluster", F.col("xr").alias("x"), F.col("yr").alias("y"))


def parts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("x"), F.col("p_retailprice").alias("y"), F.col("p_type").alias("cluster"), F.col("p_brand").alias("sample_id"))


def counts(spark: SparkSession, d: str) -> DataFrame:
    """lineitem as a long expression table: obs = order, gene = supplier modulo 40."""
    li = table(spark, d, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("obs"), F.concat(F.lit("g"), F.col("l_suppkey") % 40).alias("gene")).agg(F.sum("l_quantity").alias("value"))


def raster(spark: SparkSession, d: str) -> DataFrame:
    """Point counts of lineitem clusters on a 25 x 27 grid."""
    from .operators.raster import histogram

    p = points(spark, d).withColumn("cluster", F.concat_ws("_", "sample_id", "cluster"))
    return histogram(p, 1.0, 0.0, 4.0, 13, 27)


def masks(spark: SparkSession, d: str, key: str) -> DataFrame:
    """part as masks of occupied pixels, by a column."""
    p = table(spark, d, "part")
    return p.select(F.col(key).alias("mask"), (F.floor((F.col("p_retailprice") - 900) / 4)).cast("int").alias("iy"), F.floor(F.col("p_size") / 2).cast("int").alias("ix")).distinct()


SQL_POINTS = "SELECT l_returnflag AS sample_id, l_linestatus AS cluster, l_quantity AS x, l_extendedprice / 1000 AS y FROM lineitem"
SQL_PARTS = "SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS x, p_retailprice AS y, p_type AS cluster, p_brand AS sample_id FROM part"
SQL_COUNTS = "SELECT l_orderkey AS obs, 'g' || (l_suppkey % 40) AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"
SQL_RASTER = "SELECT sample_id || '_' || cluster AS cluster, CASE WHEN y = 108.0 THEN 26 ELSE floor(y / 4) END::BIGINT AS iy, CASE WHEN x = 53.0 THEN 12 ELSE floor((x - 1) / 4) END::BIGINT AS ix, count(*) AS v FROM pts WHERE x BETWEEN 1 AND 53 AND y BETWEEN 0 AND 108 GROUP BY 1, 2, 3"


def sql_similar() -> str:
    c, s = repr(math.cos(THETA)), repr(math.sin(THETA))
    base = f"SELECT *, floor((x - 1) / 10)::BIGINT || '_' || floor(y / 35)::BIGINT AS k FROM ({SQL_POINTS})"
    x, y = f"(x - {SHIFT[0]!r})", f"(y - ({SHIFT[1]!r}))"
    return f"ref AS (SELECT k AS cluster, x, y FROM ({base}) WHERE sample_id = 'A'), qry AS (SELECT k AS cluster, ({x} * {c} + {y} * {s}) / {SCALE} AS x, ({y} * {c} - {x} * {s}) / {SCALE} AS y FROM ({base}) WHERE sample_id = 'N')"


def sql_masks(key: str) -> str:
    return f"SELECT DISTINCT {key} AS mask, floor((p_retailprice - 900) / 4)::INT AS iy, floor(p_size / 2.0)::INT AS ix FROM part"
