"""Contract checks: each is one aggregate or anti join; the driver sees flags and examples only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import barcode, complete


def id_mismatch(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids on one side only: key, side."""
    a = left.select(key).distinct().withColumn("l", F.lit(1))
    b = right.select(key).distinct().withColumn("r", F.lit(1))
    both = a.join(b, key, "full_outer").filter(F.col("l").isNull() | F.col("r").isNull())
    return both.select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def duplicates(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def missing(need: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    return need.select(*keys).distinct().join(have, keys, "left_anti")


def require_empty(df: DataFrame, what: str) -> None:
    """Raise with up to three examples if df has rows."""
    if found := df.limit(3).collect():
        raise ValueError(f"{what}: " + ", ".join(str(tuple(r)) for r in found))


def flags(obs: DataFrame) -> DataFrame:
    """One row of contract counts for points: rows, bad coordinates, null labels, samples, whether
    every cell type is filled."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf"))
    return obs.agg(F.count(F.lit(1)).alias("n"), F.count_if(~(finite("x") & finite("y"))).alias("bad_xy"), F.count_if(F.col("cluster").isNull()).alias("null_labels"), F.count_distinct("sample_id").alias("samples"), F.count_if(~complete(F.col("cluster"))).alias("incomplete"))


def check_points(obs: DataFrame, query: str, reference: str) -> None:
    if query == reference:
        raise ValueError("query and reference are the same sample")
    n, bad, null, samples, _ = flags(obs).first()
    if not n:
        raise ValueError("no observations")
    if bad or null:
        raise ValueError(f"{bad} rows without finite coordinates, {null} without a label")
    if samples < 2:
        raise ValueError("two samples are needed")


def canonical_barcodes(df: DataFrame, column: str) -> DataFrame:
    """Add `barcode`; an id without one, or a barcode twice, is an error."""
    out = df.withColumn("barcode", barcode(F.col(column)))
    require_empty(out.filter("barcode is null").select(column), "ids without a barcode")
    require_empty(duplicates(out, "barcode").select("barcode"), "barcodes that repeat")
    return out


def rename_roles(df: DataFrame, roles: dict[str, str]) -> DataFrame:
    """Rename user columns to their roles; two columns for one role are an error."""
    if len(set(roles.values())) != len(roles):
        raise ValueError("two columns for one role")
    if gone := set(roles) - set(df.columns):
        raise ValueError(f"no such columns: {sorted(gone)}")
    return df.withColumnsRenamed(roles)
