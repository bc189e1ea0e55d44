"""Expression tables in long form (obs, gene, value), zeros implicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gene_support(expr: DataFrame, genes: list[str] | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """Per gene (and `by`, such as the sample) the observations with a value over 0 and the total;
    requested genes keep order."""
    out = expr.groupBy(*by, "gene").agg(F.count_if(F.col("value") > 0).alias("detected_spots"), F.sum("value").alias("total_counts"))
    if genes is None:
        return out
    if len(set(genes)) != len(genes):
        raise ValueError("requested genes are not unique")
    want = expr.sparkSession.createDataFrame(list(enumerate(genes)), "ord int, gene string")
    return F.broadcast(want).join(out, "gene", "left").fillna(0, ["detected_spots", "total_counts"]).orderBy("ord")


def missing_genes(expr: DataFrame, genes: list[str]) -> DataFrame:
    want = expr.sparkSession.createDataFrame([(g,) for g in genes], "gene string")
    return F.broadcast(want).join(expr.select("gene").distinct(), "gene", "left_anti")


def library_normalise(expr: DataFrame, n_obs: int, target: float, least: float = 0.01) -> DataFrame:
    """Scale observations to `target` over genes detected in at least `least` of n_obs; negatives
    become 0, observations without counts 0, other genes stay. Adds `norm`. Gene detection is a
    small aggregate; the library size is one shuffle on obs."""
    wide = expr.groupBy("gene").agg((F.count_if(F.col("value") > 0) >= least * n_obs).alias("used"))
    rows = expr.join(wide, "gene")
    v = F.when(F.col("used"), F.greatest(F.col("value"), F.lit(0.0))).otherwise(F.lit(0.0))
    lib = F.sum(v).over(Window.partitionBy("obs"))
    return rows.withColumn("lib", lib).withColumn("norm", F.when(~F.col("used"), F.col("value")).when(F.col("lib") > 0, v * target / F.col("lib")).otherwise(F.lit(0.0)))


def log1p_normalise(expr: DataFrame, target: float = 1e4) -> DataFrame:
    lib = F.sum("value").over(Window.partitionBy("obs"))
    return expr.withColumn("norm", F.log1p(F.when(lib > 0, F.col("value") * target / lib).otherwise(F.lit(0.0))))


def shared_genes(expr: DataFrame) -> DataFrame:
    """Genes that every sample has. expr: sample_id, gene."""
    n = expr.agg(F.count_distinct("sample_id").alias("n"))
    per = expr.groupBy("gene").agg(F.count_distinct("sample_id").alias("k"))
    return per.join(F.broadcast(n), F.col("k") == F.col("n")).select("gene")


def union_zero_fill(expr: DataFrame, obs: DataFrame) -> DataFrame:
    """Dense rows of all genes for given observations (sample_id, obs): absent values are 0. For
    narrow panels; stays long elsewhere."""
    genes = expr.select("gene").distinct()
    grid = obs.join(F.broadcast(genes))
    return grid.join(expr, ["sample_id", "obs", "gene"], "left").fillna(0.0, ["value"])


def variance_ranking(expr: DataFrame, n_obs: int, fraction: float = 0.9, least: int = 1) -> DataFrame:
    """Genes by population variance (implicit zeros count) up to the first rank that reaches the
    fraction of the total, at least `least`."""
    m = F.sum("value") / n_obs
    var = expr.groupBy("gene").agg((F.sum(F.col("value") * F.col("value")) / n_obs - m * m).alias("variance"))
    w = Window.orderBy(F.desc("variance"), "gene")  # one row a gene
    ranked = var.withColumn("rank", F.row_number().over(w)).withColumn("cum", F.sum("variance").over(w)).withColumn("total", F.sum("variance").over(Window.partitionBy()))
    return ranked.filter((F.coalesce(F.col("cum") - F.col("variance"), F.lit(0.0)) < fraction * F.col("total")) | (F.col("rank") <= least)).select("gene", "variance", "rank", (F.col("cum") / F.col("total")).alias("fraction"))


def pseudobulk(expr: DataFrame, clusters: DataFrame) -> DataFrame:
    """Mean log1p value per cluster and gene, zeros included. clusters: obs, cluster."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    sums = expr.join(clusters, "obs").groupBy("cluster", "gene").agg(F.sum(F.log1p("value")).alias("s"))
    return sums.join(sizes, "cluster").select("cluster", "gene", (F.col("s") / F.col("n")).alias("mean_log1p"))


def count_like(expr: DataFrame) -> DataFrame:
    """Genes whose values look like counts: no negatives and the 99 % quantile of the distance to
    the nearest integer (half to even) under 1e-6."""
    off = F.abs(F.col("value") - F.rint("value"))
    return expr.groupBy("gene").agg(((F.percentile(off, F.lit(0.99)) < 1e-6) & (F.min("value") >= 0)).alias("is_count"))


def public_expression(expr: DataFrame, n_obs: int, least: float = 0.001) -> DataFrame:
    """Genes with finite values of at least 0, over 0 in at least `least` of observations."""
    v = F.col("value")
    ok = F.bool_and(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))) & (F.min(v) >= 0) & (F.count_if(v > 0) >= least * n_obs)
    return expr.groupBy("gene").agg(ok.alias("is_expression"))


def quality_control(expr: DataFrame, counts: float = 20, genes: int = 10, control: float = 0.05) -> DataFrame:
    """Observations with enough counts and genes and few control counts. expr has is_control."""
    c = F.col("is_control")
    agg = expr.groupBy("obs").agg(F.sum(F.when(~c, F.col("value"))).alias("counts"), F.count_if(~c & (F.col("value") > 0)).alias("genes"), F.sum(F.when(c, F.col("value")).otherwise(0.0)).alias("control"), F.sum("value").alias("total"))
    return agg.filter(passes("counts", "genes", "control", F.col("total"), counts, genes, control))


def passes(n: str, genes: str, control: str, total: Column, least: float, least_genes: int, most: float) -> Column:
    """Whether columns of one observation pass quality control."""
    return (F.col(n) >= least) & (F.col(genes) >= least_genes) & (F.col(control) <= most * total)
