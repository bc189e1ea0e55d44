"""Robust statistics, multiple testing, rankings and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import acat_p, acat_term


def bh(tests: DataFrame, by: list[str]) -> DataFrame:
    """Benjamini-Hochberg q within groups, over finite p; others get null. Adds q."""
    ok = F.col("p").isNotNull() & ~F.isnan("p")
    w = Window.partitionBy(*by, "__ok").orderBy("p")
    n = F.count(F.lit(1)).over(Window.partitionBy(*by, "__ok"))
    raw = tests.withColumn("__ok", ok).withColumn("__r", F.rank().over(w) + F.count(F.lit(1)).over(Window.partitionBy(*by, "__ok", "p")) - 1)
    raw = raw.withColumn("__a", F.col("p") * n / F.col("__r"))
    back = Window.partitionBy(*by, "__ok").orderBy(F.desc("p")).rangeBetween(Window.unboundedPreceding, 0)
    return raw.withColumn("q", F.when(F.col("__ok"), F.least(F.lit(1.0), F.min("__a").over(back)))).drop("__ok", "__r", "__a")


def acat(tests: DataFrame, by: list[str], weight: Column | None = None) -> DataFrame:
    """Cauchy combination of 0 < p < 1: by..., p, n."""
    ok = tests.filter((F.col("p") > 0) & (F.col("p") < 1))
    w = F.lit(1.0) if weight is None else weight
    return ok.groupBy(*by).agg((F.sum(w * acat_term(F.col("p"))) / F.sum(w)).alias("t"), F.count(F.lit(1)).alias("n")).select(*by, acat_p(F.col("t")).alias("p"), "n")


def gene_acat(tests: DataFrame) -> DataFrame:
    """Two levels: contrasts of a gene, then genes, weighted by the number of valid tests."""
    per = acat(tests, ["gene", "contrast"])
    return per.groupBy("gene").agg((F.sum(F.col("n") * acat_term(F.col("p"))) / F.sum("n")).alias("t"), F.sum("n").alias("n_tests")).select("gene", acat_p(F.col("t")).alias("p"), "n_tests")


def mad_standardise(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(x - median) / (1.4826 MAD) within groups; a scale under 1e-8 gives 0. Adds z."""
    med = df.groupBy(*by).agg(F.median(value).alias("__m"))
    rows = df.join(med, by)
    mad = rows.groupBy(*by).agg((1.4826 * F.median(F.abs(F.col(value) - F.col("__m")))).alias("__s"))
    rows = rows.join(mad, by)
    return rows.withColumn("z", F.when(F.col("__s") < 1e-8, F.lit(0.0)).otherwise((F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def standardise(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(x - mean) / sample deviation within groups; under 1e-8 or a single row gives 0. Adds z."""
    s = df.groupBy(*by).agg(F.avg(value).alias("__m"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("__s"))
    return df.join(s, by).withColumn("z", F.when(F.col("__s") < 1e-8, F.lit(0.0)).otherwise((F.col(value) - F.col("__m")) / F.col("__s"))).drop("__m", "__s")


def ecdf(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    return df.withColumn("ecdf", F.cume_dist().over(Window.partitionBy(*by).orderBy(value)))


def percent_rank_average(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Average rank over n, ascending. Without groups, ranks come from the counts of distinct values,
    summed within and over ranges of values, so that no task holds all rows."""
    if not by:
        return _percent_rank_all(df, value)
    part = Window.partitionBy(*by)
    r = F.rank().over(part.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*by, value)) - 1) / 2
    return df.withColumn("pct", r / F.count(F.lit(1)).over(part))


def _percent_rank_all(df: DataFrame, value: str, ranges: int = 200) -> DataFrame:
    """percent_rank_average over all rows: null first, as a window orders it."""
    cuts = df.agg(F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 10000).alias("__cuts"))  # one row
    per = df.groupBy(value).agg(F.count(F.lit(1)).alias("__c")).join(F.broadcast(cuts))
    ranged = per.withColumn("__part", F.when(F.col(value).isNull(), F.lit(-1)).otherwise(F.size(F.filter(F.coalesce("__cuts", F.array()), lambda x: x < F.col(value))))).drop("__cuts")
    sizes = ranged.groupBy("__part").agg(F.sum("__c").alias("__n"))  # a row a range
    before = F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(sizes.select("__part", before.alias("__o"), F.sum("__n").over(Window.partitionBy()).alias("__all")))
    within = F.coalesce(F.sum("__c").over(Window.partitionBy("__part").orderBy(F.asc_nulls_first(value)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = ranged.withColumn("__w", within).join(offsets, "__part").select(F.col(value).alias("__v"), ((F.col("__o") + F.col("__w") + 1 + (F.col("__c") - 1) / 2) / F.col("__all")).alias("pct"))
    return df.join(ranks, F.col(value).eqNullSafe(F.col("__v"))).drop("__v")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)


def cumulative_keep(df: DataFrame, by: list[str], value: str, order: list, fraction: float, most: int) -> DataFrame:
    """Rows in order until their sum reaches the fraction of the group's, at most `most`."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(value).over(w), F.lit(0.0))
    rn = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    rows = df.withColumn("__b", before).withColumn("rank", rn).withColumn("__t", F.sum(value).over(Window.partitionBy(*by)))
    return rows.filter((F.col("__b") < fraction * F.col("__t")) & (F.col("rank") <= most)).drop("__b", "__t")


def entropy(df: DataFrame, by: str, batch: str) -> DataFrame:
    """Batch entropy (log2) of each group, and n."""
    c = df.groupBy(by, batch).agg(F.count(F.lit(1)).alias("c"))
    p = F.col("c") / F.sum("c").over(Window.partitionBy(by))
    return c.withColumn("p", p).groupBy(by).agg((-F.sum(F.col("p") * F.log2("p"))).alias("entropy"), F.sum("c").alias("n"))


def isotonic(bins: DataFrame) -> DataFrame:
    """Weighted nondecreasing fit of bins (i, y, w), at most a few dozen, which one row holds in
    order: a fold adds each bin as a block and joins blocks while the last is below the one before.
    Adds fit; more than 4096 bins raise an error."""
    held = F.array_sort(F.collect_list(F.struct("i", F.col("y").cast("double").alias("y"), F.col("w").cast("double").alias("w"))))
    few = F.when(F.count(F.lit(1)) > 4096, F.raise_error(F.lit("isotonic takes at most 4096 bins"))).otherwise(held)
    block = "struct<first:int,s:double,w:double>"
    last = lambda a: F.element_at(a, -1)
    mean = lambda b: b["s"] / b["w"]
    joined = lambda a, b: F.struct(a["first"].alias("first"), (a["s"] + b["s"]).alias("s"), (a["w"] + b["w"]).alias("w"))

    def push(state, x):
        """The blocks after bin x: walking back, x's block takes each block whose mean is not below
        its own; `open` ends the walk."""
        new = F.struct(x["at"].alias("first"), (x["y"] * x["w"]).alias("s"), x["w"].alias("w"))
        start = F.struct(new.alias("b"), F.size(state).alias("keep"), F.lit(True).alias("open"))

        def back(t, p):
            take = t["open"] & (mean(p) >= mean(t["b"]))
            return F.when(take, F.struct(joined(p, t["b"]).alias("b"), (t["keep"] - 1).alias("keep"), F.lit(True).alias("open"))).otherwise(F.struct(t["b"].alias("b"), t["keep"].alias("keep"), F.lit(False).alias("open")))

        end = F.aggregate(F.reverse(state), start, back)
        return F.concat(F.slice(state, F.lit(1), end["keep"]), F.array(end["b"]))

    at = F.transform("__b", lambda x, k: F.struct(k.cast("int").alias("at"), x["y"].alias("y"), x["w"].alias("w")))
    one = bins.agg(few.alias("__b")).select("__b", F.aggregate(at, F.array().cast(f"array<{block}>"), push).alias("__f"))
    fits = one.select(F.posexplode("__b").alias("__k", "__x"), "__f")
    fit = fits.select(F.col("__x.i").alias("i"), mean(last(F.filter("__f", lambda b: b["first"] <= F.col("__k")))).alias("fit"))
    return bins.join(fit, "i")


def second_difference(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(order)
    return df.withColumn("curvature", F.lead(value, 2).over(w) - 2 * F.lead(value, 1).over(w) + F.col(value))


def rolling_median(df: DataFrame, by: list[str], order: str, value: str, half: int = 1) -> DataFrame:
    """Centred rolling median: windows are of a few rows and collected in order."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-half, half)
    s = F.array_sort(F.collect_list(value).over(w))
    n = F.size(s)
    lo, hi = F.get(s, F.floor((n - 1) / 2).cast("int")), F.get(s, F.floor(n / 2).cast("int"))
    return df.withColumn("smooth", (lo + hi) / 2)


def sequential_contrasts(samples: DataFrame, reference: str) -> DataFrame:
    """Each sample against the one before it in `ord`; the first against the reference."""
    before = F.lag("sample_id").over(Window.orderBy("ord"))  # one row a sample
    return samples.filter(F.col("sample_id") != reference).select("sample_id", "ord", F.coalesce(before, F.lit(reference)).alias("against"))


def age_coverage(cover: DataFrame, bandwidth: float, tau: float = 0.05, floor: float = 1e-3) -> DataFrame:
    """Support precision of a grid cell's coverage against other samples of near age: a Gaussian
    age kernel gives their mean and deviation; the logistic of 1.702 z, over its sample's mean,
    clipped to [floor, 1]. cover: grid, sample_id, age, c."""
    o = cover.select("grid", F.col("sample_id").alias("os"), F.col("age").alias("oa"), F.col("c").alias("oc"))
    pairs = cover.join(o, "grid").filter("sample_id <> os")
    w = F.exp(-0.5 * F.pow((F.col("age") - F.col("oa")) / bandwidth, 2))
    s = pairs.withColumn("w", w).groupBy("grid", "sample_id", "c").agg(F.sum("w").alias("sw"), F.sum(F.col("w") * F.col("oc")).alias("swx"), F.sum(F.col("w") * F.col("oc") * F.col("oc")).alias("swxx"))
    mean = F.col("swx") / F.col("sw")
    sd = F.sqrt(F.greatest(F.col("swxx") / F.col("sw") - mean * mean, F.lit(0.0)))
    rows = s.withColumn("p", 1 / (1 + F.exp(-1.702 * (F.col("c") - mean) / F.greatest(sd, F.lit(tau)))))
    avg = F.avg("p").over(Window.partitionBy("sample_id"))
    return rows.withColumn("precision", F.least(F.lit(1.0), F.greatest(F.lit(floor), F.col("p") / avg))).select("grid", "sample_id", "precision")


def natural_order(df: DataFrame, label: str) -> DataFrame:
    """Numeric labels first by value, then the others by text."""
    n = F.col(label).try_cast("double")
    return df.orderBy(n.isNull(), n, label)
