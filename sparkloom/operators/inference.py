"""Post-alignment local differential expression on a shared grid.

Local statistics come as rows (sample_id, gene, qid, mu, s2, neff). Everything is an aggregate or a
column expression over them; the t tail is the one vectorised Python function."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions.columns import inflate
from ..functions.special import normal, t_quantile, t_two_sided
from .ranking import bh, isotonic

#: Fixed values of the inference defaults.
ALPHA, FLOOR, CTL_Q, CTL_TAU, RISK_CAP, RISK_HIGH = 0.05, 0.1, 0.30, 0.60, 0.95, 0.6
BINS, LEAST_BIN, LAMBDA_CAP = 10, 200, 5e4


def contrasts(stats: DataFrame, reference: str, neff_min: float) -> DataFrame:
    """Every other sample against the reference: gene, contrast, qid, mu (mu_A), y = mu_A - mu_B, v, w, use.

    v = s2_A / neff_A + s2_B / neff_B, floored at FLOOR times its median over (gene, contrast);
    use: both effective numbers reach neff_min."""
    cols = ["gene", "qid", "mu", "s2", "neff"]
    ref = stats.filter(F.col("sample_id") == reference).select("gene", "qid", F.col("mu").alias("mr"), F.col("s2").alias("sr"), F.col("neff").alias("nr"))
    rows = stats.filter(F.col("sample_id") != reference).select(F.col("sample_id").alias("contrast"), *cols).join(ref, ["gene", "qid"])
    rows = rows.filter((F.col("neff") > 0) & (F.col("nr") > 0)).withColumn("v0", F.col("s2") / F.col("neff") + F.col("sr") / F.col("nr"))
    med = rows.groupBy("gene", "contrast").agg((FLOOR * F.median("v0")).alias("least"))
    rows = rows.join(med, ["gene", "contrast"]).withColumn("v", F.greatest("v0", "least"))
    return rows.select("gene", "contrast", "qid", "mu", (F.col("mu") - F.col("mr")).alias("y"), "v", (1 / F.col("v")).alias("w"), (F.least("neff", "nr") >= neff_min).alias("use"))


def anchors(rows: DataFrame) -> DataFrame:
    """Stable anchors: |y| / sqrt(v) at most its CTL_Q quantile in a contrast, in at least CTL_TAU of
    a grid cell's contrasts: gene, qid, anchor."""
    t = rows.filter("use").withColumn("t0", F.abs(F.col("y")) / F.sqrt("v"))
    q = t.groupBy("gene", "contrast").agg(F.percentile("t0", F.lit(CTL_Q)).alias("lim"))
    return t.join(q, ["gene", "contrast"]).groupBy("gene", "qid").agg((F.avg((F.col("t0") <= F.col("lim")).cast("double")) >= CTL_TAU).alias("anchor"))


def ridge_intercept(rows: DataFrame, lam: float = 10.0) -> DataFrame:
    """Batch offset of each (gene, contrast): sum w y / (sum w + lambda), over used cells."""
    return rows.filter("use").groupBy("gene", "contrast").agg((F.sum(F.col("w") * F.col("y")) / (F.sum("w") + lam)).alias("beta"), F.count(F.lit(1)).alias("n"))


def ridge_two(rows: DataFrame, covariate: str, lam: float = 10.0) -> DataFrame:
    """Weighted ridge of y on an intercept and one covariate by its sufficient statistics: b0, b1.
    The penalty holds for the covariate alone."""
    z, w, y = F.col(covariate), F.col("w"), F.col("y")
    s = rows.filter("use").groupBy("gene", "contrast").agg(F.sum(w).alias("s0"), F.sum(w * z).alias("s1"), F.sum(w * z * z).alias("s2"), F.sum(w * y).alias("t0"), F.sum(w * z * y).alias("t1"))
    s = s.withColumn("s2", F.col("s2") + lam).withColumn("det", F.col("s0") * F.col("s2") - F.col("s1") * F.col("s1"))
    return s.select("gene", "contrast", ((F.col("s2") * F.col("t0") - F.col("s1") * F.col("t1")) / F.col("det")).alias("b0"), ((F.col("s0") * F.col("t1") - F.col("s1") * F.col("t0")) / F.col("det")).alias("b1"))


def ridge(rows: DataFrame, covariates: list[str], lam: float = 10.0, penalised: list[str] | None = None, prior: dict[str, float] | DataFrame | None = None) -> DataFrame:
    """Weighted ridge of y on an intercept and covariates by their sufficient statistics: gene,
    contrast, n, b (the intercept, then the covariates in order). The penalty pulls the penalised
    ones (all, if none are named) towards their prior values (0 if not named); an intercept named
    in `prior` as "1" is pulled too. A table (gene, centre) as prior holds an array a gene, of the
    intercept and the covariates in order; then the intercept is pulled too. Only sums of q x q numbers a group leave the scan; at most 32
    covariates. Cells with a null covariate are left out; a singular system takes a little more
    on its diagonal."""
    if len(covariates) > 32:
        raise ValueError("at most 32 covariates")
    by_gene = isinstance(prior, DataFrame)
    given = {} if by_gene else prior or {}
    pulled = [by_gene or "1" in given, *[penalised is None or c in penalised for c in covariates]]
    centre = [float(given.get(c, 0.0)) for c in ("1", *covariates)]
    penalty = np.where(pulled, lam, 0.0)
    z, w, q = [F.lit(1.0), *[F.col(c).cast("double") for c in covariates]], F.col("w"), len(covariates) + 1
    at = [(i, j) for i in range(q) for j in range(i, q)]

    @pandas_udf("array<double>")
    def solve(x: pd.Series, r: pd.Series, c: pd.Series) -> pd.Series:
        out = []
        for xs, rs, cs in zip(x, r, c):
            k = np.zeros((q, q))
            for (i, j), v in zip(at, xs):
                k[i, j] = k[j, i] = v
            k, right = k + np.diag(penalty), np.asarray(rs, float) + penalty * np.asarray(cs, float)
            scale = max(float(np.trace(k)) / q, 1e-300)
            extra = next((e for e in (0.0, 1e-8, 1e-6, 1e-4, 1e-2) if np.linalg.cond(k + np.eye(q) * e * scale) < 1e14), 1.0)
            out.append(np.linalg.solve(k + np.eye(q) * extra * scale, right))
        return pd.Series(out)

    known = [F.col(c).isNotNull() for c in covariates]
    used = rows.filter(reduce(lambda a, b: a & b, known, F.col("use")))
    s = used.groupBy("gene", "contrast").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(w * z[i] * z[j]) for i, j in at]).alias("x"), F.array(*[F.sum(w * v * F.col("y")) for v in z]).alias("r"))
    middle = F.array(*map(F.lit, centre))
    s = s.join(prior.select("gene", "centre"), "gene", "left") if by_gene else s.withColumn("centre", middle)
    return s.select("gene", "contrast", "n", solve("x", "r", F.coalesce("centre", middle)).alias("b"))


def adjusted(rows: DataFrame, fit: DataFrame, covariates: list[str], least: int = 5, alpha: float = ALPHA) -> DataFrame:
    """Effects without the nuisance that covariates explain: rows with y_adj = y - sum b z (and
    mu_adj alike where rows have mu; the intercept stays in both), t of the residual with the
    intercept off too, two-sided p with max(n - q, 5) degrees, BH q over used cells and sig. Groups
    of fewer than `least` used cells have null t. fit: as `ridge` gives it."""
    nuisance = reduce(lambda a, b: a + b, [F.get("b", F.lit(k + 1)) * F.col(c) for k, c in enumerate(covariates)], F.lit(0.0))
    r = rows.join(fit, ["gene", "contrast"], "left").withColumn("__n", nuisance).withColumn("y_adj", F.col("y") - F.col("__n"))
    if "mu" in rows.columns:
        r = r.withColumn("mu_adj", F.col("mu") - F.col("__n"))
    r = r.withColumn("t", F.when(F.col("use") & (F.col("n") >= least), (F.col("y_adj") - F.get("b", F.lit(0))) * F.sqrt("w")))
    r = r.withColumn("df", F.greatest(F.col("n") - len(covariates) - 1, F.lit(5)).cast("double"))
    r = r.withColumn("p", F.when(F.col("t").isNotNull(), t_two_sided(F.col("t"), F.col("df"))))
    return bh(r.drop("b", "__n"), ["gene", "contrast"]).withColumn("sig", F.coalesce(F.col("q") <= alpha, F.lit(False)))


def trajectory_pretest(tests: DataFrame, lam: float = 25.0, least: int = 2, eps: float = 1e-8, df: float | None = None, alpha: float = ALPHA) -> DataFrame:
    """Test of t smoothed along the ordered contrasts of each grid cell by second differences: z
    solves (I + lam D'D + eps I) z = t over the cell's used contrasts, D'D being that of all
    contrasts; cells with fewer than `least` used ones keep their t. p is two-sided normal, or
    Student's with `df`; q and sig are by gene and contrast. tests: gene, contrast, ord, qid, t, use;
    adds z, p, q, sig. A cell's series has a value a contrast, which bounds it."""
    names = tests.groupBy("contrast").agg(F.min("ord").alias("ord"))  # a row a contrast
    names = names.select("contrast", (F.row_number().over(Window.orderBy("ord", "contrast")) - 1).alias("__at"), F.count(F.lit(1)).over(Window.partitionBy()).alias("__m"))

    @pandas_udf("array<double>")
    def smooth(at: pd.Series, t: pd.Series, m: pd.Series) -> pd.Series:
        seen, out = {}, []
        for a, v, total in zip(at, t, m):
            v = np.array(v, float)
            ok = np.isfinite(v)
            if ok.sum() >= least:
                key = (total, *np.asarray(a)[ok].tolist())
                if key not in seen:
                    d = np.diff(np.eye(total), 2, axis=0) if total > 2 else np.zeros((0, total))
                    here = list(key[1:])
                    seen[key] = np.linalg.inv(np.eye(len(here)) * (1 + eps) + lam * (d.T @ d)[np.ix_(here, here)])
                v[ok] = seen[key] @ v[ok]
            out.append(v)
        return pd.Series(out)

    used = F.when(F.col("use"), F.col("t"))
    series = tests.join(F.broadcast(names), "contrast").groupBy("gene", "qid").agg(F.array_sort(F.collect_list(F.struct("__at", "contrast", used.alias("t")))).alias("s"), F.max("__m").alias("m"))
    z = series.select("gene", "qid", F.explode(F.arrays_zip(F.col("s.contrast").alias("contrast"), smooth("s.__at", "s.t", "m").alias("z"))).alias("e"))
    r = tests.drop("p", "q", "sig").join(z.select("gene", "qid", "e.contrast", F.nanvl("e.z", F.lit(None)).alias("z")), ["gene", "contrast", "qid"])
    p = 2 * normal(-F.abs("z")) if df is None else t_two_sided(F.col("z"), F.lit(float(df)))
    r = bh(r.withColumn("p", F.when(F.col("z").isNotNull(), p)), ["gene", "contrast"])
    return r.withColumn("sig", F.coalesce(F.col("q") <= alpha, F.lit(False)))


def local_tests(rows: DataFrame, offsets: DataFrame, parameters: int = 1, alpha: float = ALPHA) -> DataFrame:
    """Residual t, two-sided p with max(n - parameters, 5) degrees, BH q over used cells, sig."""
    r = rows.join(offsets, ["gene", "contrast"]).withColumn("t", (F.col("y") - F.col("beta")) * F.sqrt("w"))
    df = F.greatest(F.col("n") - parameters, F.lit(5)).cast("double")
    r = r.withColumn("df", df).withColumn("p", F.when(F.col("use"), t_two_sided(F.col("t"), F.col("df"))))
    return bh(r, ["gene", "contrast"]).withColumn("sig", F.coalesce(F.col("use") & (F.col("q") <= alpha), F.lit(False)))


def risk01(risk: DataFrame, cap: float = RISK_CAP) -> DataFrame:
    """Risk clipped at 0, capped at its quantile over used cells, over the cap. risk: qid, risk, use."""
    c = risk.filter("use").agg(F.percentile(F.greatest("risk", F.lit(0.0)), F.lit(cap)).alias("cap"))
    return risk.join(F.broadcast(c)).withColumn("r01", F.least(F.lit(1.0), F.greatest("risk", F.lit(0.0)) / F.greatest("cap", F.lit(1e-8)))).drop("cap")


def global_risk(r01: DataFrame) -> DataFrame:
    return r01.filter("use").agg(F.avg((F.col("r01") > RISK_HIGH).cast("double")).alias("global_risk"))


def risk_bins(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """Quantile bins of r01 with the robust scale of t: bin, n, r, centre, scale (1.4826 MAD).
    rows: t, r01. Equal breaks join their bins; the breaks are one small row."""
    breaks = rows.agg(F.array_sort(F.array_distinct(F.percentile("r01", F.array(*[F.lit(i / bins) for i in range(1, bins)])))).alias("b"))
    r = rows.join(F.broadcast(breaks)).withColumn("bin", F.size(F.filter("b", lambda x: x < F.col("r01")))).drop("b")
    m = r.groupBy("bin").agg(F.median("t").alias("centre"), F.avg("r01").alias("r"), F.count(F.lit(1)).alias("n"))
    s = r.join(F.broadcast(m.select("bin", "centre")), "bin").groupBy("bin").agg((1.4826 * F.median(F.abs(F.col("t") - F.col("centre")))).alias("scale"))
    return m.join(s, "bin")


def calibrate(bins: DataFrame, null_scale: float = 1.0, cap: float = LAMBDA_CAP) -> DataFrame:
    """lambda of v (1 + lambda r^2) from bins (i = bin, r, n, scale): the isotonic fit of the excess
    (scale / null)^2 - 1 regressed on r^2 through the origin, weights n; clipped to [0, cap]."""
    y = F.greatest(F.pow(F.col("scale") / null_scale, 2) - 1, F.lit(0.0))
    fit = isotonic(bins.select(F.col("bin").alias("i"), y.alias("y"), F.col("n").cast("double").alias("w"), "r"))
    r2 = F.col("r") * F.col("r")
    lam = F.sum(F.col("w") * r2 * F.col("fit")) / F.greatest(F.sum(F.col("w") * r2 * r2), F.lit(1e-12))
    return fit.agg(F.least(F.lit(cap), F.greatest(F.lit(0.0), lam)).alias("lambda"))


def gene_bins(rows: DataFrame, bins: int = BINS) -> DataFrame:
    """`risk_bins` of each gene: gene, bin, n, r, centre, scale and df. rows: gene, t, r01, df."""
    breaks = rows.groupBy("gene").agg(F.array_sort(F.array_distinct(F.percentile("r01", F.array(*[F.lit(i / bins) for i in range(1, bins)])))).alias("b"))
    r = rows.join(breaks, "gene").withColumn("bin", F.size(F.filter("b", lambda x: x < F.col("r01")))).drop("b")
    m = r.groupBy("gene", "bin").agg(F.median("t").alias("centre"), F.avg("r01").alias("r"), F.count(F.lit(1)).alias("n"), F.max("df").alias("df"))
    s = r.join(m.select("gene", "bin", "centre"), ["gene", "bin"]).groupBy("gene", "bin").agg((1.4826 * F.median(F.abs(F.col("t") - F.col("centre")))).alias("scale"))
    return m.join(s, ["gene", "bin"])


def calibrate_genes(bins: DataFrame, least_rows: int = 500, least_bins: int = 4, least: int = LEAST_BIN, cap: float = LAMBDA_CAP) -> DataFrame:
    """`calibrate` for each gene of gene_bins: gene, lambda and mode. The null scale is that of a
    Student's t with the gene's degrees of freedom. Genes with fewer than `least_rows` tests, or
    fewer than `least_bins` bins of at least `least`, get 0. A gene has at most BINS rows."""

    @pandas_udf("struct<lambda:double,mode:string>")
    def solve(r: pd.Series, n: pd.Series, scale: pd.Series, df: pd.Series) -> pd.DataFrame:
        out = []
        for rs, ns, ss, d in zip(r, n, scale, df):
            ns = np.asarray(ns, float)
            if ns.sum() < max(least_rows, least_bins * least):
                out.append((0.0, "too few tests"))
                continue
            ok = ns >= least
            if ok.sum() < least_bins:
                out.append((0.0, "too few bins"))
                continue
            r2, w = np.asarray(rs, float)[ok] ** 2, ns[ok]
            excess = np.maximum((np.asarray(ss, float)[ok] / (1.4826 * t_quantile(0.75, d))) ** 2 - 1, 0.0)
            blocks: list[list[float]] = []  # sum, weight, bins
            for y, v in zip(excess, w):
                blocks.append([y * v, v, 1])
                while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
                    last = blocks.pop()
                    blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
            fit = np.concatenate([np.full(int(k), s / v) for s, v, k in blocks])
            out.append((float(np.clip((w * r2 * fit).sum() / max((w * r2 * r2).sum(), 1e-12), 0.0, cap)), "calibrated"))
        return pd.DataFrame(out, columns=["lambda", "mode"])

    held = bins.groupBy("gene").agg(F.array_sort(F.collect_list(F.struct("bin", "r", "n", "scale"))).alias("s"), F.max("df").alias("df"))
    return held.select("gene", solve("s.r", "s.n", "s.scale", "df").alias("c")).select("gene", "c.lambda", "c.mode")


def inflated(rows: DataFrame, r01: DataFrame, lam: Column | float) -> DataFrame:
    return rows.join(r01.select("qid", "r01"), "qid").withColumn("v", inflate(F.col("v"), F.col("r01"), lam)).withColumn("w", 1 / F.col("v"))


def cosine_risk(a: DataFrame, b: DataFrame) -> DataFrame:
    """1 - cosine between the feature rows of two sides: qid, feature, value in each."""
    r = a.withColumnRenamed("value", "x").join(b.withColumnRenamed("value", "y"), ["qid", "feature"])
    s = r.groupBy("qid").agg(F.sum(F.col("x") * F.col("y")).alias("xy"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    norm = F.sqrt(F.col("xx") * F.col("yy"))
    return s.select("qid", F.when(norm > 0, 1 - F.col("xy") / norm).otherwise(F.lit(1.0)).alias("risk"))


def stable_markers(genes: DataFrame, var_q: float = 0.5, delta_q: float = 0.1, delta_least: float = 0.05, cor: float = 0.2, most: int = 300) -> DataFrame:
    """Genes of at least median variance, small shift and enough correlation, best by max(cor, 0) *
    variance. genes: gene, variance, delta, cor (one row a gene)."""
    q = genes.agg(F.percentile("variance", F.lit(var_q)).alias("vq"), F.greatest(F.percentile(F.abs("delta"), F.lit(delta_q)), F.lit(delta_least)).alias("dq"))
    ok = genes.join(F.broadcast(q)).filter((F.col("variance") >= F.col("vq")) & (F.abs("delta") <= F.col("dq")) & (F.col("cor") >= cor))
    return ok.withColumn("score", F.greatest("cor", F.lit(0.0)) * F.col("variance")).orderBy(F.desc("score"), "gene").limit(most).select("gene", "score")
