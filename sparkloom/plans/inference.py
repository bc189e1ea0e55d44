"""Local differential expression: prepare a grid and its edges, fit all genes in one batch."""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import inflate
from ..operators import geometry, inference, neighbours, ranking, tissue
from ..storage import cut


@dataclass(frozen=True)
class Prepared:
    """grid (id, x, y), edges (sample_id, qid, nid, w) and the radius."""

    grid: DataFrame
    edges: DataFrame
    radius: float
    spacing: float


def prepare(pts: DataFrame, grid_n: int | None = None, radius: float | None = None, most: int = 300) -> Prepared:
    """A square grid over tissue cells that hold points, and the neighbours of its points in each
    sample. pts: id, sample_id, x, y (aligned). Edges are materialised by their first use."""
    typical = geometry.typical_size(pts).first()[0]
    box = geometry.shared_box(pts, 1.0, 1.0).first()
    span = max(box["x1"] - box["x0"], box["y1"] - box["y0"], 1e-9)
    n, _ = geometry.grid_resolution(max(2, round(math.sqrt(typical))), typical, 1.0, explicit=grid_n)
    spacing = span / n
    r = geometry.map_radius(spacing, radius)
    occupied = pts.select(F.floor((F.col("x") - box["x0"]) / spacing).alias("gx"), F.floor((F.col("y") - box["y0"]) / spacing).alias("gy")).distinct()
    grid = occupied.select((F.col("gy") * (n + 1) + F.col("gx")).alias("id"), ((F.col("gx") + 0.5) * spacing + box["x0"]).alias("x"), ((F.col("gy") + 0.5) * spacing + box["y0"]).alias("y"))
    samples = pts.select("sample_id").distinct()
    query = grid.join(F.broadcast(samples))  # a row a sample
    edges = neighbours.radius_edges(pts, query, r, most, ("sample_id",))
    return Prepared(grid, edges.select("sample_id", "qid", "nid", "d", "w"), r, spacing)


class Fit(NamedTuple):
    """tests: gene, contrast, qid, mu, y, v, w, use, y_adj, mu_adj, t, df, p, q, sig, lambda; genes:
    gene-level p by two-level Cauchy combination; lambdas: gene, lambda and how it was found;
    pretest: the tests smoothed along ordered contrasts, if asked for."""

    tests: DataFrame
    genes: DataFrame
    lambdas: DataFrame
    pretest: DataFrame | None


def batch_prior(rows: DataFrame, technical: list[str], lam: float) -> DataFrame:
    """gene, centre: the intercept and technical effects on a gene's stable anchors, all contrasts
    together, as what each contrast's fit is pulled to. Genes of too few anchors have none."""
    stable = rows.join(inference.anchors(rows).filter("anchor").select("gene", "qid"), ["gene", "qid"], "left_semi")
    found = inference.ridge(stable.withColumn("contrast", F.lit("all")), technical, lam, penalised=technical)
    return found.filter(F.col("n") >= len(technical) + 3).select("gene", F.col("b").alias("centre"))


def solve(rows: DataFrame, covariates: list[str], technical: list[str], lam: float) -> DataFrame:
    """Adjusted tests of contrasts that carry their covariates. The covariates are free; technical
    ones and the intercept are pulled to their values on stable anchors. Without technical ones the
    intercept is the weighted mean."""
    prior = None
    if technical:  # free covariates have no prior value; theirs is not used
        free = F.array_repeat(F.lit(0.0), len(covariates))
        prior = batch_prior(rows, technical, lam).select("gene", F.concat(F.slice("centre", 1, 1), free, F.slice("centre", 2, len(technical))).alias("centre"))
    names = [*covariates, *technical]
    fitted = inference.ridge(rows, names, lam, penalised=technical, prior=prior)
    return inference.adjusted(rows, fitted, names)


def fit_stats(stats: DataFrame, reference: str, risk: DataFrame | None = None, neff_min: float = 2.0, covariates: DataFrame | None = None, technical: DataFrame | None = None, precision: DataFrame | None = None, order: DataFrame | None = None, lam: float = 10.0) -> Fit:
    """Local tests of local statistics (sample_id, gene, qid, mu, s2, neff).

    covariates, technical: qid (and contrast) with one column a covariate; precision: qid, contrast,
    precision, by which weights are multiplied. With risk (qid, risk, use, and contrast if it differs),
    a first pass without risk and precision gives each gene's t in the first contrast by risk bins;
    their scale over the null's calibrates the gene's inflation of variances, with which the second
    pass runs. order: contrast, ord; asks for the pretest. Rows that lack a covariate are not used."""
    rows = inference.contrasts(stats, reference, neff_min)
    names: list[list[str]] = []
    for table in (covariates, technical):
        names.append([c for c in table.columns if c not in ("qid", "contrast")] if table is not None else [])
        if table is not None:
            rows = rows.join(table, [c for c in ("qid", "contrast") if c in table.columns], "left")
    rows = cut(rows)
    lambdas = rows.select("gene").distinct().select("gene", F.lit(0.0).alias("lambda"), F.lit("none").alias("mode"))
    if risk is not None:
        on = [c for c in ("qid", "contrast") if c in risk.columns]
        by = [c for c in on if c != "qid"]
        cap = risk.filter("use").groupBy(*by).agg(F.percentile(F.greatest("risk", F.lit(0.0)), F.lit(inference.RISK_CAP)).alias("cap"))
        scaled = risk.join(cap, by) if by else risk.join(F.broadcast(cap))  # without contrasts one row
        r01 = scaled.select(*on, F.least(F.lit(1.0), F.greatest("risk", F.lit(0.0)) / F.greatest("cap", F.lit(1e-8))).alias("r01"))
        rows = cut(rows.join(r01, on, "left").withColumn("r01", F.coalesce("r01", F.lit(0.0))))
        first = rows.agg(F.min("contrast")).first()[0]
        dry = solve(rows, *names, lam).filter((F.col("contrast") == first) & F.col("use") & F.col("t").isNotNull())
        lambdas = cut(inference.calibrate_genes(cut(inference.gene_bins(dry))))
        rows = rows.join(lambdas.select("gene", "lambda"), "gene", "left").withColumn("v", inflate(F.col("v"), F.col("r01"), F.coalesce("lambda", F.lit(0.0)))).withColumn("w", 1 / F.col("v")).drop("lambda", "r01")
    if precision is not None:
        rows = rows.join(precision, ["qid", "contrast"], "left").withColumn("w", F.col("w") * F.coalesce("precision", F.lit(1.0))).drop("precision")
    tests = cut(solve(cut(rows), *names, lam).join(lambdas.select("gene", "lambda"), "gene", "left").drop("n"))
    genes = ranking.gene_acat(tests.filter("use AND p IS NOT NULL").select("gene", "contrast", "p"))
    return Fit(tests, genes, lambdas, inference.trajectory_pretest(tests.select("gene", "contrast", "qid", "t", "use").join(order, "contrast")) if order is not None else None)


def fit(prepared: Prepared, expr: DataFrame, reference: str, risk: DataFrame | None = None, neff_min: float = 2.0, **more) -> Fit:
    """`fit_stats` of the local statistics of expr (sample_id, nid, gene, value) on a prepared grid;
    see there for covariates, technical, precision and order."""
    return fit_stats(neighbours.local_stats(prepared.edges, expr, ("sample_id",)), reference, risk, neff_min, **more)


def technical_covariates(prepared: Prepared, expr: DataFrame, batches: DataFrame, controls: list[str]) -> DataFrame:
    """contrast, qid, psi1, psi2 for `fit`: two covariates from the library sizes and detection
    around each grid cell, on the scale of the control samples of a batch. batches: sample_id, batch."""
    genes = expr.select("gene").distinct().agg(F.count(F.lit(1)).alias("genes"))
    spot = expr.groupBy("sample_id", "nid").agg(F.log1p(F.sum(F.greatest("value", F.lit(0.0)))).alias("lib"), F.count_if(F.col("value") > 0).alias("seen"))
    spot = spot.join(F.broadcast(genes)).select("sample_id", "nid", "lib", (F.col("seen") / F.col("genes")).alias("det"))
    near = prepared.edges.join(spot, ["sample_id", "nid"]).groupBy("sample_id", "qid").agg(*[(F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(c) for c in ("lib", "det")])
    # a row is a sample's grid cell: samples of a batch share its scale
    rows = cut(near.join(batches, "sample_id").withColumn("cell", F.struct("sample_id", "qid")))
    held = rows.filter(F.col("sample_id").isin(*controls)).select("batch", F.col("cell").alias("qid"))
    basis = tissue.technical_basis(rows.select("batch", F.col("cell").alias("qid"), "lib", "det"), held)
    return basis.select(F.col("qid.sample_id").alias("contrast"), F.col("qid.qid").alias("qid"), "psi1", "psi2")


def support_precision(prepared: Prepared, types: DataFrame, ages: DataFrame, bandwidth: float) -> DataFrame:
    """contrast, qid, precision for `fit`: how much of a grid cell's neighbourhood has cells with a
    type, against samples of near age. types: sample_id, nid; ages: sample_id, age."""
    cover = prepared.edges.join(types.select("sample_id", "nid").distinct(), ["sample_id", "nid"]).groupBy("sample_id", "qid").agg(F.sum("w").alias("c")).join(ages, "sample_id")
    return ranking.age_coverage(cover.withColumnRenamed("qid", "grid"), bandwidth).select(F.col("sample_id").alias("contrast"), F.col("grid").alias("qid"), "precision")
