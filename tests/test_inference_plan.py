"""The inference plan against numpy, gene by gene."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions.special import t_quantile
from sparkloom.plans import inference as plan

RNG = np.random.default_rng(8)
N, GENES, CONTRASTS = 1200, ("up", "flat"), ("s1", "s2", "s3")


def made():
    """Local statistics of a reference and three samples, with two technical covariates and a risk
    that widens differences."""
    risk = RNG.random(N)
    psi = {c: RNG.normal(size=(N, 2)) for c in CONTRASTS}
    free = RNG.normal(size=N)
    stats = []
    for g in GENES:
        base = RNG.random(N) * 3 + 2
        stats += [("s0", g, i, float(base[i]), 1.0, 20.0) for i in range(N)]
        for c in CONTRASTS:
            noise = RNG.normal(size=N) * np.sqrt(0.1 * (1 + 4 * risk**2))
            effect = (np.arange(N) < 60) * (3.0 if g == "up" else 0.0)
            mu = base + 0.4 + psi[c] @ [0.3, -0.2] + 0.5 * free + noise + effect
            stats += [(c, g, i, float(mu[i]), 1.0, 20.0 if i % 50 else 1.0) for i in range(N)]
    return stats, risk, psi, free


def numpy_fit(stats, risk, psi, free, gene, lam=10.0):
    """The same, for one gene: anchors, prior, dry pass, lambda, second pass."""
    mu = {c: np.array([m for s, g, i, m, *_ in stats if s == c and g == gene]) for c in ("s0", *CONTRASTS)}
    neff = {c: np.array([e for s, g, i, m, v, e in stats if s == c and g == gene]) for c in ("s0", *CONTRASTS)}
    y = {c: mu[c] - mu["s0"] for c in CONTRASTS}
    v0 = {c: 1 / neff[c] + 1 / neff["s0"] for c in CONTRASTS}
    v0 = {c: np.maximum(v, 0.1 * np.median(v)) for c, v in v0.items()}
    use = {c: np.minimum(neff[c], neff["s0"]) >= 2 for c in CONTRASTS}

    def pass_(v):
        stable = []
        for c in CONTRASTS:
            t0 = np.where(use[c], np.abs(y[c]) / np.sqrt(v[c]), np.nan)
            stable.append(np.where(use[c], t0 <= np.nanquantile(t0, 0.3), np.nan))
        with np.errstate(invalid="ignore"):
            anchor = np.array([np.nanmean(s) if (s == s).any() else 0 for s in np.array(stable).T]) >= 0.6
        k, r = np.zeros((3, 3)), np.zeros(3)
        for c in CONTRASTS:
            at = use[c] & anchor
            x = np.column_stack([np.ones(at.sum()), psi[c][at]])
            k, r = k + x.T @ (x / v[c][at, None]), r + x.T @ (y[c][at] / v[c][at])
        centre = np.linalg.solve(k + np.diag([0, lam, lam]), r)
        out = {}
        for c in CONTRASTS:
            x = np.column_stack([np.ones(N), free, psi[c]])[use[c]]
            pen = np.diag([lam, 0, lam, lam])
            b = np.linalg.solve(x.T @ (x / v[c][use[c], None]) + pen, x.T @ (y[c][use[c]] / v[c][use[c]]) + pen @ [centre[0], 0, *centre[1:]])
            res = (y[c][use[c]] - x @ b) / np.sqrt(v[c][use[c]])
            out[c] = np.flatnonzero(use[c]), res, y[c][use[c]] - x[:, 1:] @ b[1:], max(use[c].sum() - 4, 5)
        return out

    at, t, _, df = pass_(v0)["s1"]
    r01 = np.minimum(1, risk / np.quantile(risk, 0.95))
    breaks = np.unique(np.quantile(r01[at], [k / 10 for k in range(1, 10)]))
    which = np.array([(breaks < x).sum() for x in r01[at]])
    ex, w, r2 = [], [], []
    for b in range(10):
        u = t[which == b]
        if len(u) >= 100:
            ex.append(max((np.median(np.abs(u - np.median(u))) / t_quantile(0.75, df)) ** 2 - 1, 0))
            w.append(len(u))
            r2.append(r01[at][which == b].mean() ** 2)
    fit = list(zip(ex, w, [1] * len(ex)))
    i = 0
    while i + 1 < len(fit):
        if fit[i][0] >= fit[i + 1][0]:
            a, b = fit[i], fit[i + 1]
            fit[i : i + 2] = [((a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1], a[2] + b[2])]
            i = max(i - 1, 0)
        else:
            i += 1
    flat = np.concatenate([[m] * k for m, _, k in fit])
    w, r2 = np.array(w), np.array(r2)
    lam_hat = (w * r2 * flat).sum() / (w * r2 * r2).sum()
    return lam_hat, pass_({c: v * (1 + lam_hat * r01**2) for c, v in v0.items()})


def test_plan_equals_numpy(spark, monkeypatch):
    from sparkloom.operators import inference as rules

    monkeypatch.setattr(rules.calibrate_genes, "__defaults__", (500, 4, 100, rules.LAMBDA_CAP))
    stats, risk, psi, free = made()
    df = spark.createDataFrame(stats, "sample_id string, gene string, qid long, mu double, s2 double, neff double")
    technical = spark.createDataFrame([(c, i, *map(float, psi[c][i])) for c in CONTRASTS for i in range(N)], "contrast string, qid long, psi1 double, psi2 double")
    covariates = spark.createDataFrame([(i, float(free[i])) for i in range(N)], "qid long, z double")
    risks = spark.createDataFrame([(i, float(risk[i]), True) for i in range(N)], "qid long, risk double, use boolean")
    order = spark.createDataFrame([(c, k) for k, c in enumerate(CONTRASTS)], "contrast string, ord int")
    out = plan.fit_stats(df, "s0", risks, covariates=covariates, technical=technical, order=order)
    got, lambdas = out.tests.toPandas(), {r["gene"]: r for r in out.lambdas.collect()}
    for g in GENES:
        lam, want = numpy_fit(stats, risk, psi, free, g)
        assert lambdas[g]["mode"] == "calibrated" and lam > 0.5 and lambdas[g]["lambda"] == pytest.approx(lam, rel=1e-6)
        for c in CONTRASTS:
            at, t, y_adj, dof = want[c]
            rows = got[(got["gene"] == g) & (got["contrast"] == c) & got["use"]].sort_values("qid")
            assert rows["qid"].tolist() == at.tolist() and (rows["df"] == dof).all()
            assert np.allclose(rows["t"], t, atol=1e-8) and np.allclose(rows["y_adj"], y_adj, atol=1e-8)
    genes = {r["gene"]: r["p"] for r in out.genes.collect()}
    assert genes["up"] < 1e-6 < genes["flat"]
    assert out.pretest.filter("gene = 'up' AND sig AND qid < 60").count() > 100 > out.pretest.filter("gene = 'flat' AND sig").count()


def test_plan_without_risk_or_covariates(spark):
    stats, *_ = made()
    df = spark.createDataFrame(stats[: 4 * N], "sample_id string, gene string, qid long, mu double, s2 double, neff double")
    half = spark.createDataFrame([(i, c, 0.25) for i in range(N) for c in CONTRASTS], "qid long, contrast string, precision double")
    a, b = plan.fit_stats(df, "s0"), plan.fit_stats(df, "s0", precision=half)
    both = a.tests.filter("use").select("contrast", "qid", "t").join(b.tests.select("contrast", "qid", F.col("t").alias("u")), ["contrast", "qid"])
    assert both.filter(F.abs(F.col("t") - 2 * F.col("u")) > 1e-9).isEmpty() and both.count() > 3000
    assert {r["mode"] for r in a.lambdas.collect()} == {"none"} and a.pretest is None


def test_technical_covariates_and_support(spark):
    pts = [(s * 100 + i, f"s{s}", float(i % 10), float(i // 10)) for s in range(3) for i in range(100)]
    p = spark.createDataFrame(pts, "id long, sample_id string, x double, y double")
    expr = spark.createDataFrame([(s, i, g, float((i * k) % 7)) for i, s, *_ in pts for k, g in ((1, "a"), (3, "b"), (5, "c"))], "sample_id string, nid long, gene string, value double")
    ready = plan.prepare(p, 5)
    batches = spark.createDataFrame([("s0", "one"), ("s1", "one"), ("s2", "two")], "sample_id string, batch string")
    psi = plan.technical_covariates(ready, expr, batches, ["s0", "s2"])
    cells = ready.grid.count()
    assert psi.count() == 3 * cells
    base = psi.filter("contrast = 's0'").agg(F.avg("psi1").alias("m"), F.avg(F.col("psi1") * F.col("psi2")).alias("c")).first()
    assert abs(base["m"]) < 1e-9 and abs(base["c"]) < 1e-9
    ages = spark.createDataFrame([("s0", 1.0), ("s1", 2.0), ("s2", 9.0)], "sample_id string, age double")
    support = plan.support_precision(ready, p.select("sample_id", F.col("id").alias("nid")), ages, 2.0)
    assert support.filter("precision < 0.001 OR precision > 1").isEmpty() and support.count() == 3 * cells
    out = plan.fit(ready, expr, "s0", technical=psi, precision=support)
    assert out.tests.select("contrast").distinct().count() == 2 and out.tests.filter("use AND t IS NULL").isEmpty()
