"""Queries over neighbour joins, local inference and rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import inference, neighbours, raster, ranking
from .registry import query
from .views import SQL_PARTS, SQL_POINTS, SQL_RASTER, masks, parts, points, sql_masks, table
from .views import raster as point_raster

D2 = "(b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)"


def sql_knn(k: int, data: str = "p", query_: str = "p", self_: bool = True) -> str:
    skip = "" if self_ else " WHERE a.id <> b.id"
    return f"SELECT qid, nid, sqrt(d2) AS d, rank FROM (SELECT a.id AS qid, b.id AS nid, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rank FROM {query_} a, {data} b{skip}) WHERE rank <= {k}"


P = f"WITH p AS ({SQL_PARTS})"


@query(f"{P} {sql_knn(5)}", "d")
def knn_k5(spark, d):
    p = parts(spark, d)
    return neighbours.knn(p, p, 5).withColumn("rank", F.col("rank").cast("long"))


@query(f"{P} SELECT sample_id, qid, nid, sqrt(d2) AS d, rank FROM (SELECT a.sample_id, a.id AS qid, b.id AS nid, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rank FROM p a JOIN p b ON a.sample_id = b.sample_id AND a.id <> b.id) WHERE rank <= 3", "d")
def knn_by_sample(spark, d):
    p = parts(spark, d)
    return neighbours.knn(p, p, 3, ("sample_id",), include_self=False).withColumn("rank", F.col("rank").cast("long"))


EDGES = f"e AS (SELECT qid, nid, sqrt(d2) AS d, exp(-0.5 * d2 / 9) AS w FROM (SELECT a.id AS qid, b.id AS nid, {D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {D2}, b.id) AS rn FROM p a, p b WHERE {D2} <= 9) WHERE rn <= 20)"


@query(f"{P}, {EDGES} SELECT * FROM e", "d w")
def radius_edges(spark, d):
    p = parts(spark, d)
    return neighbours.radius_edges(p, p, 3.0, 20)


VAL = "SELECT l_partkey AS nid, l_returnflag AS gene, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2"


def part_values(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("nid"), F.col("l_returnflag").alias("gene")).agg(F.sum("l_quantity").alias("value"))


STATS = f"SELECT gene, qid, sum(w * value) / sum(w) AS mu, greatest(sum(w * value * value) / sum(w) - (sum(w * value) / sum(w)) * (sum(w * value) / sum(w)), 1e-12) AS s2, sum(w) * sum(w) / sum(w * w) AS neff FROM e JOIN ({VAL}) USING (nid) GROUP BY gene, qid"


@query(f"{P}, {EDGES} {STATS}", "mu s2 neff", 5)
def local_stats(spark, d):
    return neighbours.local_stats(radius_edges(spark, d), part_values(spark, d))


@query(f"{P}, {EDGES} SELECT qid, sum(w * value) / sum(w) AS value FROM e JOIN (SELECT nid, sum(value) AS value FROM ({VAL}) GROUP BY nid) USING (nid) GROUP BY qid", "value", 5)
def kernel_map(spark, d):
    return neighbours.kernel_map(radius_edges(spark, d), part_values(spark, d).groupBy("nid").agg(F.sum("value").alias("value")))


@query(f"""{P}, {EDGES}, t AS (SELECT id AS nid, cluster AS celltype FROM p), k AS (SELECT DISTINCT celltype FROM t), s AS (SELECT qid, sum(w) AS total FROM e GROUP BY 1),
c AS (SELECT qid, celltype, sum(w) AS sw, sum(w) * sum(w) / sum(w * w) AS neff FROM e JOIN t USING (nid) GROUP BY 1, 2)
SELECT s.qid, k.celltype, (coalesce(sw, 0) + 1) / (total + (SELECT count(*) FROM k)) AS share, coalesce(neff, 0) AS neff FROM s CROSS JOIN k LEFT JOIN c ON c.qid = s.qid AND c.celltype = k.celltype""", "share neff")
def celltype_props(spark, d):
    return neighbours.type_proportions(radius_edges(spark, d), parts(spark, d).select(F.col("id").alias("nid"), F.col("cluster").alias("celltype")))


@query(f"""{P}, {EDGES}, s AS (SELECT gene, qid, avg(value) AS mu, var_pop(value) AS va, avg((value <= 60)::INT) AS zero FROM e JOIN ({VAL}) USING (nid) GROUP BY 1, 2),
r AS (SELECT *, CASE WHEN va - mu > 0 THEN mu * mu / greatest(va - mu, 1e-8) ELSE 1e8 END AS r FROM s) SELECT gene, qid, ln(1 + mu) AS log_mu, ln(1 + r) AS log_r FROM r""", "log_mu log_r", 5)
def nb_moments(spark, d):
    return neighbours.count_moments(radius_edges(spark, d), part_values(spark, d)).select("gene", "qid", "log_mu", "log_r")


KN = f"{P}, n AS ({sql_knn(8)})"
SNN = """, a AS (SELECT qid AS i, nid AS j, d, rank FROM n WHERE qid <> nid), s AS (SELECT a.i, a.j, count(*) AS shared FROM a JOIN n x ON x.qid = a.i JOIN n y ON y.qid = a.j AND y.nid = x.nid GROUP BY 1, 2),
k AS (SELECT a.i, a.j, 1 / (1 + d) AS w FROM a LEFT JOIN s ON s.i = a.i AND s.j = a.j WHERE rank <= 3 OR coalesce(shared, 0) >= 5), g AS (SELECT least(i, j) AS i, greatest(i, j) AS j, max(w) AS w FROM k GROUP BY 1, 2)"""


def nn8(spark, d):
    p = parts(spark, d)
    return neighbours.knn(p, p, 8)


@query(KN + SNN + " SELECT * FROM g", "w")
def snn_edges(spark, d):
    return neighbours.shared_edges(nn8(spark, d))


@query(KN + """, a AS (SELECT qid AS i, nid AS j, 1 / (1 + d) AS w FROM n WHERE qid <> nid) SELECT least(i, j) AS i, greatest(i, j) AS j, sum(w) / 2 AS w FROM a GROUP BY 1, 2""", "w")
def symmetric_mean_graph(spark, d):
    return neighbours.symmetric(nn8(spark, d).select(F.col("qid").alias("i"), F.col("nid").alias("j"), (1 / (1 + F.col("d"))).alias("w")), "mean")


@query(f"""{P}, n AS ({sql_knn(13)}), l AS (SELECT id, cluster AS label, id % 4 = 0 AS boundary FROM p),
v AS (SELECT n.qid, a.label, a.boundary, b.label AS vote, sum(1 / (n.d + 1e-6)) AS w, min(n.rank) AS first FROM n JOIN l a ON a.id = n.qid JOIN l b ON b.id = n.nid WHERE n.qid <> n.nid AND n.rank <= CASE WHEN a.boundary THEN 7 ELSE 13 END GROUP BY 1, 2, 3, 4),
s AS (SELECT *, w / sum(w) OVER (PARTITION BY qid) AS share FROM v), o AS (SELECT *, max(CASE WHEN vote = label THEN share ELSE 0 END) OVER (PARTITION BY qid) AS own, row_number() OVER (PARTITION BY qid ORDER BY w DESC, first, vote) AS rn FROM s)
SELECT qid AS id, label, CASE WHEN vote <> label AND own < 0.8 AND share >= CASE WHEN boundary THEN 0.8 ELSE 0.2 END THEN vote ELSE label END AS refined, share FROM o WHERE rn = 1""", "share")
def refine_vote(spark, d):
    p = parts(spark, d)
    labels = p.select("id", F.col("cluster").alias("label"), (F.col("id") % 4 == 0).alias("boundary"))
    return neighbours.refine_labels(neighbours.knn(p, p, 13), labels, k=(12, 6))


@query(KN + """, m AS (SELECT qid AS id, avg(d) AS d FROM n WHERE qid <> nid GROUP BY 1), r AS (SELECT m.*, cluster FROM m JOIN p USING (id)), q AS (SELECT cluster, median(d) AS med, quantile_cont(d, 0.9) AS q90, count(*) AS n FROM r GROUP BY 1),
x AS (SELECT r.cluster, median(abs(d - med)) AS mad FROM r JOIN q USING (cluster) GROUP BY 1) SELECT r.id, r.cluster, d, n < 10 OR d <= CASE WHEN mad > 0 THEN med + 2 * mad ELSE q90 END AS kept FROM r JOIN q USING (cluster) JOIN x USING (cluster)""", "d")
def density_filter(spark, d):
    return neighbours.density_filter(nn8(spark, d), parts(spark, d).select("id", "cluster"), 2.0)


@query(f"{P}, q AS (SELECT * FROM p WHERE sample_id < 'Brand#2'), r AS (SELECT * FROM p WHERE sample_id >= 'Brand#2'), n AS ({sql_knn(1, 'r', 'q')}) SELECT q.cluster, count(*) AS n, avg((q.cluster = r.cluster)::INT) AS match_rate, avg(d) AS mean_distance FROM n JOIN q ON q.id = qid JOIN r ON r.id = nid GROUP BY 1", "match_rate mean_distance")
def agreement_1nn(spark, d):
    p = parts(spark, d)
    return neighbours.agreement(p.filter("sample_id < 'Brand#2'"), p.filter("sample_id >= 'Brand#2'"))


@query(KN + ", r AS (SELECT qid, avg((a.sample_id = b.sample_id)::INT) AS p FROM n JOIN p a ON a.id = qid JOIN p b ON b.id = nid WHERE qid <> nid GROUP BY 1) SELECT avg(p) AS same_batch, avg(1 / (p * p + (1 - p) * (1 - p))) AS ilisi FROM r", "same_batch ilisi")
def same_batch_ilisi(spark, d):
    return neighbours.batch_mixing(nn8(spark, d), parts(spark, d).select("id", F.col("sample_id").alias("batch")))


@query(KN + ", v AS (SELECT id AS nid, (id * 37 % 101)::DOUBLE AS value FROM p), h AS (SELECT qid, median(d) AS h FROM n GROUP BY 1) SELECT n.qid, sum(exp(-0.5 * (d / greatest(h, 1e-9)) ^ 2) * value) / sum(exp(-0.5 * (d / greatest(h, 1e-9)) ^ 2)) AS value FROM n JOIN h USING (qid) JOIN v USING (nid) GROUP BY 1", "value")
def neighbour_smooth(spark, d):
    return neighbours.smooth(nn8(spark, d), parts(spark, d).select("id", (F.col("id") * 37 % 101).cast("double").alias("value")))


@query(KN + ", f AS (SELECT id, id % 3 > 0 AS o FROM p), s AS (SELECT qid, sum(exp(-0.5 * (d / 2.0) ^ 2) * o::INT) / sum(exp(-0.5 * (d / 2.0) ^ 2)) AS share FROM n JOIN f ON f.id = nid WHERE qid <> nid GROUP BY 1) SELECT f.id, o AND coalesce(share, 0) >= 0.6 AS on FROM f LEFT JOIN s ON qid = id".replace(" AS on ", ' AS "on" '))
def consensus_erosion(spark, d):
    return neighbours.erode(nn8(spark, d), parts(spark, d).select("id", (F.col("id") % 3 > 0).alias("on")), 2.0)


# inference: samples are return flags, cells are part sizes, genes are suppliers modulo 20

LOCAL = "SELECT l_returnflag AS sample_id, 'g' || (l_suppkey % 20) AS gene, p_size::BIGINT AS qid, avg(l_quantity) AS mu, greatest(var_pop(l_quantity), 1e-12) AS s2, count(*)::DOUBLE AS neff FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3"
CON = f"""l AS ({LOCAL}), c0 AS (SELECT a.gene, a.sample_id AS contrast, a.qid, a.mu - r.mu AS y, a.s2 / a.neff + r.s2 / r.neff AS v0, least(a.neff, r.neff) >= 12 AS use FROM l a JOIN l r ON r.sample_id = 'A' AND r.gene = a.gene AND r.qid = a.qid WHERE a.sample_id <> 'A'),
c AS (SELECT gene, contrast, qid, y, greatest(v0, 0.1 * median(v0) OVER (PARTITION BY gene, contrast)) AS v, use FROM c0)"""


def local(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    g = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col("l_returnflag").alias("sample_id"), F.concat(F.lit("g"), F.col("l_suppkey") % 20).alias("gene"), F.col("p_size").cast("long").alias("qid"))
    return g.agg(F.avg("l_quantity").alias("mu"), F.greatest(F.var_pop("l_quantity"), F.lit(1e-12)).alias("s2"), F.count(F.lit(1)).cast("double").alias("neff"))


def con(spark, d):
    return inference.contrasts(local(spark, d), "A", 12)


@query(f"WITH {CON} SELECT gene, contrast, qid, y, v, 1 / v AS w, use FROM c", "y v w", 5)
def contrast_vs_reference(spark, d):
    return con(spark, d).drop("mu")


@query(f"WITH {CON}, t AS (SELECT *, abs(y) / sqrt(v) AS t0 FROM c WHERE use), q AS (SELECT *, quantile_cont(t0, 0.3) OVER (PARTITION BY gene, contrast) AS lim FROM t) SELECT gene, qid, avg((t0 <= lim)::INT) >= 0.6 AS anchor FROM q GROUP BY 1, 2")
def anchor_mask(spark, d):
    return inference.anchors(con(spark, d))


RIDGE = "b AS (SELECT gene, contrast, sum(y / v) / (sum(1 / v) + 10) AS beta, count(*) AS n FROM c WHERE use GROUP BY 1, 2)"


@query(f"WITH {CON}, {RIDGE} SELECT * FROM b", "beta")
def ridge_intercept(spark, d):
    return inference.ridge_intercept(con(spark, d))


@query(f"WITH {CON}, s AS (SELECT gene, contrast, sum(1 / v) AS s0, sum(z / v) AS s1, sum(z * z / v) + 10 AS s2, sum(y / v) AS t0, sum(z * y / v) AS t1 FROM (SELECT *, qid / 25.0 - 1 AS z FROM c WHERE use) GROUP BY 1, 2) SELECT gene, contrast, (s2 * t0 - s1 * t1) / (s0 * s2 - s1 * s1) AS b0, (s0 * t1 - s1 * t0) / (s0 * s2 - s1 * s1) AS b1 FROM s", "b0 b1", 5)
def ridge_covariate(spark, d):
    return inference.ridge_two(con(spark, d).withColumn("z", F.col("qid") / 25 - 1), "z")


Z3 = "z AS (SELECT *, qid / 25.0 - 1 AS z1, (qid * 7 % 11) / 5.0 - 1 AS z2 FROM c WHERE use), s AS (SELECT gene, contrast, count(*) AS n, sum(1 / v) AS a, sum(z1 / v) AS b, sum(z2 / v) AS c, sum(z1 * z1 / v) + 10 AS d, sum(z1 * z2 / v) AS e, sum(z2 * z2 / v) + 10 AS f, sum(y / v) AS r0, sum(z1 * y / v) AS r1, sum(z2 * y / v) AS r2 FROM z GROUP BY 1, 2), k AS (SELECT *, a * (d * f - e * e) - b * (b * f - e * c) + c * (b * e - d * c) AS det FROM s), o AS (SELECT gene, contrast, n, (r0 * (d * f - e * e) - b * (r1 * f - e * r2) + c * (r1 * e - d * r2)) / det AS b0, (a * (r1 * f - e * r2) - r0 * (b * f - e * c) + c * (b * r2 - r1 * c)) / det AS b1, (a * (d * r2 - r1 * e) - b * (b * r2 - r1 * c) + r0 * (b * e - d * c)) / det AS b2 FROM k)"


def two_covariates(spark, d):
    rows = con(spark, d).withColumn("z1", F.col("qid") / 25 - 1).withColumn("z2", (F.col("qid") * 7 % 11) / 5 - 1)
    return rows, inference.ridge(rows, ["z1", "z2"])


@query(f"WITH {CON}, {Z3} SELECT * FROM o", "b0 b1 b2", 5)
def ridge_covariates(spark, d):
    return two_covariates(spark, d)[1].select("gene", "contrast", "n", *[F.get("b", F.lit(k)).alias(f"b{k}") for k in range(3)])


@query(f"WITH {CON}, {Z3} SELECT z.gene, z.contrast, qid, y - b1 * z1 - b2 * z2 AS y_adj, CASE WHEN n >= 5 THEN (y - b0 - b1 * z1 - b2 * z2) / sqrt(v) END AS t, greatest(n - 3, 5)::DOUBLE AS df FROM z JOIN o ON o.gene = z.gene AND o.contrast = z.contrast", "y_adj t", 4)
def adjusted_effects(spark, d):
    """Grid effects with the part that two covariates explain taken off."""
    rows, fit = two_covariates(spark, d)
    return inference.adjusted(rows, fit, ["z1", "z2"]).filter("use").select("gene", "contrast", "qid", "y_adj", "t", "df")


@query(f"WITH {CON}, {Z3.replace(') + 10 AS', ') AS')}, b AS (SELECT z.gene, z.contrast, z.qid, z.y - b1 * z1 - b2 * z2 AS y_adj, CASE WHEN n >= 5 THEN (z.y - b0 - b1 * z1 - b2 * z2) / sqrt(z.v) END AS t, greatest(n - 3, 5)::DOUBLE AS df FROM z JOIN o ON o.gene = z.gene AND o.contrast = z.contrast) SELECT *, 0.0::DOUBLE AS lam FROM b", "y_adj t lam", 4)
def fitted_plan(spark, d):
    """The inference plan with two free covariates and no risk."""
    from .plans import inference as plan

    stats = local(spark, d)
    cells = stats.select("qid").distinct().select("qid", (F.col("qid") / 25 - 1).alias("z1"), ((F.col("qid") * 7 % 11) / 5 - 1).alias("z2"))
    return plan.fit_stats(stats, "A", neff_min=12, covariates=cells).tests.filter("use").select("gene", "contrast", "qid", "y_adj", "t", "df", F.col("lambda").alias("lam"))


@query()
def trajectory_pretest(spark, d):
    rows = con(spark, d)
    tests = inference.local_tests(rows, inference.ridge_intercept(rows)).withColumn("ord", F.col("contrast"))
    return inference.trajectory_pretest(tests).select("gene", "contrast", "qid", "z", "p", "q", "sig")


@query()
def local_t_p(spark, d):
    rows = con(spark, d)
    return inference.local_tests(rows, inference.ridge_intercept(rows)).select("gene", "contrast", "qid", "t", "df", "p", "q", "sig")


RISK = "k AS (SELECT p_size::BIGINT AS qid, avg(p_retailprice - 945) / 10 AS risk, p_size % 7 > 0 AS use FROM part GROUP BY p_size), x AS (SELECT quantile_cont(greatest(risk, 0), 0.95) AS cap FROM k WHERE use), r AS (SELECT qid, use, least(1, greatest(risk, 0) / greatest(cap, 1e-8)) AS r01 FROM k, x)"


def risk(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_size").cast("long").alias("qid")).agg((F.avg(F.col("p_retailprice") - 945) / 10).alias("risk"))
    return inference.risk01(p.withColumn("use", F.col("qid") % 7 > 0)).select("qid", "use", "r01")


@query(f"WITH {RISK} SELECT * FROM r", "r01")
def r01_normalised(spark, d):
    return risk(spark, d)


@query(f"WITH {RISK} SELECT avg((r01 > 0.6)::INT) AS global_risk FROM r WHERE use", "global_risk")
def r01_global(spark, d):
    return inference.global_risk(risk(spark, d))


BINS = f"""WITH {CON}, {RISK}, t AS (SELECT y / sqrt(v) AS t, r01 FROM c JOIN r USING (qid) WHERE c.use), z AS (SELECT list_sort(list_distinct(quantile_cont(r01, [1/6, 2/6, 3/6, 4/6, 5/6]))) AS b FROM t),
u AS (SELECT t, r01, len(list_filter(b, lambda x: x < r01)) AS bin FROM t, z), m AS (SELECT *, median(t) OVER (PARTITION BY bin) AS centre FROM u),
bins AS (SELECT bin, any_value(centre) AS centre, avg(r01) AS r, count(*) AS n, 1.4826 * median(abs(t - centre)) AS scale FROM m GROUP BY bin)"""


def bins(spark, d):
    rows = con(spark, d).filter("use").join(risk(spark, d).select("qid", "r01"), "qid").withColumn("t", F.col("y") / F.sqrt("v"))
    return inference.risk_bins(rows, 6)


@query(BINS + " SELECT * FROM bins", "centre r scale", 5)
def risk_bins(spark, d):
    return bins(spark, d).withColumn("bin", F.col("bin").cast("long"))


@query(BINS + """, b AS (SELECT bin AS i, greatest((scale / 0.9) ^ 2 - 1, 0) AS y, n::DOUBLE AS w, r FROM bins), p AS (SELECT j.i AS j, k.i AS k, sum(b.w * b.y) / sum(b.w) AS m FROM b j JOIN b k ON j.i <= k.i JOIN b ON b.i BETWEEN j.i AND k.i GROUP BY 1, 2),
iso AS (SELECT b.i, p.j, min(p.m) AS m FROM b JOIN p ON p.j <= b.i AND p.k >= b.i GROUP BY 1, 2), f AS (SELECT b.i, r, w, max(iso.m) AS fit FROM b JOIN iso USING (i) GROUP BY 1, 2, 3)
SELECT least(50000, greatest(0, sum(w * r * r * fit) / greatest(sum(w * r ^ 4), 1e-12))) AS lam FROM f""", "lam", 4)
def calibrate_lambda(spark, d):
    return inference.calibrate(bins(spark, d), 0.9).withColumnRenamed("lambda", "lam")


@query(f"WITH {CON}, {RISK} SELECT gene, contrast, qid, v * (1 + 2.5 * r01 * r01) AS v FROM c JOIN r USING (qid)", "v", 5)
def variance_inflation(spark, d):
    return inference.inflated(con(spark, d), risk(spark, d), 2.5).select("gene", "contrast", "qid", "v")


@query(f"WITH l AS ({LOCAL}) SELECT qid, 1 - sum(a.mu * b.mu) / sqrt(sum(a.mu * a.mu) * sum(b.mu * b.mu)) AS risk FROM l a JOIN l b USING (qid, gene) WHERE a.sample_id = 'A' AND b.sample_id = 'N' GROUP BY qid", "risk")
def cosine_risk(spark, d):
    side = lambda s: local(spark, d).filter(F.col("sample_id") == s).select("qid", F.col("gene").alias("feature"), F.col("mu").alias("value"))
    return inference.cosine_risk(side("A"), side("N"))


@query(f"""WITH l AS ({LOCAL}), g AS (SELECT a.gene, var_pop(a.mu) AS variance, avg(a.mu - b.mu) AS delta, corr(a.mu, b.mu) + 0.3 AS cor FROM l a JOIN l b USING (qid, gene) WHERE a.sample_id = 'A' AND b.sample_id = 'N' GROUP BY a.gene),
q AS (SELECT quantile_cont(variance, 0.5) AS vq, greatest(quantile_cont(abs(delta), 0.1), 0.05) AS dq FROM g) SELECT gene, greatest(cor, 0) * variance AS score FROM g, q WHERE variance >= vq AND abs(delta) <= dq * 20 AND cor >= 0.2 ORDER BY score DESC LIMIT 300""", "score", 5)
def stable_markers(spark, d):
    side = lambda s, n: local(spark, d).filter(F.col("sample_id") == s).select("qid", "gene", F.col("mu").alias(n))
    g = side("A", "a").join(side("N", "b"), ["qid", "gene"]).groupBy("gene").agg(F.var_pop("a").alias("variance"), F.avg(F.col("a") - F.col("b")).alias("delta"), (F.corr("a", "b") + 0.3).alias("cor"))
    q = g.agg(F.greatest(F.percentile(F.abs("delta"), F.lit(0.1)), F.lit(0.05)).alias("dq")).first()[0]
    return inference.stable_markers(g, delta_least=q * 20)


# rasters

PTS = f"WITH pts AS (SELECT sample_id, cluster, x, y FROM ({SQL_POINTS})), ras AS ({SQL_RASTER})"


@query(f"{PTS} SELECT * FROM ras")
def raster_hist(spark, d):
    return point_raster(spark, d)


@query(f"""{PTS}, t AS (SELECT iy, ix, sum(v) AS s FROM ras GROUP BY 1, 2), q AS (SELECT greatest(quantile_cont(ln(1 + s), 0.99), 1e-8) AS q FROM t)
SELECT cluster AS channel, iy, ix, v / greatest(s, 1e-8) * sqrt(0.6) AS v FROM ras JOIN t USING (iy, ix) UNION ALL SELECT 'density', iy, ix, least(1, ln(1 + s) / q) FROM t, q""", "v")
def composition_density(spark, d):
    return raster.channels(point_raster(spark, d))


BLUR = "(SELECT k, exp(-0.5 * k * k) / (SELECT sum(exp(-0.5 * j * j)) FROM range(-4, 5) t(j)) AS w FROM range(-4, 5) t(k))"


@query(f"""{PTS}, a AS (SELECT cluster, t AS iy, ix, sum(v * w) AS v FROM ras, range(27) r(t), {BLUR} b WHERE greatest(0, least(26, t + k)) = iy GROUP BY 1, 2, 3),
c AS (SELECT cluster, iy, t AS ix, sum(v * w) AS v FROM a, range(13) r(t), {BLUR} b WHERE greatest(0, least(12, t + k)) = ix GROUP BY 1, 2, 3) SELECT * FROM c WHERE v > 1e-9""", "v", 5)
def gaussian_blur(spark, d):
    return raster.blur(point_raster(spark, d), 1.0, 13, 27).filter("v > 1e-9")


A, B = sql_masks("p_type"), sql_masks("p_brand")
OV = f"a AS ({A}), b AS ({B}), na AS (SELECT mask, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT mask, count(*) AS n FROM b GROUP BY 1), o AS (SELECT a.mask AS a, b.mask AS b, count(*) AS both FROM a JOIN b USING (iy, ix) GROUP BY 1, 2 HAVING count(*) >= 20), ov AS (SELECT o.b, o.a, both, na.n AS na, nb.n AS nb, 2 * both / (na.n + nb.n) AS dice, both / (na.n + nb.n - both) AS iou FROM o JOIN na ON na.mask = o.a JOIN nb ON nb.mask = o.b)".replace("both", '"both"')


def mask_pairs(spark, d):
    return raster.overlaps(masks(spark, d, "p_type"), masks(spark, d, "p_brand"), 20)


@query(f"WITH {OV} SELECT * FROM ov", "dice iou")
def dice_iou(spark, d):
    return mask_pairs(spark, d)


@query(f"WITH {OV} SELECT a, b, exp(-abs(ln(na / nb))) AS area_sim FROM ov", "area_sim")
def area_sim(spark, d):
    from .functions.columns import area_similarity

    return mask_pairs(spark, d).select("a", "b", area_similarity(F.col("na"), F.col("nb")).alias("area_sim"))


def sql_boundary(m: str) -> str:
    return f"(SELECT * FROM {m} x WHERE NOT EXISTS (SELECT 1 FROM {m} y WHERE y.mask = x.mask AND y.iy = x.iy - 1 AND y.ix = x.ix) OR NOT EXISTS (SELECT 1 FROM {m} y WHERE y.mask = x.mask AND y.iy = x.iy + 1 AND y.ix = x.ix) OR NOT EXISTS (SELECT 1 FROM {m} y WHERE y.mask = x.mask AND y.iy = x.iy AND y.ix = x.ix - 1) OR NOT EXISTS (SELECT 1 FROM {m} y WHERE y.mask = x.mask AND y.iy = x.iy AND y.ix = x.ix + 1))"


@query(f"WITH a AS ({A}) SELECT * FROM {sql_boundary('a')}")
def boundary_pixels(spark, d):
    return raster.boundary(masks(spark, d, "p_type"))


SURF = f"""WITH {OV}, ba AS {sql_boundary('a')}, bb AS {sql_boundary('b')}, prs AS (SELECT ov.a, ov.b, ba.iy AS ay, ba.ix AS ax, bb.iy AS "by", bb.ix AS bx, sqrt(((ba.iy - bb.iy) ** 2 + (ba.ix - bb.ix) ** 2)::DOUBLE) AS d FROM ov JOIN ba ON ba.mask = ov.a JOIN bb ON bb.mask = ov.b),
s AS (SELECT a, b, 'a' AS side, min(d) AS d FROM prs GROUP BY a, b, ay, ax UNION ALL SELECT a, b, 'b', min(d) FROM prs GROUP BY a, b, "by", bx), g AS (SELECT a, b, side, avg(d) AS m, sum(d) AS s, count(*) AS n, max(d) AS x FROM s GROUP BY 1, 2, 3)
SELECT a, b, avg(m) AS chamfer, sum(s) / sum(n) AS asd, max(x) AS hd, exp(-avg(m) / 25) AS chamfer_sim FROM g GROUP BY 1, 2"""


@query(SURF, "chamfer asd hd chamfer_sim")
def surface_distances(spark, d):
    a, b = masks(spark, d, "p_type"), masks(spark, d, "p_brand")
    return raster.surface(raster.boundary_distance(mask_pairs(spark, d), raster.boundary(a), raster.boundary(b)))


@query(f"""WITH a AS ({A}), c AS (SELECT *, iy - avg(iy) OVER (PARTITION BY mask) AS dy, ix - avg(ix) OVER (PARTITION BY mask) AS dx FROM a), s AS (SELECT mask, least(71, floor((atan2(dy, dx) + pi()) / (2 * pi()) * 72))::BIGINT AS bin, max(sqrt(dy * dy + dx * dx)) AS r FROM c GROUP BY 1, 2)
SELECT mask, bin, r / greatest(max(r) OVER (PARTITION BY mask), 1e-12) AS r FROM s""", "r")
def polar_signature(spark, d):
    return raster.polar_signature(masks(spark, d, "p_type"))


@query(f"WITH {OV}, ra AS (SELECT mask, iy, count(*) AS x FROM a GROUP BY 1, 2), rb AS (SELECT mask, iy, count(*) AS y FROM b GROUP BY 1, 2), sa AS (SELECT mask, sqrt(sum(x * x)) AS s FROM ra GROUP BY 1), sb AS (SELECT mask, sqrt(sum(y * y)) AS s FROM rb GROUP BY 1) SELECT ov.a, ov.b, sum(x * y) / any_value(sa.s * sb.s) AS depth_cosine FROM ov JOIN ra ON ra.mask = ov.a JOIN rb ON rb.mask = ov.b AND rb.iy = ra.iy JOIN sa ON sa.mask = ov.a JOIN sb ON sb.mask = ov.b GROUP BY 1, 2", "depth_cosine")
def depth_profile(spark, d):
    return raster.depth_profile_cosine(mask_pairs(spark, d), masks(spark, d, "p_type"), masks(spark, d, "p_brand"))


@query(f"WITH a AS ({A}), m AS (SELECT mask, iy, 25 - ix AS ix FROM a), n AS (SELECT mask, count(*) AS n FROM a GROUP BY 1), o AS (SELECT a.mask AS a, m.mask AS b, count(*) AS c FROM a JOIN m USING (iy, ix) WHERE a.mask < m.mask GROUP BY 1, 2) SELECT a, b, 2 * c / (x.n + y.n) AS dice FROM o JOIN n x ON x.mask = a JOIN n y ON y.mask = b", "dice")
def reflect_overlap(spark, d):
    return raster.mirrored_overlap(masks(spark, d, "p_type"), 26).select("a", "b", "dice")


@query(f"WITH {OV}, t AS (SELECT *, row_number() OVER (PARTITION BY b ORDER BY iou DESC, a) AS rn FROM ov) SELECT x.b, x.a AS a1, y.a AS a2 FROM t x JOIN t y ON x.b = y.b AND x.a < y.a WHERE x.rn <= 3 AND y.rn <= 3")
def pair_union(spark, d):
    return raster.pair_unions(mask_pairs(spark, d).withColumn("score", F.col("iou")), 3)


@query()
def greedy_match(spark, d):
    return raster.greedy(mask_pairs(spark, d).withColumn("score", F.col("iou")))


@query("WITH r AS (SELECT l_linenumber AS iy, l_suppkey % 9 AS ix, min(l_orderkey) % 25 AS label FROM lineitem GROUP BY 1, 2), p AS (SELECT o_orderkey AS id, greatest(0, least(8, round_even(o_custkey % 100 / 10.0, 0)))::INT AS ix, greatest(0, least(7, round_even(o_custkey % 37 / 4.0, 0)))::INT AS iy FROM orders) SELECT id, coalesce(r.label, 0) AS label, coalesce(n_name, 'outside') AS name FROM p LEFT JOIN r USING (iy, ix) LEFT JOIN nation ON n_nationkey = r.label")
def label_transfer(spark, d):
    r = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("iy"), (F.col("l_suppkey") % 9).alias("ix")).agg((F.min("l_orderkey") % 25).alias("label"))
    p = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100 / 10).alias("x"), (F.col("o_custkey") % 37 / 4).alias("y"))
    return raster.label_transfer(p, r, table(spark, d, "nation").select(F.col("n_nationkey").alias("label"), F.col("n_name").alias("name")), 9, 8)


PATHS = "SELECT s_suppkey AS id, '/' || n_regionkey || '/' || (100 + n_nationkey) || '/' || (1000 + s_suppkey) || '/' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey"


def paths(spark, d):
    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), F.concat(F.lit("/"), "n_regionkey", F.lit("/"), F.col("n_nationkey") + 100, F.lit("/"), F.col("s_suppkey") + 1000, F.lit("/")).alias("path"))


@query(f"WITH p AS ({PATHS}), k AS (SELECT id, unnest([2, 3]) AS k, string_split(trim(path, '/'), '/') AS parts FROM p) SELECT '/' || array_to_string(parts[1:k], '/') || '/' AS prefix, array_to_string(list_sort(list(DISTINCT id)), ',') AS leaves, count(DISTINCT id) AS n FROM k GROUP BY 1")
def prefix_explode(spark, d):
    p = paths(spark, d)
    return raster.path_prefixes(p, p.select("id")).withColumn("leaves", F.array_join(F.col("leaves").cast("array<string>"), ","))


@query(f"""WITH {OV}, pre AS (SELECT left(mask, 8) AS candidate, mask AS label FROM nb UNION ALL SELECT mask, mask FROM nb), c AS (SELECT a AS cluster, candidate, sum("both") AS s FROM (SELECT a.mask AS a, b.mask AS b, count(*) AS "both" FROM a JOIN b USING (iy, ix) GROUP BY 1, 2) JOIN pre ON b = label GROUP BY 1, 2),
z AS (SELECT candidate, sum(n) AS ca FROM pre JOIN nb ON mask = label GROUP BY 1), q AS (SELECT cluster, candidate, 2 * s / (ca + na.n) AS dice FROM c JOIN z USING (candidate) JOIN na ON na.mask = cluster) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY dice DESC, candidate) AS rank FROM q WHERE dice >= 0.05) WHERE rank <= 6""", "dice")
def candidate_join(spark, d):
    a, b = masks(spark, d, "p_type"), masks(spark, d, "p_brand")
    ov = raster.overlaps(a, b).select(F.col("a").alias("cluster"), F.col("b").alias("label"), "both")
    nb = raster.areas(b).withColumnRenamed("mask", "label")
    sets = nb.select(F.substring("label", 1, 8).alias("candidate"), "label").union(nb.select("label", "label"))
    return raster.candidates(ov, sets, raster.areas(a).withColumnRenamed("mask", "cluster"), nb, 0.05, 6).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH a AS ({A}), n AS (SELECT mask AS channel, count(*) AS area FROM a GROUP BY 1), w AS (SELECT *, 1 / sqrt(area) AS w FROM n), v AS (SELECT channel, area, least(2, greatest(0.5, w / (SELECT avg(w) FROM w))) AS w FROM w) SELECT channel, area, w / (SELECT avg(w) FROM v) AS w FROM v", "w")
def channel_weights(spark, d):
    return raster.channel_weights(raster.areas(masks(spark, d, "p_type")).withColumnRenamed("mask", "channel"))


@query("SELECT n_regionkey AS group_id, array_to_string(list_sort(list_distinct(flatten(list([n_nationkey, n_nationkey % 3])))), ',') AS source_ids, array_to_string(list_sort(list_distinct(flatten(list([n_nationkey % 4])))), ',') AS target_ids FROM nation GROUP BY 1")
def ui_groups(spark, d):
    n = F.col("n_nationkey")
    g = raster.pairing_groups(table(spark, d, "nation").withColumnRenamed("n_regionkey", "group_id"), F.array(n, n % 3), F.array(n % 4))
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return g.select("group_id", text("source_ids"), text("target_ids"))


# replicate uncertainty: days are repeats, users are points

REP = "SELECT day(ts) AS repeat, user_id AS point, avg(value) AS x, avg(event_id % 100) AS y, mode(event_type) AS label FROM events GROUP BY 1, 2"


def replicates(spark, d):
    return table(spark, d, "events").groupBy(F.dayofmonth("ts").cast("long").alias("repeat"), F.col("user_id").alias("point")).agg(F.avg("value").alias("x"), F.avg(F.col("event_id") % 100).alias("y"))


@query(f"""WITH r AS ({REP}), m AS (SELECT *, avg(x) OVER (PARTITION BY point) AS mx, avg(y) OVER (PARTITION BY point) AS my FROM r),
g AS (SELECT point, count(*) AS n, any_value(mx) AS mean_x, any_value(my) AS mean_y, coalesce(var_samp(x), 0) AS var_x, coalesce(var_samp(y), 0) AS var_y, avg(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS dist_mean, coalesce(var_samp(sqrt((x - mx) ** 2 + (y - my) ** 2)), 0) AS dist_var, max(sqrt((x - mx) ** 2 + (y - my) ** 2)) AS dist_max FROM m GROUP BY 1)
SELECT *, sqrt(var_x + var_y) AS std_total FROM g""", "mean_x mean_y var_x var_y dist_mean dist_var dist_max std_total", 5)
def point_uncertainty(spark, d):
    from .operators.uncertainty import point_spread

    return point_spread(replicates(spark, d))


@query(f"WITH r AS ({REP}), v AS (SELECT point, var_samp(x) + var_samp(y) AS v FROM r GROUP BY 1), q AS (SELECT median(v) AS median, quantile_cont(v, 0.95) AS p95, max(v) AS max FROM v) SELECT median, p95, max, (SELECT count(*) FROM v, q WHERE v >= p95) AS n_tail FROM q", "median p95 max", 4)
def distribution_report(spark, d):
    from .operators.uncertainty import report

    v = replicates(spark, d).groupBy("point").agg((F.var_samp("x") + F.var_samp("y")).alias("v"))
    return report(v, "v")
