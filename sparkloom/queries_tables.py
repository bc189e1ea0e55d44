"""Queries over expression tables, contracts, text functions, geometry and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import columns as C
from .operators import contracts, expression, geometry, ranking
from .registry import query
from .views import SQL_COUNTS, SQL_PARTS, SQL_POINTS, counts, parts, points, similar, sql_similar, table

N = "(SELECT count(DISTINCT obs) FROM e)"


@query(f"SELECT gene, count(*) FILTER (value > 0) AS detected_spots, sum(value) AS total_counts FROM ({SQL_COUNTS}) GROUP BY gene", "total_counts")
def gene_support(spark, d):
    return expression.gene_support(counts(spark, d))


@query(f"""WITH e AS ({SQL_COUNTS}), g AS (SELECT gene, count(*) FILTER (value > 0) >= 0.2 * {N} AS used FROM e GROUP BY gene),
r AS (SELECT e.*, used, sum(CASE WHEN used THEN greatest(value, 0) ELSE 0 END) OVER (PARTITION BY obs) AS lib FROM e JOIN g USING (gene))
SELECT obs, gene, CASE WHEN NOT used THEN value WHEN lib > 0 THEN greatest(value, 0) * 10000.0 / lib ELSE 0 END AS norm FROM r""", "norm")
def library_size_norm(spark, d):
    e = counts(spark, d)
    return expression.library_normalise(e, e.select("obs").distinct().count(), 1e4, 0.2).select("obs", "gene", "norm")


@query(f"SELECT obs, gene, ln(1 + value * 10000.0 / sum(value) OVER (PARTITION BY obs)) AS norm FROM ({SQL_COUNTS})", "norm")
def log1p_norm(spark, d):
    return expression.log1p_normalise(counts(spark, d)).select("obs", "gene", "norm")


SAMPLES = "SELECT DISTINCT o_orderstatus AS sample_id, 'g' || (l_suppkey % 60) AS gene, l_orderkey AS obs FROM lineitem JOIN orders ON l_orderkey = o_orderkey"


def _sampled(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    return li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderstatus").alias("sample_id"), F.concat(F.lit("g"), F.col("l_suppkey") % 60).alias("gene"), F.col("l_orderkey").alias("obs")).distinct()


@query(f"SELECT gene FROM ({SAMPLES}) GROUP BY gene HAVING count(DISTINCT sample_id) = (SELECT count(DISTINCT o_orderstatus) FROM orders)")
def gene_intersection(spark, d):
    return expression.shared_genes(_sampled(spark, d))


STRATA = "SELECT o_orderstatus AS sample_id, o_orderpriority AS obs, 'g' || l_suppkey AS gene, sum(l_quantity) AS value FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3"


@query(f"""WITH e AS ({STRATA}), o AS (SELECT DISTINCT sample_id, obs FROM e), g AS (SELECT DISTINCT gene FROM e)
SELECT o.sample_id, o.obs, g.gene, coalesce(e.value, 0) AS value FROM o CROSS JOIN g LEFT JOIN e ON e.sample_id = o.sample_id AND e.obs = o.obs AND e.gene = g.gene""", "value")
def gene_union_zero_fill(spark, d):
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    e = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderstatus").alias("sample_id"), F.col("o_orderpriority").alias("obs"), F.concat(F.lit("g"), "l_suppkey").alias("gene")).agg(F.sum("l_quantity").alias("value"))
    return expression.union_zero_fill(e, e.select("sample_id", "obs").distinct())


@query(f"""WITH e AS ({SQL_COUNTS}), v AS (SELECT gene, sum(value * value) / {N} - (sum(value) / {N}) * (sum(value) / {N}) AS variance FROM e GROUP BY gene),
r AS (SELECT *, row_number() OVER (ORDER BY variance DESC, gene) AS rank, sum(variance) OVER (ORDER BY variance DESC, gene) AS cum, sum(variance) OVER () AS total FROM v)
SELECT gene, variance, rank, cum / total AS fraction FROM r WHERE cum - variance < 0.5 * total OR rank <= 3""", "variance fraction", 5)
def variance_fraction_genes(spark, d):
    e = counts(spark, d)
    return expression.variance_ranking(e, e.select("obs").distinct().count(), 0.5, 3).withColumn("rank", F.col("rank").cast("long"))


@query(f"""WITH e AS ({SQL_COUNTS}), c AS (SELECT o_orderkey AS obs, o_orderpriority AS cluster FROM orders), n AS (SELECT cluster, count(*) AS n FROM c GROUP BY cluster)
SELECT cluster, gene, sum(ln(1 + value)) / any_value(n) AS mean_log1p FROM e JOIN c USING (obs) JOIN n USING (cluster) GROUP BY cluster, gene""", "mean_log1p")
def pseudobulk(spark, d):
    return expression.pseudobulk(counts(spark, d), table(spark, d, "orders").select(F.col("o_orderkey").alias("obs"), F.col("o_orderpriority").alias("cluster")))


@query("SELECT l_returnflag AS gene, quantile_cont(abs(l_extendedprice - round_even(l_extendedprice, 0)), 0.99) < 1e-6 AND min(l_extendedprice) >= 0 AS is_count FROM lineitem GROUP BY 1 UNION ALL SELECT 'q' || l_returnflag, quantile_cont(abs(l_quantity - round_even(l_quantity, 0)), 0.99) < 1e-6 AND min(l_quantity) >= 0 FROM lineitem GROUP BY 1")
def count_like_columns(spark, d):
    li = table(spark, d, "lineitem")
    return expression.count_like(li.select(F.col("l_returnflag").alias("gene"), F.col("l_extendedprice").alias("value")).union(li.select(F.concat(F.lit("q"), "l_returnflag"), "l_quantity")))


@query(f"SELECT gene, min(value) >= 0 AND count(*) FILTER (value > 0) >= 0.001 * (SELECT count(*) FROM orders) AS is_expression FROM ({SQL_COUNTS}) GROUP BY gene")
def expression_columns(spark, d):
    return expression.public_expression(counts(spark, d), table(spark, d, "orders").count())


@query(f"""SELECT obs, sum(value) FILTER (gene NOT IN ('g0', 'g1')) AS counts, count(*) FILTER (gene NOT IN ('g0', 'g1') AND value > 0) AS genes, coalesce(sum(value) FILTER (gene IN ('g0', 'g1')), 0) AS control, sum(value) AS total
FROM ({SQL_COUNTS}) GROUP BY obs HAVING counts >= 60 AND genes >= 3 AND control <= 0.05 * total""", "counts control total")
def quality_control(spark, d):
    return expression.quality_control(counts(spark, d).withColumn("is_control", F.col("gene").isin("g0", "g1")), 60, 3, 0.05)


@query("SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'right' ELSE 'left' END AS side FROM (SELECT o_orderkey AS k FROM orders GROUP BY 1) a FULL JOIN (SELECT l_orderkey AS k FROM lineitem GROUP BY 1) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def id_set_mismatch(spark, d):
    return contracts.id_mismatch(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def one_to_one_check(spark, d):
    return contracts.duplicates(table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def anti_missing(spark, d):
    return contracts.missing(table(spark, d, "orders"), table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), ["o_orderkey"])


@query("SELECT count(*) AS n, count(*) FILTER (isnan(x) OR isnan(y)) AS bad_xy, count(*) FILTER (cluster IS NULL) AS null_labels, count(DISTINCT sample_id) AS samples, count(*) FILTER (lower(trim(cluster)) IN ('', 'nan', 'none')) AS incomplete FROM (" + SQL_POINTS + ")")
def contract_flags(spark, d):
    return contracts.flags(points(spark, d))


@query("SELECT doc_id, regexp_extract(trim(upper(source)) || '__ACGTACGT-' || (doc_id % 9), '([ACGT]+-[0-9]+)(?:$|\\|)', 1) AS barcode FROM documents")
def barcode_extract(spark, d):
    return table(spark, d, "documents").select("doc_id", C.barcode(F.concat(F.upper("source"), F.lit("__ACGTACGT-"), F.col("doc_id") % 9)).alias("barcode"))


@query("SELECT doc_id, try_cast(nullif(regexp_extract(source, '(\\d+(?:\\.\\d+)?)$', 1), '') AS DOUBLE) AS num, try_cast(nullif(regexp_extract('x age ' || (doc_id % 40) || '.5', 'age\\s*([0-9]+\\.?[0-9]*)', 1), '') AS DOUBLE) AS age FROM documents", "num age")
def trailing_number(spark, d):
    return table(spark, d, "documents").select("doc_id", C.trailing_number(F.col("source")).alias("num"), C.age(F.concat(F.lit("x age "), F.col("doc_id") % 40, F.lit(".5"))).alias("age"))


@query("SELECT DISTINCT o_orderkey % 97 AS k, array_to_string(list_sort(list_distinct([(o_orderkey % 97) % 7, (o_orderkey % 97) % 5, 3])), ',') AS ids FROM orders")
def id_list_parse(spark, d):
    k = F.col("o_orderkey") % 97
    raw = F.concat(F.lit("["), k % 7, F.lit(", "), k % 5, F.lit(".0;3]"))
    return table(spark, d, "orders").select(k.alias("k"), F.array_join(C.id_list(raw).cast("array<string>"), ",").alias("ids")).distinct()


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_props(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '2/3' WHEN p_size % 3 = 1 THEN '6a' END AS layer FROM part")
def layer_regex(spark, d):
    s = F.col("p_size") % 3
    name = F.concat(F.lit("Primary area, "), F.when(s == 0, "Layer 2/3").when(s == 1, "layer 6a").otherwise("layers 7"))
    return table(spark, d, "part").select("p_partkey", C.layer(name).alias("layer"))


@query("SELECT n_nationkey, greatest(0.45, (CASE WHEN n_nationkey < 10 THEN greatest(n_nationkey / 10.0, 0.45) ELSE 1 END) * (CASE WHEN n_regionkey > 2 THEN greatest(2.0 / n_regionkey, 0.45) ELSE 1 END)) AS gate, greatest(0, least(1, 0.3 * (n_nationkey / 25.0) + 0.7 * (n_regionkey / 5.0))) AS score, (n_regionkey / 5.0) * (0.5 + 0.5 / (1 + exp((n_nationkey - 16) / 6.0))) AS gated, exp(-abs(ln((n_nationkey + 1) / (n_regionkey + 1.0)))) AS area_sim, (n_nationkey + 1) * (1 + 3.0 * (n_regionkey / 5.0) ^ 2) AS inflated FROM nation", "gate score gated area_sim inflated")
def pair_scores(spark, d):
    n, r = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, d, "nation").select("n_nationkey", C.gate_factor([(n < 10, n / 10), (r > 2, 2 / F.greatest(r, F.lit(1)))]).alias("gate"), C.composite([(0.3, n / 25), (0.7, r / 5)]).alias("score"), C.distance_gate(r / 5, n.cast("double")).alias("gated"), C.area_similarity(n + 1, r + 1.0).alias("area_sim"), C.inflate(n + 1, r / 5, 3.0).alias("inflated"))


# geometry


@query(f"SELECT sample_id, cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM ({SQL_POINTS}) GROUP BY 1, 2", "cx cy")
def centroids(spark, d):
    return geometry.centroids(points(spark, d))


SHARED = f"WITH {sql_similar()}, c AS (SELECT * FROM (SELECT cluster, avg(x) AS qx, avg(y) AS qy, count(*) AS qn FROM qry GROUP BY 1) JOIN (SELECT cluster, avg(x) AS rx, avg(y) AS ry, count(*) AS rn FROM ref GROUP BY 1) USING (cluster))"
FIT = SHARED + """, m AS (SELECT avg(qx) AS mqx, avg(qy) AS mqy, avg(rx) AS mrx, avg(ry) AS mry, count(*) AS n FROM c),
s AS (SELECT sum((qx - mqx) * (rx - mrx) + (qy - mqy) * (ry - mry)) AS a, sum((qx - mqx) * (ry - mry) - (qy - mqy) * (rx - mrx)) AS b, sum((qx - mqx) ^ 2 + (qy - mqy) ^ 2) AS v FROM c, m),
f AS (SELECT sqrt(a * a + b * b) / v AS scale, atan2(b, a) AS theta FROM s),
fit AS (SELECT scale, theta, mrx - scale * (cos(theta) * mqx - sin(theta) * mqy) AS tx, mry - scale * (sin(theta) * mqx + cos(theta) * mqy) AS ty, 1.0 AS mirror, n FROM f, m)"""


@query(SHARED + " SELECT * FROM c", "qx qy rx ry")
def shared_centroids(spark, d):
    return geometry.shared_centroids(similar(spark, d, "N"), similar(spark, d, "A"))


@query(FIT + " SELECT * FROM fit", "scale theta tx ty mirror")
def procrustes(spark, d):
    return geometry.procrustes(geometry.shared_centroids(similar(spark, d, "N"), similar(spark, d, "A")))


@query(FIT + " SELECT cluster, count(*) AS n, avg(scale * (cos(theta) * x - sin(theta) * y) + tx) AS mx, avg(scale * (sin(theta) * x + cos(theta) * y) + ty) AS my FROM (SELECT q.*, fit.scale, fit.theta, fit.tx, fit.ty FROM qry q, fit) GROUP BY 1", "mx my")
def similarity_apply(spark, d):
    q = similar(spark, d, "N")
    fit = geometry.procrustes(geometry.shared_centroids(q, similar(spark, d, "A")))
    return geometry.transform(q, fit).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("x_prealigned").alias("mx"), F.avg("y_prealigned").alias("my"))


@query(f"SELECT median(n) AS n_typical FROM (SELECT count(*) AS n FROM ({SQL_POINTS}) GROUP BY sample_id)", "n_typical")
def typical_sample_size(spark, d):
    return geometry.typical_size(points(spark, d))


@query(f"WITH b AS (SELECT min(x) AS a, max(x) AS b, min(y) AS c, max(y) AS d FROM ({SQL_POINTS})), g AS (SELECT (a + b) / 2 - (b - a) / 2 * 1.05 AS x0, (a + b) / 2 + (b - a) / 2 * 1.05 AS x1, (c + d) / 2 - (d - c) / 2 * 1.05 AS y0, (c + d) / 2 + (d - c) / 2 * 1.05 AS y1 FROM b) SELECT *, ceil((x1 - x0) / 2.5)::BIGINT AS nx, ceil((y1 - y0) / 2.5)::BIGINT AS ny FROM g", "x0 x1 y0 y1")
def bbox_grid(spark, d):
    return geometry.shared_box(points(spark, d), 2.5)


@query(f"SELECT id, cluster FROM (SELECT *, row_number() OVER (PARTITION BY cluster, floor(x / 5), floor(y / 5) ORDER BY id) AS rn FROM ({SQL_PARTS})) WHERE rn = 1")
def grid_thin(spark, d):
    return geometry.thin(parts(spark, d), 5.0, ["id"]).select("id", "cluster")


@query(f"SELECT id FROM ({SQL_PARTS}) WHERE x <= (SELECT quantile_cont(x, 0.4) FROM ({SQL_PARTS}))")
def half_crop(spark, d):
    return geometry.half_crop(parts(spark, d), "x", 0.4).select("id")


@query(f"""WITH c AS (SELECT cluster, var_samp(x) AS vx, var_samp(y) AS vy, covar_samp(x, y) AS vxy FROM ({SQL_PARTS}) GROUP BY 1),
e AS (SELECT cluster, (vx + vy) / 2 + sqrt(((vx - vy) / 2) ^ 2 + vxy * vxy) AS l1, greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ^ 2 + vxy * vxy), 0) AS l2 FROM c)
SELECT *, sqrt(l1 / greatest(l2, 1e-12)) AS elongation, (l1 - l2) / greatest(l1 + l2, 1e-12) AS anisotropy FROM e""", "l1 l2 elongation anisotropy")
def pca_shape(spark, d):
    return geometry.shape_pca(parts(spark, d))


@query(f"WITH q AS (SELECT cluster, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS width, quantile_cont(y, 0.75) - quantile_cont(y, 0.25) AS height FROM ({SQL_PARTS}) GROUP BY 1) SELECT *, width / greatest(height, 1e-12) AS aspect, width * height AS area FROM q", "width height aspect area")
def robust_bbox(spark, d):
    return geometry.quartile_box(parts(spark, d))


@query(f"WITH c AS (SELECT sample_id, avg(x) AS cx, avg(y) AS cy, var_pop(x) AS vx, var_pop(y) AS vy, covar_pop(x, y) AS vxy FROM ({SQL_POINTS}) GROUP BY 1) SELECT sample_id, cx, cy, 2 * sqrt((vx + vy) / 2 + sqrt(((vx - vy) / 2) ^ 2 + vxy * vxy)) AS major, 2 * sqrt(greatest((vx + vy) / 2 - sqrt(((vx - vy) / 2) ^ 2 + vxy * vxy), 0)) AS minor, 0.5 * atan2(2 * vxy, vx - vy) AS angle FROM c", "cx cy major minor angle", 5)
def ellipse_fit(spark, d):
    return geometry.ellipse(points(spark, d))


SWEEP = f"""WITH p AS ({SQL_PARTS}), q AS (SELECT x, y FROM p WHERE sample_id < 'Brand#2'), r AS (SELECT x, y FROM p WHERE sample_id >= 'Brand#2'),
c AS (SELECT a * 30.0 AS angle, s AS scale FROM range(12) t(a), (VALUES (0.9), (1.0)) v(s)),
m AS (SELECT angle, scale, floor((scale * (cos(radians(angle)) * (x - mx) - sin(radians(angle)) * (y - my)) + rx) / 5)::BIGINT AS px, floor((scale * (sin(radians(angle)) * (x - mx) + cos(radians(angle)) * (y - my)) + ry) / 5)::BIGINT AS py
FROM (SELECT q.x, q.y, (SELECT avg(x) FROM q) AS mx, (SELECT avg(y) FROM q) AS my, (SELECT avg(x) FROM r) AS rx, (SELECT avg(y) FROM r) AS ry, c.angle, c.scale FROM q, c)),
d AS (SELECT DISTINCT * FROM m), t AS (SELECT DISTINCT floor(x / 5)::BIGINT AS px, floor(y / 5)::BIGINT AS py, 1 AS hit FROM r),
h AS (SELECT angle, scale, count(*) AS nq, count(hit) AS both_ FROM d LEFT JOIN t USING (px, py) GROUP BY 1, 2)
SELECT angle, scale::DOUBLE AS scale, both_ / (nq + (SELECT count(*) FROM t) - both_) AS iou FROM h"""


@query(SWEEP, "angle scale iou")
def iou_sweep(spark, d):
    p = parts(spark, d)
    return geometry.iou_sweep(p.filter("sample_id < 'Brand#2'"), p.filter("sample_id >= 'Brand#2'"), 5.0, 30.0, (0.9, 1.0))


# rankings and robust statistics

TESTS = "SELECT o_orderkey AS id, o_orderstatus AS gene, o_orderpriority AS contrast, (o_orderkey * 7919 % 100003) / 100003.0 AS p FROM orders"


def tests(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("gene"), F.col("o_orderpriority").alias("contrast"), (F.col("o_orderkey") * 7919 % 100003 / 100003).alias("p"))


@query(f"""WITH t AS ({TESTS}), r AS (SELECT *, p * count(*) OVER (PARTITION BY gene, contrast) / (SELECT 1 + 0 * 1) / count(*) OVER (PARTITION BY gene, contrast ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS a FROM t)
SELECT id, least(1, min(a) OVER (PARTITION BY gene, contrast ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM r""", "q")
def bh_qvalues(spark, d):
    return ranking.bh(tests(spark, d), ["gene", "contrast"]).select("id", "q")


TERM = "CASE WHEN least(greatest(p, 1e-15), 1 - 1e-15) < 1e-12 THEN 1 / (pi() * least(greatest(p, 1e-15), 1 - 1e-15)) ELSE tan((0.5 - least(greatest(p, 1e-15), 1 - 1e-15)) * pi()) END"
TAIL = "CASE WHEN t > 1e15 THEN 1 / (pi() * t) ELSE 0.5 - atan(t) / pi() END"


@query(f"SELECT gene, contrast, {TAIL} AS p, n FROM (SELECT gene, contrast, avg({TERM}) AS t, count(*) AS n FROM ({TESTS}) WHERE p > 0 AND p < 1 GROUP BY 1, 2)", "p")
def acat(spark, d):
    return ranking.acat(tests(spark, d), ["gene", "contrast"])


@query(f"WITH c AS (SELECT gene, contrast, {TAIL} AS p, n FROM (SELECT gene, contrast, avg({TERM}) AS t, count(*) AS n FROM ({TESTS}) WHERE p > 0 AND p < 1 GROUP BY 1, 2)) SELECT gene, {TAIL} AS p, n_tests FROM (SELECT gene, sum(n * ({TERM})) / sum(n) AS t, sum(n)::BIGINT AS n_tests FROM c GROUP BY gene)", "p")
def acat_two_level(spark, d):
    return ranking.gene_acat(tests(spark, d))


VALUES = "SELECT event_id AS id, event_type AS g, value AS v FROM events"


def values(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("g"), F.col("value").alias("v"))


@query(f"WITH m AS (SELECT *, median(v) OVER (PARTITION BY g) AS m FROM ({VALUES})), s AS (SELECT *, 1.4826 * median(abs(v - m)) OVER (PARTITION BY g) AS s FROM m) SELECT id, CASE WHEN s < 1e-8 THEN 0 ELSE (v - m) / s END AS z FROM s", "z")
def mad_standardize(spark, d):
    return ranking.mad_standardise(values(spark, d), "v", ["g"]).select("id", "z")


@query(f"SELECT id, CASE WHEN s < 1e-8 THEN 0 ELSE (v - m) / s END AS z FROM (SELECT *, avg(v) OVER (PARTITION BY g) AS m, stddev_samp(v) OVER (PARTITION BY g) AS s FROM ({VALUES}))", "z")
def zscore(spark, d):
    return ranking.standardise(values(spark, d), "v", ["g"]).select("id", "z")


@query(f"SELECT id, cume_dist() OVER (PARTITION BY g ORDER BY v) AS ecdf FROM ({VALUES})", "ecdf")
def ecdf(spark, d):
    return ranking.ecdf(values(spark, d), "v", ["g"]).select("id", "ecdf")


@query(f"SELECT id, (rank() OVER (PARTITION BY g ORDER BY v) + (count(*) OVER (PARTITION BY g, v) - 1) / 2) / count(*) OVER (PARTITION BY g) AS pct FROM ({VALUES})", "pct")
def pct_rank(spark, d):
    return ranking.percent_rank_average(values(spark, d), "v", ["g"]).select("id", "pct")


@query(f"SELECT id, g, rank FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY v DESC, id) AS rank FROM ({VALUES})) WHERE rank <= 5")
def top_k_per_cluster(spark, d):
    return ranking.top_k(values(spark, d), ["g"], [F.desc("v"), "id"], 5).select("id", "g", F.col("rank").cast("long").alias("rank"))


@query(f"SELECT id, g, rank FROM (SELECT *, coalesce(sum(v) OVER (PARTITION BY g ORDER BY v DESC, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, row_number() OVER (PARTITION BY g ORDER BY v DESC, id) AS rank, sum(v) OVER (PARTITION BY g) AS t FROM ({VALUES})) WHERE b < 0.05 * t AND rank <= 40")
def cum_fraction_keep(spark, d):
    return ranking.cumulative_keep(values(spark, d), ["g"], "v", [F.desc("v"), "id"], 0.05, 40).select("id", "g", F.col("rank").cast("long").alias("rank"))


@query("WITH c AS (SELECT o_orderpriority AS k, o_orderstatus AS b, count(*) AS c FROM orders GROUP BY 1, 2), p AS (SELECT *, c / sum(c) OVER (PARTITION BY k) AS p FROM c) SELECT k, -sum(p * log2(p)) AS entropy, sum(c)::BIGINT AS n FROM p GROUP BY k", "entropy")
def batch_entropy(spark, d):
    return ranking.entropy(table(spark, d, "orders").select(F.col("o_orderpriority").alias("k"), F.col("o_orderstatus").alias("b")), "k", "b")


BINNED = "SELECT floor(o_totalprice / 50000)::BIGINT AS i, avg(o_custkey % 100) AS y, count(*)::DOUBLE AS w FROM orders GROUP BY 1"


@query(f"""WITH b AS ({BINNED}), m AS (SELECT j.i AS j, k.i AS k, sum(b.w * b.y) / sum(b.w) AS m FROM b j JOIN b k ON j.i <= k.i JOIN b ON b.i BETWEEN j.i AND k.i GROUP BY 1, 2),
l AS (SELECT b.i, m.j, min(m.m) AS m FROM b JOIN m ON m.j <= b.i AND m.k >= b.i GROUP BY 1, 2) SELECT b.i, y, w, max(l.m) AS fit FROM b JOIN l USING (i) GROUP BY 1, 2, 3""", "y w fit")
def pava(spark, d):
    o = table(spark, d, "orders")
    return ranking.isotonic(o.groupBy(F.floor(F.col("o_totalprice") / 50000).alias("i")).agg(F.avg(F.col("o_custkey") % 100).alias("y"), F.count(F.lit(1)).cast("double").alias("w")))


@query("SELECT o_orderkey, (rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0) / count(*) OVER () AS pct FROM orders", "pct")
def pct_rank_all(spark, d):
    """Average rank over a whole table, by ranges of values."""
    return ranking.percent_rank_average(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", []).select("o_orderkey", "pct")


DAILY = "SELECT event_type AS g, CAST(ts AS DATE) AS t, avg(value) AS v FROM events GROUP BY 1, 2"


def daily(spark, d):
    return table(spark, d, "events").groupBy(F.col("event_type").alias("g"), F.to_date("ts").alias("t")).agg(F.avg("value").alias("v"))


@query(f"SELECT g, t::VARCHAR AS t, lead(v, 2) OVER w - 2 * lead(v, 1) OVER w + v AS curvature FROM ({DAILY}) WINDOW w AS (PARTITION BY g ORDER BY t)", "curvature")
def curvature(spark, d):
    return ranking.second_difference(daily(spark, d), ["g"], "t", "v").select("g", F.col("t").cast("string").alias("t"), "curvature")


@query(f"SELECT g, t::VARCHAR AS t, median(v) OVER (PARTITION BY g ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS smooth FROM ({DAILY})", "smooth")
def rolling_median(spark, d):
    return ranking.rolling_median(daily(spark, d), ["g"], "t", "v").select("g", F.col("t").cast("string").alias("t"), "smooth")


@query("WITH s AS (SELECT n_name AS sample_id, n_nationkey AS ord FROM nation WHERE n_regionkey = 1), r AS (SELECT (SELECT sample_id FROM s ORDER BY ord LIMIT 1) AS ref) SELECT sample_id, ord, coalesce(lag(sample_id) OVER (ORDER BY ord), ref) AS against FROM s, r WHERE sample_id <> ref")
def contrast_sequential(spark, d):
    s = table(spark, d, "nation").filter("n_regionkey = 1").select(F.col("n_name").alias("sample_id"), F.col("n_nationkey").alias("ord"))
    return ranking.sequential_contrasts(s, s.orderBy("ord").first()[0])


AGES = "SELECT user_id AS grid, event_type AS sample_id, any_value(ascii(event_type))::DOUBLE AS age, avg(value) AS c FROM events GROUP BY 1, 2"


@query(f"""WITH a AS ({AGES}), p AS (SELECT a.grid, a.sample_id, a.c, exp(-0.5 * ((a.age - o.age) / 5.0) ^ 2) AS w, o.c AS oc FROM a JOIN a o ON a.grid = o.grid AND a.sample_id <> o.sample_id),
s AS (SELECT grid, sample_id, c, sum(w * oc) / sum(w) AS m, sum(w * oc * oc) / sum(w) AS mm FROM p GROUP BY 1, 2, 3),
l AS (SELECT grid, sample_id, 1 / (1 + exp(-1.702 * (c - m) / greatest(sqrt(greatest(mm - m * m, 0)), 0.05))) AS p FROM s)
SELECT grid, sample_id, least(1, greatest(0.001, p / avg(p) OVER (PARTITION BY sample_id))) AS precision FROM l""", "precision", 4)
def age_kernel_coverage(spark, d):
    e = table(spark, d, "events")
    a = e.groupBy(F.col("user_id").alias("grid"), F.col("event_type").alias("sample_id")).agg(F.avg("value").alias("c")).withColumn("age", F.ascii("sample_id").cast("double"))
    return ranking.age_coverage(a, 5.0)
