"""The jobs as queries: each runs twice into a new folder and returns its whole output, with SQL."""

from __future__ import annotations

import json
import uuid
from pathlib import Path

from sparkloom.registry import query
from sparkloom.storage import shared_dir

from . import count_intake, register_cohort

C = json.loads(Path(__file__).with_name("count_intake.json").read_text())
R = json.loads(Path(__file__).with_name("register_cohort.json").read_text())
LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
CONTROLS = ", ".join(f"'{x}'" for x in C["controls"])

JOB1 = f"""
WITH p AS (SELECT {", ".join(f"{e} AS {k}" for k, e in R["columns"].items())} FROM lineitem),
c AS (SELECT sample_id, cluster, avg(x) AS cx, avg(y) AS cy, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= {R["least_points"]}),
j AS (SELECT q.sample_id, q.cx AS qx, q.cy AS qy, r.cx AS rx, r.cy AS ry, least(q.n, r.n)::DOUBLE AS w FROM c q JOIN c r USING (cluster) WHERE r.sample_id = '{R["reference"]}' AND q.sample_id <> '{R["reference"]}'),
m AS (SELECT *, sum(w * qx) OVER s / sum(w) OVER s AS mx, sum(w * qy) OVER s / sum(w) OVER s AS my, sum(w * rx) OVER s / sum(w) OVER s AS nx, sum(w * ry) OVER s / sum(w) OVER s AS ny FROM j WINDOW s AS (PARTITION BY sample_id)),
s AS (SELECT sample_id, any_value(mx) AS mx, any_value(my) AS my, any_value(nx) AS nx, any_value(ny) AS ny, count(*) AS n,
      sum(w * ((qx - mx) * (rx - nx) + (qy - my) * (ry - ny))) AS a, sum(w * ((qx - mx) * (ry - ny) - (qy - my) * (rx - nx))) AS b, sum(w * ((qx - mx) ** 2 + (qy - my) ** 2)) AS v FROM m GROUP BY 1),
f AS (SELECT *, sqrt(a * a + b * b) / v AS scale, atan2(b, a) AS theta FROM s WHERE n >= {R["least_clusters"]}),
t AS (SELECT sample_id, n, round(scale, 10) AS scale, round(theta, 10) AS theta, round(nx - scale * (cos(theta) * mx - sin(theta) * my), 10) AS tx, round(ny - scale * (sin(theta) * mx + cos(theta) * my), 10) AS ty FROM f),
e AS (SELECT j.sample_id, sqrt(sum(w * ((qx - rx) ** 2 + (qy - ry) ** 2)) / sum(w)) AS rmse_before,
      sqrt(sum(w * ((scale * (cos(theta) * qx - sin(theta) * qy) + tx - rx) ** 2 + (scale * (sin(theta) * qx + cos(theta) * qy) + ty - ry) ** 2)) / sum(w)) AS rmse FROM j JOIN t USING (sample_id) GROUP BY 1)
SELECT p.sample_id, p.cluster, p.x::DOUBLE AS x, p.y::DOUBLE AS y, CASE WHEN z THEN p.x ELSE scale * (cos(theta) * x - sin(theta) * y) + tx END AS x_aligned, CASE WHEN z THEN p.y ELSE scale * (sin(theta) * x + cos(theta) * y) + ty END AS y_aligned,
       CASE WHEN z THEN 'reference' WHEN scale IS NOT NULL THEN 'aligned' ELSE 'too few clusters' END AS status, coalesce(t.n, 0) AS clusters,
       CASE WHEN z THEN 1.0 ELSE scale END AS scale, CASE WHEN z THEN 0.0 ELSE theta END AS theta, CASE WHEN z THEN 0.0 ELSE rmse_before END AS rmse_before, CASE WHEN z THEN 0.0 ELSE rmse END AS rmse
FROM (SELECT *, sample_id = '{R["reference"]}' AS z FROM p) p LEFT JOIN t USING (sample_id) LEFT JOIN e USING (sample_id)
"""

JOB2 = f"""
WITH d AS (SELECT coalesce({C["sample"]}, 'unknown') AS sample_id, {C["observation"]}::VARCHAR AS obs, {LOWER} AS t FROM documents WHERE {C["observation"]} IS NOT NULL),
c AS (SELECT sample_id, obs, gene, count(*)::DOUBLE AS value, gene IN ({CONTROLS}) AS k FROM (SELECT sample_id, obs, unnest(regexp_extract_all(t, '{C["feature"]}')) AS gene FROM d) GROUP BY ALL),
q AS (SELECT obs, coalesce(sum(value) FILTER (NOT k), 0) AS counts, count(*) FILTER (NOT k) AS genes, coalesce(sum(value) FILTER (k), 0) AS control, sum(value) AS total FROM c GROUP BY 1),
o AS (SELECT d.sample_id, d.obs, coalesce(counts, 0) AS counts, coalesce(genes, 0) AS genes, coalesce(counts >= {C["least_counts"]} AND genes >= {C["least_features"]} AND control <= {C["most_control"]} * total, false) AS kept FROM d LEFT JOIN q USING (obs))
SELECT 'observation' AS kind, sample_id, obs AS name, counts, genes, kept FROM o
UNION ALL SELECT 'gene', c.sample_id, gene, sum(value), count(*), true FROM c JOIN o USING (obs) WHERE kept GROUP BY c.sample_id, gene
"""


def folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query(JOB1, "x y x_aligned y_aligned scale theta rmse_before rmse")
def job1_register_cohort(spark, d):
    at = folder(spark, "register_cohort")
    for _ in range(2):
        register_cohort.run(spark, f"{d}/lineitem.parquet", at)
    return register_cohort.result(spark, at)


@query(JOB2, "counts")
def job2_count_intake(spark, d):
    at = folder(spark, "count_intake")
    for _ in range(2):  # a glob, as the table may be one file and file streams take folders or globs
        count_intake.run(spark, f"{d}/documents.parque[t]", f"{at}/tables", f"{at}/checkpoint")
    return count_intake.result(spark, f"{at}/tables")
