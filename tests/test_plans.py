import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import clustering, communities, contracts, geometry, neighbours, raster
from sparkloom.plans import clustering as structure
from sparkloom.operators import inference as rules
from sparkloom.plans import alignment, inference
from sparkloom.sources import tables


def test_prealignment_recovers_the_similarity(spark):
    pts = tables.two_samples(spark, 3, 40).cache()
    pre = alignment.prealign(pts, "query", "reference")
    one = pre.filter("sample_id = 'reference'").select((F.col("id") + 120).alias("id"), "x", "y")
    d = pre.filter("sample_id = 'query'").join(one.withColumnRenamed("x", "rx").withColumnRenamed("y", "ry"), "id")
    assert d.agg(F.max(F.hypot(F.col("x_prealigned") - F.col("rx"), F.col("y_prealigned") - F.col("ry")))).first()[0] < 1e-6


def test_align_keeps_the_reference_and_improves(spark):
    pts = tables.two_samples(spark, 3, 40).cache()
    out, rates = alignment.align(pts, "query", "reference", alignment.Config(cells=32, iterations=5))
    assert out.filter("sample_id = 'reference' and (x <> x_aligned or y <> y_aligned)").isEmpty()
    r = {x["stage"]: x for x in rates.groupBy("stage").agg(F.avg("match_rate").alias("m"), F.avg("mean_distance").alias("d")).collect()}
    assert r["aligned"]["m"] == 1.0 and r["aligned"]["d"] < r["before"]["d"]
    with pytest.raises(ValueError):
        alignment.align(pts, "query", "query")


def test_knn_by_brute_force(spark):
    rng = np.random.default_rng(0)
    xy = np.round(np.vstack([rng.random((150, 2)), rng.random((20, 2)) * 50 + 100]), 3)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, x double, y double")
    got = {(r["qid"], r["rank"]): r["nid"] for r in neighbours.knn(df, df, 4).collect()}
    for i in range(len(xy)):
        d = ((xy - xy[i]) ** 2).sum(1)
        assert [got[i, r] for r in (1, 2, 3, 4)] == sorted(range(len(xy)), key=lambda j: (d[j], j))[:4]
    assert neighbours.knn(df.limit(0), df, 4).count() == 0


def test_greedy_equals_sequential(spark):
    rng = np.random.default_rng(1)
    rows = [(a, b, float(rng.integers(0, 30))) for a in range(8) for b in range(9) if rng.random() < 0.6]
    used_a, used_b, want = set(), set(), set()
    for a, b, s in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            want.add((a, b))
            used_a.add(a)
            used_b.add(b)
    got = raster.greedy(spark.createDataFrame(rows, "a long, b long, score double")).collect()
    assert {(r["a"], r["b"]) for r in got} == want


def test_communities_find_two_cliques(spark):
    e = [(i, j, 1.0) for g in (0, 10) for i in range(g, g + 6) for j in range(i + 1, g + 6)] + [(5, 10, 0.1)]
    edges = spark.createDataFrame(e, "i long, j long, w double")
    labels = communities.communities(edges)
    assert {(r["id"] >= 10, r["label"]) for r in labels.collect()} == {(False, 0), (True, 10)}
    assert communities.modularity(edges, labels) > 0.45


def test_joint_labels_span_samples(spark):
    rng = np.random.default_rng(6)
    pts, expr = [], []
    for i in range(240):
        x, y = rng.random(2) * 10
        pts.append((i, "ab"[i % 2], float(x), float(y)))
        expr += [(i, "g", float(rng.poisson(40 if x > 5 else 2))), (i, "h", float(rng.poisson(2 if x > 5 else 40)))]
    p, e = spark.createDataFrame(pts, "id long, sample_id string, x double, y double"), spark.createDataFrame(expr, "id long, gene string, value double")
    got = structure.cluster(p, e, k=8, shared=30).select("sample_id", "label", (F.col("x") > 5).alias("right")).toPandas()
    both = got.groupby("label")["sample_id"].nunique()
    assert got["label"].map(both).eq(2).mean() > 0.9
    # points at the border, whose neighbourhoods are mixed, may have a label of their own
    assert got.groupby("label")["right"].agg(lambda r: max(r.sum(), (~r).sum())).sum() > 0.9 * len(got)


def test_kmeans_pca_harmony(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(c, 0.1, (30, 3)) for c in ((0, 0, 0), (5, 0, 0), (0, 5, 0))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    lab = clustering.kmeans(df, 3)[0].toPandas().sort_values("id")["label"].to_numpy()
    assert all(len(set(lab[i : i + 30])) == 1 for i in (0, 30, 60)) and len(set(lab)) == 3
    got, values = clustering.pca(df, 2)
    c = x - x.mean(0)
    assert np.allclose(values, np.linalg.svd(c)[1][:2] ** 2 / len(x))
    shifted = x.copy()
    shifted[::2] += (0, 0, 2)
    both = spark.createDataFrame([(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(shifted)], "id long, batch string, v array<double>")
    z = np.vstack(clustering.harmony(both, 3).toPandas().sort_values("id")["v"])
    assert abs(z[::2, 2].mean() - z[1::2, 2].mean()) < 0.5 * 2


def test_kmeans_seeds_over_all_rows_by_weight(spark):
    rng = np.random.default_rng(8)
    x = np.vstack([rng.normal(0, 0.1, (3000, 2)), rng.normal((5, 0), 0.1, (3000, 2)), rng.normal((0, 90), 0.1, (4, 2))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<double>")
    labels, centres = clustering.kmeans(df, 3)
    assert np.allclose(sorted(centres.round(0).tolist()), [[0, 0], [0, 90], [5, 0]])
    few = spark.createDataFrame([(i, [float(i % 2)], float(i % 2)) for i in range(20)], "id long, v array<double>, weight double")
    assert clustering.kmeans(few, 2)[1].tolist() == [[1.0]]


def test_spatial_refinement_follows_neighbours(spark):
    """A line of two halves; one row's value lies a little nearer to the other half's centre."""
    v = [0.0] * 10 + [1.0] * 10
    v[4] = 0.7
    df = spark.createDataFrame([(i, [x]) for i, x in enumerate(v)], "id long, v array<double>")
    edges = spark.createDataFrame([(i, j, 1.0) for i in range(20) for j in (i - 2, i - 1, i + 1, i + 2) if 0 <= j < 20], "qid long, nid long, w double")
    labels = spark.createDataFrame([(i, int(x > 0.5)) for i, x in enumerate(v)], "id long, label long")
    centres = clustering.refine_spatially(df, labels, np.array([[0.0], [1.0]]), edges)[1]
    assert np.allclose(centres, [[0.07], [1.0]])


def test_inference_finds_the_changed_gene(spark):
    rng = np.random.default_rng(3)
    pts, expr = [], []
    for s in range(2):
        for i in range(400):
            n = s * 400 + i
            x, y = rng.random(2) * 10
            pts.append((n, f"s{s}", float(x), float(y)))
            expr.append((f"s{s}", n, "same", float(rng.poisson(20))))
            expr.append((f"s{s}", n, "more", float(rng.poisson(20 + 20 * s * (x > 5)))))
    p = spark.createDataFrame(pts, "id long, sample_id string, x double, y double")
    e = spark.createDataFrame(expr, "sample_id string, nid long, gene string, value double")
    tests, genes, *_ = inference.fit(inference.prepare(p, 10), e, "s0")
    got = {r["gene"]: r["p"] for r in genes.collect()}
    assert got["more"] < 1e-4 < got["same"]
    assert tests.filter("gene = 'more' and sig").count() > 5


def test_contracts_and_csv(spark, tmp_path):
    (tmp_path / "m.csv").write_text("cell_id,x,y\nb,1,2\na,3,4\n")
    (tmp_path / "e.csv").write_text("cell_id,gene_a,gene_b\na,20,0\nb,10,1\n")
    meta, expr = tables.paired_csv(spark, str(tmp_path / "m.csv"), str(tmp_path / "e.csv"), "s")
    assert {r["obs"] for r in meta.collect()} == {"s_a", "s_b"}
    assert {(r["obs"], r["gene"]): r["value"] for r in expr.collect()}["s_a", "gene_a"] == 20
    (tmp_path / "bad.csv").write_text("cell_id,gene_a\na,20\nc,10\n")
    with pytest.raises(ValueError, match="one side"):
        tables.paired_csv(spark, str(tmp_path / "m.csv"), str(tmp_path / "bad.csv"))
    assert tables.paired_csv(spark, str(tmp_path / "m.csv"), str(tmp_path / "bad.csv"), strict=False)[0].count() == 1
    (tmp_path / "neg.csv").write_text("cell_id,gene_a\na,-1\nb,10\n")
    with pytest.raises(ValueError, match="finite"):
        tables.paired_csv(spark, str(tmp_path / "m.csv"), str(tmp_path / "neg.csv"))
    with pytest.raises(ValueError, match="barcode"):
        contracts.canonical_barcodes(spark.createDataFrame([("x",)], "c string"), "c")
    got = contracts.canonical_barcodes(spark.createDataFrame([("NL3__AAAC-1",), ("CTRL_ACGT-1",), ("AAACT-1|x.csv",)], "c string"), "c")
    assert {r["barcode"] for r in got.collect()} == {"AAAC-1", "ACGT-1", "AAACT-1"}


def test_cache_and_sinks(spark, tmp_path):
    built = []

    def build():
        built.append(1)
        return spark.range(3)

    for _ in range(2):
        assert tables.cached(spark, f"file://{tmp_path}/c", {"a": 1}, build).count() == 3
    assert len(built) == 1
    pts = tables.two_samples(spark)
    tables.write_samples(pts, f"{tmp_path}/s")
    assert tables.same_rows(spark.read.parquet(f"{tmp_path}/s").select(*pts.columns), pts)


def test_grid_rules():
    assert geometry.grid_resolution(50, 2000, 0.8)[1] == "r_driven"
    assert geometry.grid_resolution(30, 2000, 0.8)[1] == "lower_bound"
    assert geometry.grid_resolution(100, 2000, 0.8)[1] == "upper_bound"
    assert geometry.grid_resolution(30, 2000, 0.8, explicit=73) == (73, "explicit")
    assert geometry.map_radius(27.195) == pytest.approx(40.7925)
    with pytest.raises(ValueError):
        geometry.map_radius(1.0, 0.0)


def test_stream(spark, tmp_path):
    from sparkloom.streaming.points import windowed_centroids

    rows = [("2024-01-01 10:00:00", "a", 1.0, 2.0), ("2024-01-01 12:00:00", "a", 3.0, 4.0), ("2024-01-02 10:00:00", "b", 5.0, 6.0)]
    spark.createDataFrame(rows, "ts string, cluster string, x double, y double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema("ts timestamp, cluster string, x double, y double").parquet(f"{tmp_path}/in")
    q = windowed_centroids(s).writeStream.outputMode("update").format("memory").queryName("cents").start()
    q.processAllAvailable()
    q.stop()
    assert {(r["cluster"], r["cx"], r["n"]) for r in spark.sql("select * from cents").collect()} == {("a", 2.0, 2), ("b", 5.0, 1)}


def test_kernel_density_corrects_edges(spark):
    e = spark.createDataFrame([(1, 0.5), (1, 0.5), (2, 0.5)], "qid long, w double")
    d = spark.createDataFrame([(1, 100.0), (2, 0.0), (3, 1.0), (4, -1.0)], "qid long, bd double")
    got = {r["qid"]: r["density"] for r in neighbours.kernel_density(e, d, 1.0).collect()}
    assert got == pytest.approx({1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0})


def test_ward_levels_keep_every_group(spark):
    from sparkloom import queries_models

    c = spark.createDataFrame([(f"g{i:03d}", float(i), float(i % 7), 1) for i in range(60)], "sample_id string, cx double, cy double, n long")
    assert queries_models.ward_cut(spark, c).select("sample_id").distinct().count() == 60
    with pytest.raises(ValueError, match="more than 59"):
        queries_models.ward_cut(spark, c, 59)


def test_ridge_with_covariates_equals_numpy(spark):
    rng = np.random.default_rng(5)
    n = 60
    z, y, w = rng.normal(size=(n, 3)), rng.normal(size=n), rng.random(n) + 0.5
    rows = [("g", "c", i, float(y[i]), float(w[i]), True, *map(float, z[i])) for i in range(n)]
    rows += [("g", "c", n, 99.0, 1.0, False, 0.0, 0.0, 0.0), ("g", "c", n + 1, 99.0, 1.0, True, None, 0.0, 0.0)]
    rows += [("few", "c", i, 1.0, 1.0, True, 0.0, 0.0, 0.0) for i in range(4)]
    df = spark.createDataFrame(rows, "gene string, contrast string, qid long, y double, w double, use boolean, z1 double, z2 double, z3 double")
    names = ["z1", "z2", "z3"]
    fit = rules.ridge(df, names, 4.0, ["z2", "z3"], {"z3": 0.5})
    got = {r["gene"]: r for r in fit.collect()}
    x = np.column_stack([np.ones(n), z])
    b = np.linalg.solve(x.T @ (x * w[:, None]) + np.diag([0, 0, 4.0, 4.0]), x.T @ (w * y) + [0, 0, 0, 2.0])
    assert got["g"]["n"] == n and np.allclose(got["g"]["b"], b)
    out = rules.adjusted(df, fit, names).filter("gene = 'g' and use and z1 is not null").orderBy("qid").toPandas()
    assert np.allclose(out["y_adj"], y - z @ b[1:]) and np.allclose(out["t"], (y - x @ b) * np.sqrt(w)) and (out["df"] == n - 4).all()
    assert rules.adjusted(df, fit, names).filter("gene = 'few' and t is not null").count() == 0


def test_trajectory_pretest_equals_numpy(spark):
    rng = np.random.default_rng(6)
    t, use = rng.normal(size=(7, 5)) * 3, rng.random((7, 5)) < 0.7
    use[0], use[1] = True, [True, False, False, False, False]
    rows = [("g", f"c{j}", j * 10, i, float(t[i, j]) if use[i, j] else None, bool(use[i, j])) for i in range(7) for j in range(5)]
    df = spark.createDataFrame(rows, "gene string, contrast string, ord int, qid long, t double, use boolean")
    got = {(r["qid"], r["contrast"]): r for r in rules.trajectory_pretest(df, 2.0).collect()}
    d = np.diff(np.eye(5), 2, axis=0)
    for i in range(7):
        k = np.flatnonzero(use[i])
        z = np.linalg.solve(np.eye(len(k)) * (1 + 1e-8) + 2.0 * (d.T @ d)[np.ix_(k, k)], t[i, k]) if len(k) > 1 else t[i, k]
        for j in range(5):
            r = got[i, f"c{j}"]
            if use[i, j]:
                assert np.isclose(r["z"], z[list(k).index(j)]) and 0 <= r["p"] <= r["q"] <= 1
            else:
                assert r["z"] is None and r["p"] is None and not r["sig"]
