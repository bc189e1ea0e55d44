import numpy as np
from pyspark.sql import functions as F

from sparkloom.operators import pairing, tissue
from sparkloom.plans import structures


def section(spark, shift):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(1600):
        u, v = rng.random(2) * 32
        rows.append((i, str(1 + (u >= 16) + 2 * (v >= 16)), float(u + shift), float(v + shift)))
    pts = spark.createDataFrame(rows, "id long, cluster string, x double, y double")
    labels = spark.createDataFrame([(y, x, 1 + (x >= 16) + 2 * (y >= 16) if x < 33 and y < 33 else 0) for y in range(36) for x in range(36)], "iy int, ix int, label int")
    return pts, labels


def test_atlas_pairs_and_labels(spark):
    pts, labels = section(spark, 1.5)
    names = spark.createDataFrame([(i, f"area {i}") for i in range(1, 5)], "label int, name string")
    out, pairs, read = structures.align_atlas(pts, labels, names, (36, 36), rounds=1, iterations=15)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(str(i), str(i)) for i in range(1, 5)}
    right = out.join(read, "id").agg(F.avg((F.col("name") == F.concat(F.lit("area "), "cluster")).cast("double"))).first()[0]
    assert right > 0.93
    before = pts.agg(F.avg((1 + (F.rint("x") >= 16).cast("int") + 2 * (F.rint("y") >= 16).cast("int") == F.col("cluster").cast("int")).cast("double"))).first()[0]
    assert right > before


def test_bundle_of_equal_masks():
    m = np.zeros((20, 20), bool)
    m[4:14, 5:15] = True
    b = pairing.bundle(m, m, 25.0)
    assert (b["dice"], b["iou"], b["asd"], b["chamfer_sim"], b["sdf_corr"], b["thickness_sim"]) == (1, 1, 0, 1, 1, 1)
    none = pairing.bundle(m, np.zeros_like(m), 25.0)
    assert none["dice"] == 0 and none["asd"] == np.inf


def test_disjoint_sets_and_layers(spark):
    rows = [("c1", "x", [1, 2], 0.9), ("c1", "y", [3], 0.8), ("c2", "z", [2, 4], 0.85), ("c2", "y", [3], 0.5), ("c3", "layer", [1], 0.1)]
    df = spark.createDataFrame(rows, "cluster string, candidate string, labels array<int>, score double")
    assert {(r["cluster"], r["candidate"]) for r in pairing.disjoint_sets(df).collect()} == {("c1", "x"), ("c2", "y")}
    got = pairing.layers_then_rest(df, F.col("candidate") == "layer").collect()
    assert {(r["cluster"], r["candidate"]) for r in got} == {("c3", "layer"), ("c2", "z"), ("c1", "y")}


def test_tissue_and_geometry(spark):
    rng = np.random.default_rng(1)
    xy = rng.random((3000, 2)) * 10
    xy = xy[np.hypot(xy[:, 0] - 5, xy[:, 1] - 5) > 1.5]
    pts = spark.createDataFrame([(i, "s", float(x), float(y)) for i, (x, y) in enumerate(xy)], "id long, sample_id string, x double, y double")
    cells = tissue.tissue_cells(pts, 30).toPandas()
    got = set(zip(cells["iy"], cells["ix"]))
    assert (15, 15) not in got and (3, 3) in got
    g = tissue.auto_geometry(pts)
    assert 0.010 <= g["radius_relative"] <= 0.040 and g["k_max"] >= 60
    edge = tissue.near_boundary(pts, 32, reach=2.0).join(pts, "id").toPandas()
    rim = np.minimum.reduce([edge["x"], edge["y"], 10 - edge["x"], 10 - edge["y"]])
    assert edge["boundary"][rim < 0.2].mean() > 0.9 and edge["boundary"][(rim > 2) & (np.hypot(edge["x"] - 5, edge["y"] - 5) > 3)].mean() < 0.3


def test_technical_basis_is_orthogonal(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=200)
    rows = [("b", i, float(x), float(0.7 * x + rng.normal() * 0.3)) for i, x in enumerate(a)]
    qc = spark.createDataFrame(rows, "batch string, qid long, lib double, det double")
    out = tissue.technical_basis(qc, qc.select("batch", "qid"))
    assert abs(out.agg(F.corr("psi1", "psi2")).first()[0]) < 1e-9
