import pytest
from pyspark.sql import functions as F

from sparkloom.functions import columns as C
from sparkloom.sources import tables


def test_visium_coordinates_and_inference_table(spark):
    pos = spark.createDataFrame([("AAAC-1", 1, 50), ("CCGT-1", 2, 14)], "barcode string, array_row int, array_col int")
    al = spark.createDataFrame([("NL3__CCGT-1", 5.0, 6.0, "s"), ("NL3__AAAC-1", 7.0, 8.0, "s")], "cell_id string, x double, y double, sample_id string")
    got = {r["barcode"]: (r["x"], r["y"], r["x_aligned"]) for r in tables.visium_coordinates(pos, al).collect()}
    assert got == {"AAAC-1": (50.0, 1.0, 7.0), "CCGT-1": (14.0, 2.0, 5.0)}
    with pytest.raises(ValueError, match="one-to-one"):
        tables.visium_coordinates(pos.limit(1), al)
    coords = spark.createDataFrame([("a", "A-1"), ("b", "A-1")], "sample_id string, barcode string")
    counts = spark.createDataFrame([("a", "A-1", "g1", 1.0), ("a", "A-1", "g2", 2.0), ("b", "A-1", "g2", 3.0)], "sample_id string, barcode string, gene string, value double")
    assert {r["gene"] for r in tables.inference_table(coords, counts)[1].collect()} == {"g2"}
    with pytest.raises(ValueError, match="without expression"):
        tables.inference_table(coords, counts.filter("sample_id = 'a'"))


def test_pairing_csv(spark, tmp_path):
    (tmp_path / "p.csv").write_text('group_id,left_dataset_kind,right_dataset_kind,left_selected_id,right_selected_id,left_raw_selected_ids,right_raw_selected_ids,atlas_z_slice\ng1,sample,atlas,5,101,"[5, 6]",,675\ng1,sample,atlas,6,102,,"102",675\ng2,atlas,sample,103,7,"103",,675\n')
    got = {r["group_id"]: (r["source_ids"], r["target_ids"]) for r in tables.pairing_csv(spark, str(tmp_path / "p.csv"), 675).collect()}
    assert got == {"g1": ([5, 6], [101, 102]), "g2": ([7], [103])}
    with pytest.raises(ValueError, match="slice"):
        tables.pairing_csv(spark, str(tmp_path / "p.csv"), 700)


def test_rasters_features_and_normaliser(spark, tmp_path):
    spark.createDataFrame([(0, 0, 0, 1), (0, 1, 0, 2), (1, 0, 0, 9)], "z int, iy int, ix int, label int").write.parquet(f"{tmp_path}/r")
    assert {(r["iy"], r["label"]) for r in tables.read_raster(spark, f"{tmp_path}/r", 0, flip=True).collect()} == {(1, 1), (0, 2)}
    spark.createDataFrame([(y, x, [1.0], [float("nan") if (y, x) == (1, 1) else 2.0]) for y in range(3) for x in range(3)], "iy int, ix int, a array<double>, b array<double>").write.parquet(f"{tmp_path}/f")
    assert tables.read_features(spark, f"{tmp_path}/f").count() == 8
    assert tables.read_features(spark, f"{tmp_path}/f", 1).count() == 0
    df = spark.createDataFrame([("A1_age3", "1.5", "x"), ("B2_age 9.5", "2", "3")], "sample_id string, x string, y string")
    got = {r["sample_id"]: (r["x"], r["y"], r["batch"], r["age"]) for r in tables.normalise_combined(df, {"^A": "one", "^B": "two"}).collect()}
    assert got == {"A1_age3": (1.5, None, "one", 3.0), "B2_age 9.5": (2.0, 3.0, "two", 9.5)}
    with pytest.raises(ValueError, match="reader"):
        tables.read(spark, "x.h5ad")


def test_paired_directory(spark, tmp_path):
    for s, cells, genes in (("r", "ab", "ab"), ("q", "cd", "bc")):
        (tmp_path / f"cell_metadata_{s}.csv").write_text("cell_id,x,y\n" + "".join(f"{c},1,2\n" for c in cells))
        (tmp_path / f"cell_by_gene_{s}.csv").write_text("cell_id," + ",".join(f"gene_{g}" for g in genes) + "\n" + "".join(f"{c},1,2\n" for c in cells))
    meta, expr = tables.paired_directory(spark, str(tmp_path), ["r", "q"])
    assert {r["obs"] for r in meta.collect()} == {"q_c", "q_d", "r_a", "r_b"}
    assert {r["gene"] for r in expr.select("gene").distinct().collect()} == {"gene_a", "gene_b", "gene_c"}
    with pytest.raises(ValueError):
        tables.paired_directory(spark, str(tmp_path), ["r"])


def test_column_functions(spark):
    df = spark.createDataFrame([("[5, 6]",), ("7;6.0",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(C.id_list(F.col("s"))).collect()] == [[5, 6], [6, 7], [], []]
    p = spark.createDataFrame([(1e-30,), (0.2,)], "p double").agg(C.acat_p(F.avg(C.acat_term(F.col("p"))))).first()[0]
    q = spark.createDataFrame([(1e-15,), (0.2,)], "p double").agg(C.acat_p(F.avg(C.acat_term(F.col("p"))))).first()[0]
    assert p == q and p == pytest.approx(2e-15, rel=0.01)
    inf = spark.createDataFrame([(float("inf"),), (16.0,)], "d double").select(C.distance_gate(F.lit(1.0), F.col("d"))).collect()
    assert [r[0] for r in inf] == [0.0, 0.75]
    with pytest.raises(ValueError):
        C.composite([(0.5, F.lit(1.0))])


def test_directory_discovery(spark, tmp_path):
    import pytest

    from sparkloom.sources import tables

    for name, gene in (("b", "g1"), ("a", "g2")):
        (tmp_path / f"cell_metadata_{name}.csv").write_text("cell_id,x,y\n1,0,0\n2,1,1\n")
        (tmp_path / f"cell_by_gene_{name}.csv").write_text(f"cell_id,{gene}\n2,5\n1,3\n")
    (tmp_path / "notes.csv").write_text("x\n1\n")
    assert tables.discover(spark, str(tmp_path)) == ["a", "b"]
    meta, expr = tables.paired_directory(spark, str(tmp_path))
    assert {(r["sample_id"], r["obs"]) for r in meta.collect()} == {("a", "a_1"), ("a", "a_2"), ("b", "b_1"), ("b", "b_2")}
    assert {(r["obs"], r["gene"], r["value"]) for r in expr.collect()} == {("a_1", "g2", 3), ("a_2", "g2", 5), ("b_1", "g1", 3), ("b_2", "g1", 5)}
    (tmp_path / "cell_metadata_c.csv").write_text("cell_id,x,y\n1,0,0\n")
    with pytest.raises(FileNotFoundError, match=r"missing expression for \['c'\]"):
        tables.discover(spark, str(tmp_path))


def test_user_weights():
    import pytest

    from sparkloom.operators import pairing

    own = pairing.with_weights(pairing.HISTOLOGY, sdf=0.25, chamfer=0.35, dice=0.20, area=0.15, thickness=0.05)
    assert (own.sdf, own.thickness, own.score_least) == (0.25, 0.05, pairing.HISTOLOGY.score_least)
    assert pairing.with_weights(pairing.ATAC) == pairing.ATAC
    for bad, text in (({"sdf": 0.4}, "sum to 1.0"), ({"sdf": -0.1, "chamfer": 0.7}, "at least 0"), ({"colour": 1}, "no such")):
        with pytest.raises(ValueError, match=text):
            pairing.with_weights(pairing.ATAC, **bad)
