"""Scans and sinks: paired CSV contracts, coordinate tables, rasters, pairings, replicates, caches.

CSV is read with explicit schemas where columns are known; expression columns are unpivoted to the
long form (sample_id, obs, gene, value) at the scan. Binary formats of the domain (HDF5, NRRD) have
no reader here; their exploded Parquet forms are read instead."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import barcode, id_list
from ..operators import contracts
from ..operators.raster import pairing_groups


def read(spark: SparkSession, path: str, **options) -> DataFrame:
    """Parquet, CSV, JSON or ORC by the path's ending; a folder is Parquet."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    kind = {"gz": path.rpartition(".gz")[0].rpartition(".")[2].lower()}.get(kind, kind)
    if kind == "csv":
        return spark.read.options(header=True, **options).csv(path)
    if kind in ("json", "jsonl"):
        return spark.read.options(**options).json(path)
    if kind == "orc":
        return spark.read.orc(path)
    if kind == "parquet" or "." not in path.rstrip("/").rpartition("/")[2]:
        return spark.read.options(**options).parquet(path)
    raise ValueError(f"no reader for {path}")


def unpivot(wide: DataFrame, key: str = "cell_id") -> DataFrame:
    """obs, gene, value of a wide expression table; every column but the key is a gene."""
    genes = [c for c in wide.columns if c != key]
    cast = wide.select(F.col(key).cast("string").alias("obs"), *[F.col(f"`{g}`").try_cast("double").alias(g) for g in genes])
    return cast.unpivot(["obs"], [f"`{g}`" for g in genes], "gene", "value")


def check_expression(expr: DataFrame) -> None:
    bad = expr.filter(F.col("value").isNull() | F.isnan("value") | (F.col("value") < 0) | (F.col("value") == float("inf")))
    contracts.require_empty(bad.select("obs", "gene"), "expression that is not a finite number of at least 0")


def paired_csv(spark: SparkSession, metadata: str, expression: str, sample: str | None = None, strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Points (obs, x, y, ...) and long expression of one sample. Strict: ids unique on either side
    and the same set, coordinates finite, values finite and not negative. Not strict: the
    intersection of ids."""
    meta = read(spark, metadata).withColumn("cell_id", F.col("cell_id").cast("string"))
    meta = meta.withColumn("x", F.col("x").try_cast("double")).withColumn("y", F.col("y").try_cast("double"))
    wide = read(spark, expression).withColumn("cell_id", F.col("cell_id").cast("string"))
    if strict:
        for side, df in (("metadata", meta), ("expression", wide)):
            contracts.require_empty(contracts.duplicates(df.select("cell_id"), "cell_id"), f"{side} ids that repeat")
        contracts.require_empty(contracts.id_mismatch(meta, wide, "cell_id"), "ids on one side only")
        contracts.require_empty(meta.filter(F.col("x").isNull() | F.col("y").isNull() | F.isnan("x") | F.isnan("y")).select("cell_id"), "coordinates that are not finite")
    else:
        meta, wide = meta.join(wide.select("cell_id").distinct(), "cell_id", "left_semi"), wide.join(meta.select("cell_id").distinct(), "cell_id", "left_semi")
    expr = unpivot(wide)
    if strict:
        check_expression(expr)
    if sample is not None:
        prefix = F.lit(f"{sample}_")
        named = meta.agg(F.bool_and(F.col("cell_id").startswith(f"{sample}_"))).first()[0]
        rename = lambda c: F.col(c) if named else F.concat(prefix, c)
        meta = meta.withColumn("cell_id", rename("cell_id")).withColumn("sample_id", F.lit(sample))
        expr = expr.withColumn("obs", rename("obs")).withColumn("sample_id", F.lit(sample))
    return meta.withColumnRenamed("cell_id", "obs"), expr


def discover(spark: SparkSession, folder: str) -> list[str]:
    """The samples of a folder of file pairs cell_metadata_<id>.csv and cell_by_gene_<id>.csv, found
    by Spark's file listing; a file without its partner is an error, as are fewer than two pairs."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "cell_*.csv").load(folder).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    found = {kind: {r[0] for r in files.select(F.regexp_extract("name", rf"^{kind}_(.+)\.csv$", 1).alias("s")).filter("s <> ''").collect()} for kind in ("cell_metadata", "cell_by_gene")}
    meta, expr = found["cell_metadata"], found["cell_by_gene"]
    if meta != expr or len(meta) < 2:
        raise FileNotFoundError(f"at least two matched file pairs are needed; missing metadata for {sorted(expr - meta)}, missing expression for {sorted(meta - expr)}")
    return sorted(meta)


def paired_directory(spark: SparkSession, folder: str, samples: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """At least two samples, from cell_metadata_<id>.csv and cell_by_gene_<id>.csv; all of the folder
    unless they are named. Genes that a sample lacks are zeros, which the long form leaves out."""
    samples = discover(spark, folder) if samples is None else samples
    if len(samples) < 2:
        raise ValueError("two samples are needed")
    metas, exprs = zip(*(paired_csv(spark, f"{folder}/cell_metadata_{s}.csv", f"{folder}/cell_by_gene_{s}.csv", s) for s in sorted(samples)))
    meta, expr = metas[0], exprs[0]
    for m, e in zip(metas[1:], exprs[1:]):
        meta, expr = meta.unionByName(m, allowMissingColumns=True), expr.unionByName(e)
    return meta, expr


def normalise_combined(df: DataFrame, batches: dict[str, str], x: str = "x", y: str = "y") -> DataFrame:
    """Coerce coordinates and age to numbers; batch by the first pattern that a sample id matches,
    age from the id where the column is missing or unreadable."""
    from ..functions.columns import age

    batch = F.coalesce(*[F.when(F.col("sample_id").rlike(p), F.lit(b)) for p, b in batches.items()], F.lit("unknown"))
    given = F.col("age").cast("string").try_cast("double") if "age" in df.columns else F.lit(None).cast("double")
    return df.withColumn("x", F.col(x).try_cast("double")).withColumn("y", F.col(y).try_cast("double")).withColumn("batch", batch).withColumn("age", F.coalesce(given, age(F.col("sample_id"))))


def visium_coordinates(positions: DataFrame, aligned: DataFrame) -> DataFrame:
    """Tissue positions (barcode, array_row, array_col) against aligned points (cell_id, x, y,
    sample_id), one to one by barcode: x = array_col, y = array_row, x_aligned, y_aligned."""
    a = aligned.withColumn("barcode", barcode(F.col("cell_id")))
    for df in (positions, a):
        contracts.require_empty(contracts.duplicates(df.select("barcode"), "barcode"), "barcodes that repeat")
    contracts.require_empty(contracts.id_mismatch(positions, a, "barcode"), "positions and aligned points do not match one-to-one")
    return positions.join(a.select("barcode", "cell_id", "sample_id", F.col("x").alias("x_aligned"), F.col("y").alias("y_aligned")), "barcode").select("barcode", "cell_id", "sample_id", F.col("array_col").cast("double").alias("x"), F.col("array_row").cast("double").alias("y"), "x_aligned", "y_aligned")


def inference_table(coords: DataFrame, counts: DataFrame, least_spots: int = 1) -> tuple[DataFrame, DataFrame]:
    """Spots and long counts for inference: every aligned spot needs counts; genes are those that
    all samples have, detected in at least least_spots. coords: sample_id, barcode, ...; counts:
    sample_id, barcode, gene, value."""
    from ..operators.expression import shared_genes

    contracts.require_empty(contracts.missing(coords, counts.select("sample_id", "barcode").distinct(), ["sample_id", "barcode"]), "aligned spots without expression")
    kept = counts.join(coords.select("sample_id", "barcode"), ["sample_id", "barcode"], "left_semi")
    support = kept.groupBy("gene").agg(F.count_if(F.col("value") > 0).alias("n")).filter(F.col("n") >= least_spots)
    return coords, kept.join(shared_genes(kept), "gene", "left_semi").join(support.select("gene"), "gene", "left_semi")


def attach_labels(points: DataFrame, labels: DataFrame, order: str) -> DataFrame:
    """Left join of labels by cell_id; of repeated ones the first in `order`."""
    from ..operators.ranking import top_k

    return points.join(top_k(labels, ["cell_id"], [order], 1).drop("rank", order), "cell_id", "left")


def pairing_csv(spark: SparkSession, path: str, slice_: int | None = None) -> DataFrame:
    """Curated pairs: ids from the raw list, else the selected id; both sides of a pair may be
    atlas or sample; rows of another slice are an error."""
    df = read(spark, path)
    if slice_ is not None:
        contracts.require_empty(df.filter(F.col("atlas_z_slice").try_cast("double") != slice_).select("group_id"), "pairs of another slice")

    def ids(side: str):
        raw = id_list(F.col(f"{side}_selected_raw_ids")) if f"{side}_selected_raw_ids" in df.columns else id_list(F.col(f"{side}_raw_selected_ids"))
        return F.when(F.size(raw) > 0, raw).otherwise(id_list(F.col(f"{side}_selected_id").cast("string")))

    atlas_left = F.lower("left_dataset_kind") == "atlas"
    return pairing_groups(df, F.when(atlas_left, ids("right")).otherwise(ids("left")), F.when(atlas_left, ids("left")).otherwise(ids("right")))


def read_raster(spark: SparkSession, path: str, slice_: int | None = None, flip: bool = False) -> DataFrame:
    """A label raster from its rows (z, iy, ix, label), one slice, flipped top to bottom if asked."""
    df = read(spark, path)
    if slice_ is not None:
        df = df.filter(F.col("z") == slice_)
    if not flip:
        return df.select("iy", "ix", "label")
    top = df.agg(F.max("iy").alias("top"))
    return df.join(F.broadcast(top)).select((F.col("top") - F.col("iy")).alias("iy"), "ix", "label")


def read_features(spark: SparkSession, path: str, trim: int = 0) -> DataFrame:
    """A feature grid (iy, ix, then array columns) as iy, ix, v: arrays joined, the border trimmed,
    pixels with a value that is not finite dropped."""
    df = read(spark, path)
    v = F.concat(*[c for c in df.columns if c not in ("iy", "ix")])
    box = df.agg(F.max("iy").alias("my"), F.max("ix").alias("mx"))
    inside = F.col("iy").between(trim, F.col("my") - trim) & F.col("ix").between(trim, F.col("mx") - trim)
    df = df.join(F.broadcast(box)).filter(inside).select("iy", "ix", v.alias("v"))
    return df.filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def image_manifest(images: DataFrame, target: float = 0.5, pad: int = 224) -> DataFrame:
    """Sizes after rescaling to `target` microns a pixel and padding to a multiple of `pad`, and the
    feature grid's shape. images: path, height, width, mpp."""
    scaled = lambda c: F.round(F.col(c) * F.col("mpp") / target).cast("long")
    up = lambda c: (F.ceil(F.col(c) / pad) * pad).cast("long")
    df = images.withColumn("h", scaled("height")).withColumn("w", scaled("width")).withColumn("padded_h", up("h")).withColumn("padded_w", up("w"))
    return df.withColumn("grid_h", (F.col("padded_h") / 16).cast("long")).withColumn("grid_w", (F.col("padded_w") / 16).cast("long"))


def config_key(config: dict) -> str:
    return hashlib.sha256(json.dumps(config, sort_keys=True).encode()).hexdigest()[:16]


def cached(spark: SparkSession, folder: str, config: dict, build) -> DataFrame:
    """The table of a configuration: read if it was written whole, else built, written, read."""
    at = f"{folder}/{config_key(config)}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        build().write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


def write_samples(df: DataFrame, folder: str, kind: str = "parquet") -> None:
    """One partition folder a sample; rows of a sample are spread over as many files as they need."""
    df.repartition("sample_id", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode("overwrite").partitionBy("sample_id").format(kind).options(**({"header": True} if kind == "csv" else {})).save(folder)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    cols = sorted(a.columns)
    return cols == sorted(b.columns) and a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()


def two_samples(spark: SparkSession, clusters: int = 3, points: int = 20, seed: int = 0) -> DataFrame:
    """A reference of Gaussian clusters and a query that a turn of 18 degrees and a scale of 1.08
    bring back to it: id, sample_id, cluster, x, y."""
    import math

    centres = [(0.0, 0.0), (3.0, 0.0), (1.5, 2.2)]
    n = spark.range(clusters * points).withColumn("c", (F.col("id") % clusters).cast("int"))
    at = lambda k: F.element_at(F.array(*[F.lit(centres[i % 3][k] + 4.0 * (i // 3)) for i in range(clusters)]), F.col("c") + 1)
    r = n.select("id", F.col("c").cast("string").alias("cluster"), (at(0) + 0.18 * F.randn(seed)).alias("x"), (at(1) + 0.18 * F.randn(seed + 1)).alias("y"))
    t = math.radians(18)
    x, y = F.col("x") - 0.8, F.col("y") + 0.4
    q = r.select((F.col("id") + clusters * points).alias("id"), "cluster", ((x * math.cos(t) + y * math.sin(t)) / 1.08).alias("x"), ((y * math.cos(t) - x * math.sin(t)) / 1.08).alias("y"))
    return r.withColumn("sample_id", F.lit("reference")).unionByName(q.withColumn("sample_id", F.lit("query")))


def read_arrays(spark: SparkSession, folder: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """NPZ replicates as rows: repeat (the number in the file's name), name (aliased), shape, values.
    A file is read whole by the task that holds it."""
    names = aliases or {}

    def run(batches):
        import io
        import re

        import numpy as np
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"]):
                number = re.search(r"(\d+)\.npz$", path)
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    rows += [(int(number[1]) if number else -1, names.get(k, k), list(z[k].shape), np.asarray(z[k], float).ravel()) for k in z.files]
            yield pd.DataFrame(rows, columns=["repeat", "name", "shape", "values"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npz").load(folder).select("path", "content")
    return files.mapInPandas(run, "repeat long, name string, shape array<long>, values array<double>")


def legacy_batch(meta: DataFrame, genes_by_spot: DataFrame, prefix: str, index: int) -> tuple[DataFrame, DataFrame]:
    """A sample in the older layout: expression with a gene a row and a spot a column. The sample id
    is <prefix>_sample<index>_<slide>_age<age>."""
    sample = F.concat_ws("_", F.lit(prefix), F.lit(f"sample{index}"), F.col("slide").cast("string"), F.concat(F.lit("age"), F.col("age").cast("string")))
    spots = [c for c in genes_by_spot.columns if c != "gene"]
    cast = genes_by_spot.select("gene", *[F.col(f"`{s}`").try_cast("double").alias(s) for s in spots])
    return meta.withColumn("sample_id", sample), cast.unpivot(["gene"], [f"`{s}`" for s in spots], "obs", "value")
