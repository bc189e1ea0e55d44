"""Helpers shared by the corpus operators: row ids, checked broadcasts, gapless ranks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut, shared_dir

__all__ = ["cut", "shared_dir"]

#: The white space of every word definition here: \x20 and \x09-\x0D.
WS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A side of a join is broadcast only when its rows have been measured to be at most so large.
BROADCAST_BYTES = 32 << 20
#: Files of a table that is measured to be at most so large.
FEW_FILES = 16
#: Rows of one key that a single task ranks or solves, at least; their square root, if that is more.
CHUNK = 256


def _long_fields(kind: T.DataType, at: str) -> list[str]:
    """Paths of the strings and binaries in a row, whose length is not fixed."""
    if isinstance(kind, T.StructType):
        return [x for f in kind.fields for x in _long_fields(f.dataType, f"{at}.`{f.name}`" if at else f"`{f.name}`")]
    return [at] if isinstance(kind, (T.StringType, T.BinaryType)) else []


def fits(df: DataFrame) -> bool:
    """Whether all rows of a materialised table of scalars together are small enough for every
    executor: 16 bytes a column, 32 a row, and the bytes of strings and binaries."""
    long_ = _long_fields(df.schema, "")
    n, *sums = df.agg(F.count(F.lit(1)), *[F.sum(F.octet_length(F.col(c))) for c in long_]).first()
    return n * (32 + 16 * len(df.columns)) + sum(s or 0 for s in sums) <= BROADCAST_BYTES


def small(df: DataFrame, ok: bool | None = None) -> DataFrame:
    """df with a broadcast hint if it fits (as measured here, unless `ok` says so already); else as
    it is, for a join that shuffles."""
    return F.broadcast(df) if (fits(df) if ok is None else ok) else df


def cut_few(df: DataFrame, few: bool) -> DataFrame:
    """cut, in at most FEW_FILES files if the caller has measured that its rows are few (`fits`, of
    the table itself or of one that bounds it): a loop's small tables would else be as many
    near-empty files as a shuffle has partitions."""
    return cut(df.coalesce(FEW_FILES) if few else df)


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores behind as no column of df has it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def is_scan(df: DataFrame) -> bool:
    """Whether df is one scan of files, each read once, with projections and filters only: then a
    file's name and a row's place in it are the row's alone. Joins, explodes and unions repeat them."""
    plan = df._jdf.queryExecution().analyzed()
    if not plan.deterministic():
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias", "View"):
        plan = plan.children().head()
    if plan.nodeName() != "LogicalRelation" or plan.relation().getClass().getSimpleName() != "HadoopFsRelation":
        return False
    roots = plan.relation().location().rootPaths()
    at = sorted(roots.apply(i).toString().rstrip("/") + "/" for i in range(roots.size()))
    return not any(b.startswith(a) for a, b in zip(at, at[1:]))


def with_row_id(docs: DataFrame, name: str) -> DataFrame:
    """docs and, in column `name`, what tells its rows apart in every scan: the file a row stands in
    (hashed) and its place there, however files are split into tasks. What is not a plain scan of
    files (see `is_scan`) is written out first, with its ids."""
    if "_metadata" not in (c.lower() for c in docs.columns) and is_scan(docs):
        f, r = F.xxhash64(F.col("_metadata.file_path")), F.col("_metadata.row_index")
        try:
            return docs.withColumn(name, F.struct(f.alias("f"), r.alias("r")))
        except AnalysisException:  # a format without row places
            pass
    return cut(docs.withColumn(name, F.struct(F.lit(0).cast("long").alias("f"), F.monotonically_increasing_id().alias("r"))))


def _bucket(rid: str) -> list[Column]:
    return [F.col(f"{rid}.f").alias("__f"), F.bitmap_bucket_number(f"{rid}.r").alias("__b")]


def row_bits(ids: DataFrame) -> DataFrame:
    """The row ids in the one column of ids as bits: a row for each 32,768 rows of a file that have
    one, at most 4 KiB, so an eighth of a byte for each row of the table."""
    (rid,) = ids.columns
    return ids.groupBy(*_bucket(rid)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(f"{rid}.r")).alias("__bits"))


def _marked(docs: DataFrame, rid: str, bits: DataFrame) -> DataFrame:
    """docs and, in __in, whether a row's id is among the (broadcast) bits."""
    f, b = _bucket(rid)
    place = F.bitmap_bit_position(f"{rid}.r")
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    set_ = F.getbit(byte, (place % 8).cast("int")) == 1
    joined = docs.withColumns({"__rf": f, "__rb": b}).join(F.broadcast(bits), (F.col("__rf") == F.col("__f")) & (F.col("__rb") == F.col("__b")), "left")
    return joined.withColumn("__in", F.coalesce(set_, F.lit(False))).drop("__rf", "__rb", "__f", "__b", "__bits")


def only_rows(docs: DataFrame, rid: str, ids: DataFrame) -> DataFrame | None:
    """docs (row ids in `rid`) with the rows whose ids are in the one column of ids, a materialised
    table: by a broadcast of the ids or, where they are too many, of their bits. None where both are
    too large to broadcast."""
    if fits(ids):
        return docs.join(F.broadcast(ids.toDF(rid)), rid, "left_semi")
    bits = cut(row_bits(ids))
    return _marked(docs, rid, bits).filter("__in").drop("__in") if fits(bits) else None


def without_rows(docs: DataFrame, rid: str, gone: DataFrame) -> DataFrame:
    """docs (with row ids in `rid`) without the rows whose ids are in the one column of `gone`, a
    materialised table: by a broadcast of the ids or of their bits, else by a join that shuffles."""
    if fits(gone):
        return docs.join(F.broadcast(gone.toDF(rid)), rid, "left_anti").drop(rid)
    bits = cut(row_bits(gone))
    if fits(bits):
        return _marked(docs, rid, bits).filter("NOT __in").drop("__in", rid)
    return docs.join(gone.toDF(rid), rid, "left_anti").drop(rid)


def lean_batches(spark: SparkSession) -> None:
    """Texts go to Python workers a thousand at a time, unless the session says otherwise already:
    Spark's own ten thousand would take a tenth of a small executor for each task."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, "1000")


def lower_az(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def chunks_of(n: Column, chunk: int = CHUNK) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / chunk)).cast("long")


def gapless_rank(df: DataFrame, key: str, tie: list[str], out: str, chunk: int = CHUNK) -> DataFrame:
    """Number the rows of each key 0, 1, 2, ... in column `out` without bringing a key together.

    The caller guarantees few distinct keys (at most a few thousand), so the table of counts is
    small by construction. Each key is dealt by a hash of `tie` into chunks of about `chunk` rows or
    the square root of its rows, whichever is more; a window numbers each chunk, and running sums of
    chunk counts give the offsets, so neither window sees more rows than that. Rows equal in
    `tie` are interchangeable. `df` should be materialised: it is read twice."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))
    n = F.col("__n")
    salts = F.broadcast(counts.select(key, F.ceil(n / F.greatest(F.lit(float(chunk)), F.sqrt(n))).cast("long").alias("__s")))
    dealt = df.join(salts, key).withColumn("__salt", F.pmod(F.xxhash64(*tie), F.col("__s"))).drop("__s")
    within = Window.partitionBy(key, "__salt").orderBy(*tie)
    before = Window.partitionBy(key).orderBy("__salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = dealt.groupBy(key, "__salt").agg(F.count(F.lit(1)).alias("__c"))
    offsets = sizes.select(key, "__salt", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__o"))
    ranked = dealt.withColumn("__k", F.row_number().over(within) - 1)
    return ranked.join(offsets, [key, "__salt"]).withColumn(out, F.col("__o") + F.col("__k")).drop("__salt", "__o", "__k")
