"""Line deduplication against levelled sorted runs of line hashes, with DataFrame functions only.

A run is a bucketed table (h, g, n), sorted within its buckets: 128 bits of hash of a line's key and
in how many documents it has been found up to that run's batch. A batch is merge-joined with the
runs, bucket against bucket, so only the batch is shuffled; keys that a run counts often enough are
settled and go no further, the others are added up and become a run of the lowest level. FANOUT runs
of one level are merged into one of the next, so n batches leave about FANOUT * log(n) runs."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, cut, fits, lower_az, shared_dir, small, unused, with_row_id

LEAST, SHORTEST = 10, 1
#: Runs of one level that are merged into one of the next.
FANOUT = 3
#: Batches in which a table is taken.
BATCHES = 4
KEY = ["h", "g"]


def key_of(line: Column) -> Column:
    return F.btrim(line, F.lit(WS))


def line_keys(text: Column) -> Column:
    """The keys of a text's lines, in their order: white space stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(lower_az(F.coalesce(text, F.lit(""))), "\n", -1), key_of)


def hashed(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h"), F.xxhash64(F.lit(12), key).alias("g")]


def count_lines(docs: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    """h, g and n, the documents (rows) that hold the key, of all keys of at least `shortest`
    characters. A document's keys are made distinct before they leave it, and counted before the
    shuffle, so a line of every document costs one row a task."""
    keys = docs.select(F.explode(F.array_distinct(line_keys(F.col("text")))).alias("k"))
    return keys.filter(F.length("k") >= max(1, shortest)).select(*hashed(F.col("k"))).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"))


class Runs:
    """The levelled runs of one folder. The list of runs is the driver's; their rows never are.

    `buckets` is fixed for the life of a folder; by default the session's shuffle partitions."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int | None = None, least: int = LEAST, fanout: int = FANOUT):
        self.spark, self.folder, self.least, self.fanout = spark, folder, least, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def tables(self) -> list[str]:
        return [t for level in self.levels for t in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _files(self, tables: list[str]) -> DataFrame:
        """Rows of several runs, as plain files: a union of bucketed scans may claim a partitioning
        that the planner then takes from its scans."""
        return self.spark.read.schema("h long, g long, n long").parquet(*[f"{self.folder}/{t}" for t in tables])

    def settled(self) -> DataFrame:
        """h, g of the keys in `least` documents or more, each in the one run that settled it."""
        tables = self.tables()
        if not tables:
            return self.spark.createDataFrame([], "h long, g long")
        return self._files(tables).filter(F.col("n") >= self.least).select(*KEY)

    def add(self, counts: DataFrame) -> None:
        """Take a batch's counts (h, g, n): one pass of merge joins against the runs leaves out what
        they settle and adds their counts to the rest, which become a run of the lowest level."""
        rows = counts.select(*KEY, "n").repartition(self.buckets, *KEY)
        for i, t in enumerate(self.tables()):
            rows = rows.join(self.spark.table(t).withColumnRenamed("n", f"n{i}").hint("merge"), KEY, "left")
        earlier = [F.coalesce(f"n{i}", F.lit(0)) for i in range(len(self.tables()))]
        if earlier:
            before = F.greatest(F.lit(0), *earlier)
            rows = rows.filter(before < self.least).select(*KEY, (F.col("n") + before).alias("n"))
        if not self.levels:
            self.levels.append([])
        self.levels[0].append(self._write(rows))
        self.compact()

    def compact(self) -> None:
        """Merge full levels upwards: a key's row in the latest run holds its highest count."""
        k = 0
        while k < len(self.levels) and len(self.levels[k]) >= self.fanout:
            gone = self.levels[k]
            merged = self._files(gone).groupBy(*KEY).agg(F.max("n").alias("n")).repartition(self.buckets, *KEY)
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._write(merged))
            self.levels[k] = []
            self.forget(gone)
            k += 1

    def forget(self, tables: list[str]) -> None:
        """Take runs' names from the session; their files stay, as tasks may still read them."""
        for t in tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")

    def close(self) -> None:
        self.forget(self.tables())


def frequent_lines(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, batches: int = BATCHES) -> DataFrame:
    """h, g of the keys in `least` documents or more, by runs of `batches` batches of the documents.
    Texts are read once: the counts are written by batch, a key's rows in all batches together at
    most its documents."""
    spark = docs.sparkSession
    batch = F.pmod(F.xxhash64(F.lit(5), "text"), F.lit(batches)) if batches > 1 else F.lit(0)
    keys = docs.select(batch.cast("int").alias("batch"), F.explode(F.array_distinct(line_keys(F.col("text")))).alias("k"))
    counts = keys.filter(F.length("k") >= max(1, shortest)).select("batch", *hashed(F.col("k"))).groupBy("batch", *KEY).agg(F.count(F.lit(1)).alias("n"))
    at = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    counts.write.partitionBy("batch").parquet(f"{at}/counts")
    counts = spark.read.schema("h long, g long, n long, batch int").parquet(f"{at}/counts")
    runs = Runs(spark, at, least=least)
    try:
        for b in range(batches):
            runs.add(counts.filter(F.col("batch") == b).select(*KEY, "n"))
        return runs.settled()
    finally:
        runs.close()


def places(docs: DataFrame, rid: str, frequent: DataFrame) -> DataFrame:
    """rid and at: the places (from 0, ascending) of a document's lines whose key is in `frequent`
    (h, g). Only these places are shuffled, never texts."""
    lines = docs.select(F.col(rid).alias("rid"), F.posexplode(line_keys(F.col("text"))).alias("at", "k"))
    marked = lines.filter("k <> ''").select("rid", "at", *hashed(F.col("k"))).join(small(frequent), KEY, "left_semi")
    return marked.groupBy("rid").agg(F.array_sort(F.collect_list("at")).alias("at"))


def without(lines: Column, at: Column) -> Column:
    """The lines (an array) but those at the places `at` (ascending), in time linear in both: the
    stretches between dropped places are sliced out and joined."""
    end = lambda i: F.when(i < F.size(at), F.get(at, i)).otherwise(F.size(lines))
    start = lambda i: F.when(i > 0, F.get(at, i - 1) + 1).otherwise(0)
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(at)), lambda i: F.slice(lines, start(i) + 1, end(i) - start(i))))


def strip_lines(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, batches: int = BATCHES) -> DataFrame:
    """docs with two columns more: n_lines (before) and dropped (lines that went), and a text whose
    lines with frequent keys are gone. See `line_dedup` for what counts; columns of docs ride along
    whatever their names, but a column named n_lines or dropped is replaced."""
    rid, at = unused(docs, "rid", "at")
    rows = with_row_id(docs, rid)
    frequent = frequent_lines(rows.select("text"), least, shortest, batches)
    found = cut(places(rows, rid, cut(frequent)))
    # the size of an array is not known to the measure, so its places count as rows of their own
    ok = fits(found.select("rid", F.explode("at").alias("at")))
    found = found.select(F.col("rid").alias(rid), F.col("at").alias(at))
    joined = rows.join(F.broadcast(found) if ok else found, rid, "left")
    lines, text = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1), F.col("text")
    kept = F.when(F.col(at).isNull(), text).otherwise(F.array_join(without(lines, F.col(at)), "\n"))
    return joined.withColumns({"n_lines": F.size(lines).cast("long"), "dropped": F.coalesce(F.size(at), F.lit(0)).cast("long"), "text": kept}).drop(rid, at)


def line_dedup(docs: DataFrame, least: int = LEAST, shortest: int = SHORTEST, batches: int = BATCHES) -> DataFrame:
    """Drop lines that many documents share, in every document.

    Texts are split at \\n; a line's key is the line with white space stripped at both ends and A-Z
    lower-cased. Keys of at least `shortest` characters (1 at least: blank lines stay) found in at
    least `least` rows lose all their lines. Returns doc_id, n_lines, n_dropped and kept_sha256 (of
    the other lines joined by \\n), one row per input row. Null text counts as empty, one empty line;
    repeated rows are a document each, and no line counts twice for one document. Null ids ride
    along; other columns are ignored, whatever their names; an empty table gives an empty one.
    Keys are compared by 128 bits of hash."""
    out = strip_lines(docs.select("doc_id", "text"), least, shortest, batches)
    return out.select("doc_id", "n_lines", F.col("dropped").alias("n_dropped"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))
