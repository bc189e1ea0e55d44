"""Tables in the folder that all machines share: how loops cut their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, with its file system's scheme. Where none is named,
    a private folder serves a session in one process; on a cluster that is an error, as executors
    would each write to their own disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("name a folder that all machines share in spark.checkpoint.dir")
        at = "file://" + tempfile.mkdtemp(prefix="sparkloom-")
        spark.sparkContext.setCheckpointDir(at)
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files.makeQualified(path).toString().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise df once as a table in the shared folder and read it back: short lineage that
    survives a lost executor, and no second computation as checkpoint() would make."""
    at = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
