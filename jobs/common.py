"""What the jobs share: logging, config files, partitioned writes that replace what they write again."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

log = logging.getLogger("jobs")


def config_of(file: str, given: dict | None = None) -> dict:
    """The config file beside a job, with what is given put over it; unknown names are an error."""
    config = json.loads(Path(file).with_suffix(".json").read_text())
    if unknown := set(given or {}) - set(config):
        raise ValueError(f"no such settings: {sorted(unknown)}")
    return config | (given or {})


def replace(df: DataFrame, path: str, *by: str, files: int = 1, then: Callable[[DataFrame], DataFrame] | None = None, key: tuple[str, ...] = ()) -> None:
    """Write df partitioned by columns; a partition that is written again replaces the earlier one,
    others stay. A partition's rows go to `files` files by a hash of the key (of all other columns
    without one), so a large one is not one task. `then` makes the rows that are written of those
    that are sent there."""
    spread = F.pmod(F.xxhash64(*(key or [c for c in df.columns if c not in by])), F.lit(files))
    dealt = df.repartition(*by, spread)
    dealt = dealt if then is None else then(dealt)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def main(job, doc: str, paths: list[str]) -> None:
    """The command line of a job: the named paths, and a config file that replaces the one beside it."""
    parser = argparse.ArgumentParser(description=doc)
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    parser.add_argument("--config", help="JSON with settings that replace the job's own")
    args = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(Path(sys.argv[0]).stem).getOrCreate()
    try:
        given = json.loads("\n".join(r.value for r in spark.read.text(args["config"], wholetext=True).collect())) if args["config"] else None
        job(spark, **{p: args[p] for p in paths}, settings=given)
    finally:
        spark.stop()
