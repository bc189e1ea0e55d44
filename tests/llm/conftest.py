import os
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

#: Extra columns clash with the operators' own names.
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("size", T.StringType()), T.StructField("n", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("key", T.LongType())])


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "the", "of", "and", "to", "river", "stone", "cloud", "tree", "house", "paper", "light"]) + rng.choice(["", "s", "ing", "ed", "ly"]) for _ in range(n))


def make(spark, rows):
    return spark.createDataFrame([Row(*r, "x", 1, "y", None) for r in rows], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    """Nulls in every column, empty, blank, very long, tied and repeated rows, exact and near copies."""
    rng = random.Random(5)
    out = [(i, words(rng, rng.randint(20, 120)), "en", f"s{rng.randint(0, 3)}") for i in range(60)]
    long = words(rng, 40_000)
    base = words(rng, 100).split()
    out += [(100 + i, " ".join([*base[: 90 + i % 3], "odd", f"w{i}"]), "en", "s0") for i in range(12)]
    out += [(200, None, None, None), (201, "", "en", "s1"), (202, " \n\t ", "en", "s1"), (203, "é", "fr", None), (204, long, "en", "s2"), (205, long + " ", "en", "s2"), (206, "one", "en", "s1"), (207, "One", "en", "s1"), (208, "a b", "en", "s9"), (None, "no id at all but some words", "en", "s1")]
    out += [(300 + i, "same text here " * 12, "en", "s0") for i in range(30)]
    out += [(330, "same  text here " * 12, "en", "s0"), (300, "same text here " * 12, "en", "s0")]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("docs"))
    make(spark, rows).repartition(3).write.mode("overwrite").parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="session")
def none(spark):
    return make(spark, [])


@pytest.fixture(scope="session")
def sf():
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    return d
