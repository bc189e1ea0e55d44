"""A registry of queries: name -> (query, SQL, double columns), doubles rounded alike on both sides."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}
DIGITS = 6
NUDGE = 3.17e-9


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Round doubles, a little over so that no exact half decides by its last bit; no -0.0."""
    return df.select(*[(F.round(F.col(c) + NUDGE, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, doubles: str = "", digits: int = DIGITS):
    """Register fn(spark, sf_dir) under its name; sql is the same query, its doubles named."""

    def add(fn):
        QUERIES[fn.__name__] = lambda spark, d: rounded(fn(spark, d), digits)
        if sql:
            cols = ", ".join(f"round({c} + {NUDGE}, {digits}) + 0.0 AS {c}" for c in doubles.split())
            SQL[fn.__name__] = f"SELECT * REPLACE ({cols}) FROM ({sql})" if cols else sql
        return fn

    return add
