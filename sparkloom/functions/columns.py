"""Scalar functions as Catalyst expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The barcode, trailing number, age and cortical layer patterns.
BARCODE = r"([ACGT]+-[0-9]+)(?:$|\|)"
TRAILING_NUMBER = r"(\d+(?:\.\d+)?)$"
AGE = r"age\s*([0-9]+\.?[0-9]*)"
LAYER = r"\blayer\s*(1|2/3|4|5|6a|6b)\b"


def barcode(c: Column) -> Column:
    """Terminal barcode of an id, null if there is none."""
    return F.nullif(F.regexp_extract(F.trim(c), BARCODE, 1), F.lit(""))


def trailing_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, TRAILING_NUMBER, 1), F.lit("")).try_cast("double")


def age(c: Column) -> Column:
    """The number after `age`, else the first number."""
    named = F.nullif(F.regexp_extract(F.lower(c), AGE, 1), F.lit(""))
    first = F.nullif(F.regexp_extract(c, r"([0-9]+\.?[0-9]*)", 1), F.lit(""))
    return F.coalesce(named, first).try_cast("double")


def id_list(c: Column) -> Column:
    """Sorted distinct integers of `[1, 2]`, `1;2`, `1, 2` or floats; unreadable parts are dropped."""
    parts = F.split(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\[\](){}\s'\"]", ""), "[,;|]")
    return F.array_sort(F.array_distinct(F.filter(F.transform(parts, lambda x: x.try_cast("double").cast("long")), lambda x: x.isNotNull())))


def layer(c: Column) -> Column:
    """Cortical layer named in a structure name, null if there is none."""
    return F.nullif(F.regexp_extract(F.lower(c), LAYER, 1), F.lit(""))


def complete(c: Column) -> Column:
    """Whether a label says something: not null, blank, nan or none."""
    return F.coalesce(~F.lower(F.trim(c)).isin("", "nan", "none"), F.lit(False))


def half_even(c: Column) -> Column:
    return F.rint(c)


def similarity(x: Column, y: Column, scale: float, theta: float, tx: float, ty: float) -> tuple[Column, Column]:
    a, b = scale * math.cos(theta), scale * math.sin(theta)
    return a * x - b * y + tx, b * x + a * y + ty


def acat_term(p: Column) -> Column:
    """Cauchy term of a p-value clipped to [1e-15, 1 - 1e-15]; the tail form below 1e-12."""
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    return F.when(q < 1e-12, 1 / (F.lit(math.pi) * q)).otherwise(F.tan((0.5 - q) * math.pi))


def acat_p(t: Column) -> Column:
    """The p-value of a weighted mean of Cauchy terms."""
    return F.when(t > 1e15, 1 / (F.lit(math.pi) * t)).otherwise(0.5 - F.atan(t) / math.pi)


def area_similarity(a: Column, b: Column) -> Column:
    return F.when((a > 0) & (b > 0), F.exp(-F.abs(F.ln(a / b)))).otherwise(F.lit(0.0))


def gate_factor(terms: list[tuple[Column, Column]], floor: float = 0.45) -> Column:
    """Product of penalties: terms are (fails, ratio); a ratio never goes under the floor."""
    out = F.lit(1.0)
    for fails, ratio in terms:
        out = out * F.when(fails, F.greatest(ratio, F.lit(floor))).otherwise(F.lit(1.0))
    return F.greatest(out, F.lit(floor))


def composite(metrics: list[tuple[float, Column]]) -> Column:
    """Weighted sum of metrics clipped to [0, 1]; null or NaN counts 0; weights add up to 1."""
    if abs(sum(w for w, _ in metrics) - 1) > 1e-6:
        raise ValueError("weights must add up to 1")
    total = F.lit(0.0)
    for w, m in metrics:
        total = total + w * F.coalesce(F.nanvl(m, F.lit(0.0)), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), total))


def distance_gate(base: Column, distance: Column, centre: float = 16.0, width: float = 6.0) -> Column:
    """base * (0.5 + 0.5 * logistic of -(distance - centre) / width), exponent clipped to 60; an
    infinite distance gates to 0."""
    z = F.least(F.greatest((distance - centre) / width, F.lit(-60.0)), F.lit(60.0))
    return F.when(distance == float("inf"), F.lit(0.0)).otherwise(base * (0.5 + 0.5 / (1 + F.exp(z))))


def inflate(variance: Column, risk: Column, lam: Column | float, power: int = 2) -> Column:
    return variance * (1 + lam * F.pow(risk, F.lit(power)))
