"""Numeric columns: lenient parsing, similarities, ages, half-even rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_number(col: Column) -> Column:
    """Lenient number: text without spaces and other signs, with a decimal comma; numbers as they are; no booleans."""
    text = F.translate(F.replace(col.cast("string"), F.lit(" "), F.lit("")), ",", ".")
    read = F.regexp_replace(text, r"[^0-9.\-]", "").try_cast("double")
    kind = F.typeof(col)
    return F.when(kind == "string", read).when(kind != "boolean", col.try_cast("double"))


def to_int(col: Column) -> Column:
    return F.rint(to_number(col)).cast("bigint")


def half_even(col: Column, step: int = 1) -> Column:
    """Nearest multiple of ``step``, ties to the even multiple."""
    return F.rint(col / F.lit(float(step))) * F.lit(float(step)) if step != 1 else F.rint(col)


def half_even_digits(col: Column, places: int) -> Column:
    scale = float(10**places)
    return F.rint(col * scale) / scale


def mileage_similarity(gap: Column, margin: int = 300) -> Column:
    """1 up to 50 apart, .95 up to 100, then falling to 0 at ``margin``."""
    falling = F.lit(0.95) - (gap - 100) / F.lit(float(margin - 100)) * F.lit(0.95)
    return (
        F.when(gap.isNull(), 0.0).when(gap <= 50, 1.0).when(gap <= 100, 0.95)
        .when(gap > margin, 0.0).otherwise(falling)
    )


def price_similarity(gap: Column, margin: int = 5000) -> Column:
    """1 up to 1000 apart, then falling to .5 at ``margin``, 0 beyond."""
    falling = F.lit(1.0) - (gap - 1000) / F.lit(float(margin - 1000)) * F.lit(0.5)
    return (
        F.when(gap.isNull(), 0.0).when(gap <= 1000, 1.0).when(gap > margin, 0.0).otherwise(falling)
    )


def age_in_years(model_year: Column, as_of: Column) -> Column:
    """Years since June of the model year, never negative; unknown year gives 0."""
    age = (F.year(as_of) - model_year) + (F.month(as_of) - 6) / F.lit(12)
    known = model_year.isNotNull() & (model_year != 0)
    return F.when(known, F.greatest(F.lit(0.0), age)).otherwise(F.lit(0.0))


def step_table_from_top(value: Column, table) -> Column:
    """Points of the first threshold (descending) that ``value`` reaches."""
    expr = None
    for threshold, points in table:
        hit = value >= F.lit(threshold)
        expr = F.when(hit, points) if expr is None else expr.when(hit, points)
    return expr.otherwise(0)


def step_table_below(value: Column, table) -> Column:
    """Points of the first threshold (ascending) that ``value`` stays below."""
    expr = None
    for threshold, points in table:
        hit = value < F.lit(threshold)
        expr = F.when(hit, points) if expr is None else expr.when(hit, points)
    return expr.otherwise(0)
