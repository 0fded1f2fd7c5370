"""Boolean readings of loosely typed columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelode.config import FALSE_WORDS


def is_true(col: Column, dtype: str = "boolean") -> Column:
    """True unless null, zero or one of the words that mean no."""
    if dtype == "boolean":
        return F.coalesce(col, F.lit(False))
    if dtype == "string":
        return F.coalesce(~F.lower(F.trim(col)).isin(*FALSE_WORDS), F.lit(False))
    return F.coalesce(col != 0, F.lit(False))
