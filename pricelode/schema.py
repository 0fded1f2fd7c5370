"""Table schemas and the step that brings any input to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.functions.numbers import to_int, to_number

_TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(),
    "boolean": T.BooleanType(), "date": T.DateType(), "timestamp": T.TimestampType(),
    "array<string>": T.ArrayType(T.StringType()),
}


def struct(fields: str) -> T.StructType:
    """``"a string, b int"`` as a schema, without needing a running session."""
    pairs = [f.split() for f in fields.replace("\n", " ").split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


LISTING = struct(
    """
    source string, listing_id string, url string, urls array<string>, reg_no string, vins array<string>,
    make string, model_slug string, model string, variant string, model_year int, mileage bigint,
    price double, gearbox string, damaged boolean, body string, auction boolean, trim string, owners int,
    tow_hook boolean, heater boolean, certified boolean, big_battery boolean, rental boolean,
    imported boolean, first_registration string, service_history string, last_service string,
    next_service string, place string, dealer string, description string
    """
)

OBSERVATION = struct(
    """
    kind string, ts timestamp, listing_key string, listing_id string, reg_no string, model string,
    variant string, model_year int, mileage bigint, price double, trim string, tow_hook boolean,
    heater boolean, certified boolean, big_battery boolean, sources array<string>, url string,
    asking_price double, market_value double, diff double, bargain_pct double, n_comparables int,
    basis_strength string, adjusted_median double
    """
)

STATE = struct(
    """
    state_key string, first_seen date, first_price double, last_price double, last_seen date,
    notified boolean, notified_price double, migrated_from string
    """
)


def _read(col: Column, kind: T.DataType, given: str) -> Column:
    if isinstance(kind, (T.IntegerType, T.LongType)) and (given in ("string", "float", "double") or given.startswith("decimal")):
        return to_int(col).cast(kind)
    if given != "string" or isinstance(kind, T.StringType):
        return col.cast(kind)
    if isinstance(kind, T.DoubleType):
        return to_number(col)
    return col.try_cast(kind)


def conform(df: DataFrame, schema: T.StructType = LISTING) -> DataFrame:
    """Give ``df`` every column of ``schema`` with its type; extra columns stay.

    Numbers are read leniently from texts, and whole numbers are rounded; a text that is no number, flag or date is null.
    """
    have = set(df.columns)
    kinds = dict(df.dtypes)
    cols = [
        _read(F.col(f.name), f.dataType, kinds[f.name]).alias(f.name) if f.name in have
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    names = set(schema.fieldNames())
    return df.select(*cols, *[F.col(c) for c in df.columns if c not in names])
