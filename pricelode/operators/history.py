"""Observation history per listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.config import KIND_LISTING, KIND_VALUATION, TrendParams
from pricelode.functions.text import blank_to_null, strip


def _as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def observation_key() -> Column:
    """reg-no, listing id, url, else the listing's values including its price."""
    reg = F.replace(F.upper(blank_to_null(F.col("reg_no"))), F.lit(" "), F.lit(""))
    by_value = F.concat_ws(
        ":", F.lit("kal"), F.lower(F.coalesce("model", F.lit(""))), _as_text("variant"),
        _as_text("model_year"), _as_text("mileage"), _as_text("price"),
    )
    return F.coalesce(
        F.concat(F.lit("reg:"), reg),
        strip(blank_to_null(F.col("listing_id"))),
        strip(blank_to_null(F.col("url"))),
        by_value,
    )


def parse_time(text: Column, timezone: str = TrendParams.timezone) -> Column:
    """ISO text to an instant; texts without zone are local time, bad ones null."""
    has_zone = text.rlike(r"(Z|[+-]\d{2}:?\d{2})$")
    local = F.convert_timezone(F.lit(timezone), F.current_timezone(), text.try_cast("timestamp_ntz"))
    return F.when(has_zone, text.try_cast("timestamp")).otherwise(local.cast("timestamp"))


def local_day(ts: Column, timezone: str = TrendParams.timezone) -> Column:
    return F.to_date(F.convert_timezone(None, F.lit(timezone), ts))


def history_index(observations: DataFrame, run_ts: Column) -> DataFrame:
    """Observations of earlier runs that have a key."""
    return observations.filter(
        F.col("listing_key").isNotNull() & (F.col("listing_key") != "") & (F.col("ts") < run_ts)
    )


def history_metrics(observations: DataFrame, run_ts: Column) -> DataFrame:
    """First and last price, fall and days per key; all aggregates combine map-side.

    Equal times are ordered by ``seq`` when the log carries one.
    """
    has_seq = "seq" in observations.columns
    at = F.struct("ts", "seq") if has_seq else F.struct("ts")
    listing = F.col("kind") == KIND_LISTING
    valued = F.col("kind") == KIND_VALUATION
    priced = listing & F.col("price").isNotNull()
    value = F.col("market_value") if "market_value" in observations.columns else F.lit(None).cast("double")
    has_value = valued & value.isNotNull()
    pick = lambda f, col, cond: f(col, F.when(cond, at))
    out = history_index(observations, run_ts).groupBy("listing_key").agg(
        F.count_if(listing).alias("n_observations"),
        F.min(F.when(listing, F.col("ts"))).alias("_first_ts"),
        pick(F.min_by, F.col("price"), priced).alias("first_price"),
        pick(F.max_by, F.col("price"), priced).alias("last_price"),
        F.count_if(valued).alias("n_valuations"),
        F.count_if(has_value).alias("_n_values"),
        pick(F.min_by, value, has_value).alias("_first_value"),
        pick(F.max_by, value, has_value).alias("last_market_value"),
    )
    days = F.floor((F.unix_timestamp(run_ts) - F.unix_timestamp("_first_ts")) / 86400)
    change = F.coalesce(F.col("last_price") - F.col("first_price"), F.lit(0.0))
    return out.select(
        "listing_key",
        "n_observations",
        F.coalesce(F.greatest(F.lit(0), days), F.lit(0)).cast("bigint").alias("days_observed"),
        "first_price",
        "last_price",
        change.alias("price_change"),
        F.greatest(F.lit(0.0), -change).alias("price_fall"),
        "last_market_value",
        F.when(F.col("_n_values") >= 2, F.col("last_market_value") - F.col("_first_value")).alias(
            "market_value_change"
        ),
        "n_valuations",
    )


HISTORY_DEFAULTS = {
    "n_observations": 0, "days_observed": 0, "price_change": 0.0, "price_fall": 0.0, "n_valuations": 0,
}


def with_history(listings: DataFrame, metrics: DataFrame) -> DataFrame:
    """Left join of the metrics under ``hist_`` names, with their defaults."""
    renamed = metrics.select(
        "listing_key", *[F.col(c).alias(f"hist_{c}") for c in metrics.columns if c != "listing_key"]
    )
    df = listings if "listing_key" in listings.columns else listings.withColumn("listing_key", observation_key())
    df = df.join(renamed, "listing_key", "left")
    return df.withColumns(
        {f"hist_{c}": F.coalesce(F.col(f"hist_{c}"), F.lit(v)) for c, v in HISTORY_DEFAULTS.items()}
    )
