"""Daily price series per market category and the current run of movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.config import (
    KIND_LISTING,
    REPORT_VARIANT_LENGTH,
    TREND_DOWN,
    TREND_FLAT,
    TREND_INSUFFICIENT,
    TREND_STABLE,
    TREND_UP,
    TrendParams,
)
from pricelode.functions.text import strip
from pricelode.operators.history import local_day
from pricelode.operators.stats import exact_median


def trend_category() -> Column:
    part = lambda c: F.lower(strip(F.coalesce(F.col(c).cast("string"), F.lit(""))))
    return F.concat_ws(
        "|", part("model"), part("variant"), F.coalesce(F.col("model_year").cast("string"), F.lit("None"))
    )


def daily_prices(observations: DataFrame, params: TrendParams | None = None) -> DataFrame:
    """Median price and number of observations per category and local day."""
    params = params or TrendParams()
    rows = observations.filter((F.col("kind") == KIND_LISTING) & F.col("price").isNotNull()).select(
        trend_category().alias("category"), local_day(F.col("ts"), params.timezone).alias("day"), "price"
    )
    return exact_median(rows.filter("day is not null"), ["category", "day"], "price", "median_price", "n")


def clip_window(daily: DataFrame, params: TrendParams | None = None) -> DataFrame:
    """Days within the window that ends at the category's last day."""
    params = params or TrendParams()
    last = F.max("day").over(Window.partitionBy("category"))
    return daily.withColumn("_last", last).filter(
        F.datediff("_last", "day") <= params.window_days - 1
    ).drop("_last")


def percent_change(before: Column, after: Column) -> Column:
    return F.when(before <= 0, F.lit(0.0)).otherwise((after - before) / before * 100.0)


def direction(percent: Column, params: TrendParams) -> Column:
    return (
        F.when(percent >= params.step_percent, TREND_UP)
        .when(percent <= -params.step_percent, TREND_DOWN)
        .otherwise(TREND_FLAT)
    )


def steps(daily: DataFrame, params: TrendParams | None = None) -> DataFrame:
    """Movement from the previous observed day; null on a category's first day."""
    params = params or TrendParams()
    w = Window.partitionBy("category").orderBy("day")
    before = F.lag("median_price").over(w)
    df = daily.withColumn("from_day", F.lag("day").over(w)).withColumn("from_price", before)
    pct = percent_change(F.col("from_price"), F.col("median_price"))
    df = df.withColumn("step_percent", F.when(F.col("from_day").isNotNull(), pct))
    return df.withColumn(
        "direction", F.when(F.col("from_day").isNotNull(), direction(F.col("step_percent"), params))
    )


def trend_table(observations: DataFrame, params: TrendParams | None = None) -> DataFrame:
    """One row per category: the maximal trailing run of same-way steps.

    The daily rows of a category are bounded by the calendar; all windows and
    the final aggregate reuse the one shuffle by category.
    """
    params = params or TrendParams()
    moved = steps(clip_window(daily_prices(observations, params), params), params)
    back = Window.partitionBy("category").orderBy(F.col("day").desc())
    moved = moved.withColumn("_now", F.first("direction").over(back))
    broken = (~F.col("direction").eqNullSafe(F.col("_now"))).cast("int")
    in_run = F.sum(broken).over(back) == 0
    moved = moved.withColumn("_run", in_run & F.col("direction").isin(TREND_UP, TREND_DOWN))
    run = F.col("_run")
    agg = moved.groupBy("category").agg(
        F.count("*").alias("n_days"),
        F.max("_now").alias("_now"),
        F.count_if(run).alias("_steps"),
        F.min_by("from_price", F.when(run, F.col("day"))).alias("_start_price"),
        F.max_by("median_price", F.when(run, F.col("day"))).alias("_end_price"),
        F.min(F.when(run, F.col("from_day"))).alias("start_day"),
        F.max(F.when(run, F.col("day"))).alias("end_day"),
        F.sort_array(F.collect_list(F.struct("day", "median_price", "n"))).alias("daily"),
    )
    moving = (F.col("n_days") >= params.min_days) & (F.col("_steps") > 0)
    change = F.col("_end_price") - F.col("_start_price")
    zero = F.lit(0.0)
    return agg.select(
        "category",
        F.when(F.col("n_days") < params.min_days, TREND_INSUFFICIENT)
        .when(moving, F.col("_now")).otherwise(TREND_STABLE).alias("trend"),
        F.when(moving, F.col("_steps")).otherwise(0).cast("bigint").alias("strength"),
        F.when(moving, percent_change(F.col("_start_price"), F.col("_end_price"))).otherwise(zero)
        .alias("change_percent"),
        F.when(moving, change).otherwise(zero).alias("change"),
        F.when(moving, F.col("start_day")).alias("start_day"),
        F.when(moving, F.col("end_day")).alias("end_day"),
        "n_days",
        "daily",
        F.lit(params.window_days).alias("window_days"),
    )


def trend_counts(trends: DataFrame) -> DataFrame:
    return trends.groupBy("trend").agg(F.count("*").alias("n_categories"))


def kind_counts(observations: DataFrame) -> DataFrame:
    return observations.groupBy("kind").agg(F.count("*").alias("n"))


_STATUS = {TREND_UP: "UPP", TREND_DOWN: "NED", TREND_STABLE: "STABIL"}


def trend_report(trends: DataFrame, variant_length: int = REPORT_VARIANT_LENGTH) -> DataFrame:
    """One text line per category; a variant shows its first ``variant_length`` characters."""
    parts = F.split("category", r"\|")
    variant = F.trim(parts[1])
    short = F.when(
        F.length(variant) > variant_length, F.concat(F.substring(variant, 1, variant_length - 3), F.lit("..."))
    ).otherwise(variant)
    name = F.when(
        F.size(parts) == 3, F.concat_ws(" | ", F.trim(parts[0]), short, parts[2])
    ).otherwise(F.col("category"))
    status = F.lit("OTILLRACKLIGT_UNDERLAG")
    for trend, text in _STATUS.items():
        status = F.when(F.col("trend") == trend, text).otherwise(status)
    change = F.translate(F.format_number(F.rint("change"), 0), ",", " ")
    percent = F.concat(
        F.when(F.col("change_percent") >= 0, "+").otherwise(""), F.format_string("%.2f", F.bround("change_percent", 2))
    )
    line = F.concat(
        name, F.lit(" | "), status, F.lit(" | dagar="), F.col("n_days").cast("string"), F.lit(" | steg="),
        F.col("strength").cast("string"), F.lit(" | förändring="), change, F.lit(" kr ("), percent, F.lit(" %)"),
    )
    return trends.select("category", line.alias("line"))


def with_trend(listings: DataFrame, trends: DataFrame, params: TrendParams | None = None) -> DataFrame:
    """Trend of each listing's category, with defaults where none is known."""
    params = params or TrendParams()
    cols = ["trend", "strength", "change_percent", "change", "start_day", "end_day", "n_days", "window_days"]
    t = trends.select(F.col("category").alias("_cat"), *[F.col(c).alias(f"market_{c}") for c in cols])
    df = listings.withColumn("_key", trend_category()).join(t, F.col("_key") == F.col("_cat"), "left")
    defaults = {
        "trend": TREND_INSUFFICIENT, "strength": 0, "change_percent": 0.0, "change": 0.0, "n_days": 0,
        "window_days": params.window_days,
    }
    return df.withColumns(
        {f"market_{c}": F.coalesce(F.col(f"market_{c}"), F.lit(v)) for c, v in defaults.items()}
    ).drop("_key", "_cat")
