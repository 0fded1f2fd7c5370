"""Queries over observation history, trends and listing state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.operators import history, state, trend
from pricelode.sources import state_store
from pricelode.sources.tables import event_observations, listings, part_observations
from pricelode.plans.valuation_queries import as_of

CUT = "2000-01-01"


def _ts(text: str):
    return F.lit(text).cast("timestamp")


def _day(name: str):
    return F.date_format(name, "yyyy-MM-dd").alias(name)


def category_observations(spark: SparkSession, root: str) -> DataFrame:
    """Listings dated by their sale as observations of (model, variant, year)."""
    from pricelode.sources.tables import read_table

    lines = read_table(spark, root, "lineitem").select("l_partkey", "l_shipdate", "l_extendedprice")
    part = read_table(spark, root, "part").select("p_partkey", "p_type", "p_brand")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.lit("annons").alias("kind"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.upper("p_type").alias("model"),
        F.col("p_brand").alias("variant"),
        F.year("l_shipdate").alias("model_year"),
        (F.floor(F.col("l_extendedprice") / 1000) * 4000 + 100000).cast("double").alias("price"),
    )


def mixed_observations(spark: SparkSession, root: str) -> DataFrame:
    """Listing and valuation records of every part."""
    obs = part_observations(spark, root)
    is_value = F.col("seq.k2") % 3 == 0
    return obs.withColumn("kind", F.when(is_value, "marknadsvarde").otherwise("annons")).withColumn(
        "market_value", F.when(is_value, F.col("price"))
    ).withColumn("price", F.when(~is_value, F.col("price")))


def _index(spark, root):
    return history.history_index(part_observations(spark, root), _ts(CUT)).groupBy("listing_key").agg(
        F.count("*").alias("n")
    )


def _metrics(spark, root):
    return history.history_metrics(mixed_observations(spark, root), _ts(CUT))


def _enrich(spark, root):
    metrics = history.history_metrics(mixed_observations(spark, root), _ts(CUT))
    rows = listings(spark, root).withColumn("listing_key", F.col("seq.k3").cast("string"))
    return history.with_history(rows, metrics).select(
        "listing_id", "hist_n_observations", "hist_days_observed", "hist_first_price", "hist_last_price",
        "hist_price_change", "hist_price_fall", "hist_last_market_value", "hist_market_value_change",
        "hist_n_valuations",
    )


def _obs_key(spark, root):
    df = listings(spark, root, identifiers=True)
    none = F.lit(None).cast("string")
    df = df.withColumn("kept", F.col("listing_id")).withColumns(
        {
            "listing_id": F.when(F.col("owners") % 3 == 1, F.col("listing_id")),
            "url": F.when(F.col("owners") % 3 == 2, F.col("url")).otherwise(none),
            "price": F.col("price").cast("bigint"),
        }
    )
    return df.select(F.col("kept").alias("listing_id"), history.observation_key().alias("listing_key"))


def _parse_time(spark, root):
    """Event times written as ISO texts in several notations, some of them broken."""
    from pricelode.sources.tables import read_table

    ev = read_table(spark, root, "events").select("event_id", F.col("ts").cast("timestamp_ntz").alias("ts"))
    base = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    kind = F.col("event_id") % 4
    text = (
        F.when(kind == 0, F.concat(base, F.lit("+02:00"))).when(kind == 1, F.concat(base, F.lit("Z")))
        .when(kind == 2, base).otherwise(F.concat(F.lit("x"), base))
    )
    parsed = history.parse_time(text)
    return ev.select("event_id", F.unix_timestamp(parsed).alias("epoch"))


def _trend_key(spark, root):
    return category_observations(spark, root).groupBy(trend.trend_category().alias("category")).agg(
        F.count("*").alias("n")
    )


def _daily(spark, root):
    return trend.daily_prices(event_observations(spark, root)).select(
        "category", _day("day"), F.round("median_price", 6).alias("median_price"), "n"
    )


def _daily_category(spark, root):
    return trend.daily_prices(category_observations(spark, root)).select("category", _day("day"), "median_price", "n")


def _clip(spark, root):
    daily = trend.daily_prices(event_observations(spark, root))
    return trend.clip_window(daily).select("category", _day("day"), F.round("median_price", 6).alias("median_price"), "n")


def _steps(spark, root):
    daily = trend.daily_prices(event_observations(spark, root))
    return trend.steps(daily).filter("from_day is not null").select(
        "category", _day("from_day"), _day("day"), F.round("step_percent", 6).alias("step_percent"), "direction"
    )


def _flat(df: DataFrame) -> DataFrame:
    return df.select(
        "category", "trend", "strength", F.round("change_percent", 6).alias("change_percent"),
        F.round("change", 6).alias("change"), _day("start_day"), _day("end_day"), "n_days",
    )


def _run_segment(spark, root):
    return _flat(trend.trend_table(event_observations(spark, root)))


def _trend_table(spark, root):
    df = trend.trend_table(category_observations(spark, root))
    series = F.transform(
        "daily", lambda d: F.concat_ws(":", F.date_format(d.day, "yyyy-MM-dd"), F.rint(d.median_price * 2).cast("bigint"), d.n)
    )
    return df.select(
        "category", "trend", "strength", F.round("change_percent", 6).alias("change_percent"),
        F.round("change", 6).alias("change"), _day("start_day"), _day("end_day"), "n_days",
        F.array_join(series, " ").alias("series"), "window_days",
    )


def _trend_counts(spark, root):
    return trend.trend_counts(trend.trend_table(category_observations(spark, root)))


def _trend_report(spark, root):
    return trend.trend_report(trend.trend_table(category_observations(spark, root)))


def _kinds(spark, root):
    return trend.kind_counts(mixed_observations(spark, root))


def _listing_trend(spark, root):
    # Some listings are moved to years without observations, so defaults occur.
    known = trend.trend_table(category_observations(spark, root))
    moved = F.when(F.col("variant") < "Brand#2", F.col("model_year")).otherwise(F.col("model_year") + 50)
    return trend.with_trend(listings(spark, root).withColumn("model_year", moved), known).select(
        "listing_id", "market_trend", "market_strength", F.round("market_change_percent", 6).alias("change_percent"),
        F.round("market_change", 6).alias("change"), _day("market_start_day"), _day("market_end_day"),
        "market_n_days", "market_window_days",
    )


# --- state --------------------------------------------------------------------


def part_listings(spark: SparkSession, root: str) -> DataFrame:
    """Sales lines as listings of their part: a part is one listing seen again and again."""
    df = listings(spark, root).select(
        "seq", "model", "variant", "model_year", "mileage", "price",
        F.col("seq.k3").cast("string").alias("listing_id"),
    ).withColumns({"reg_no": F.lit(None).cast("string"), "url": F.lit(None).cast("string")})
    no_id = F.col("seq.k2") == 5
    return df.withColumn("part", F.col("listing_id")).withColumn("listing_id", F.when(~no_id, F.col("listing_id")))


def stored_state(spark: SparkSession, root: str) -> DataFrame:
    """State as earlier runs left it: rows by id, and legacy rows by value."""
    old = part_listings(spark, root).filter(F.col("model_year") < 2000)
    keyed = old.withColumn("state_key", state.state_key(old))
    by_id = keyed.groupBy("state_key").agg(
        F.min(F.struct("seq", "price")).alias("a"), F.max(F.struct("seq", "price")).alias("b")
    )
    n = F.col("a.seq.k1") % 4
    return by_id.select(
        "state_key",
        F.to_date(F.lit("2001-01-01")).alias("first_seen"),
        F.col("a.price").alias("first_price"),
        F.col("b.price").alias("last_price"),
        F.to_date(F.lit("2001-02-01")).alias("last_seen"),
        (n < 2).alias("notified"),
        F.when(n == 0, F.col("b.price")).alias("notified_price"),
        F.lit(None).cast("string").alias("migrated_from"),
    )


def current_run(spark: SparkSession, root: str) -> DataFrame:
    # Values move by whole model years, so that value keys of old rows are met again.
    run = part_listings(spark, root).filter(F.col("model_year") >= 2000)
    return run.withColumn("model_year", (F.col("model_year") - 3).cast("int"))


def _state_key(spark, root):
    df = part_listings(spark, root)
    return df.select("seq.k1", "seq.k2", "seq.k3", "seq.k4", "seq.k5", state.state_key(df).alias("state_key"))


def _resolved(spark, root):
    return state.resolve_keys(current_run(spark, root), stored_state(spark, root)).select("state_key", "record_key")


def _upsert(spark, root):
    _, nxt = state.update_state(current_run(spark, root), stored_state(spark, root), as_of())
    return nxt.select(
        "state_key", _day("first_seen"), "first_price", "last_price", _day("last_seen"), "notified",
        "notified_price", "migrated_from",
    )


def _enriched(spark, root):
    rows, _ = state.update_state(current_run(spark, root), stored_state(spark, root), as_of())
    return rows.select(
        "seq.k1", "seq.k2", "seq.k3", "seq.k4", "seq.k5", "days_listed", "price_drop", "drop_relevant"
    )


def _alerted(spark, root):
    run = current_run(spark, root)
    rows, nxt = state.update_state(run, stored_state(spark, root), as_of())
    memory = nxt.select("state_key", "notified", "notified_price")
    return rows.join(memory, "state_key").select(
        "seq.k1", "seq.k2", "seq.k3", "seq.k4", "seq.k5", state.already_alerted().alias("suppressed")
    )


def _decisions(spark, root):
    rows, nxt = state.update_state(current_run(spark, root), stored_state(spark, root), as_of())
    out = state.alert_decisions(rows, nxt)
    return out.select("seq.k1", "seq.k2", "seq.k3", "seq.k4", "seq.k5", "alert")


def _marked(spark, root):
    rows, nxt = state.update_state(current_run(spark, root), stored_state(spark, root), as_of())
    sent = state.alert_decisions(rows, nxt).filter("alert")
    return state.mark_alerted(nxt, sent).select("state_key", "notified", "notified_price")


def _migrate(spark, root):
    return state_store.migrate(stored_state(spark, root)).select("state_key", "notified", "notified_price")


def _snapshot(spark, root):
    store = state_store.StateStore.temporary(spark)
    store.write(stored_state(spark, root).filter("notified"))
    store.write(stored_state(spark, root))
    return store.load().select(
        "state_key", _day("first_seen"), "first_price", "last_price", _day("last_seen"), "notified", "notified_price"
    )


QUERIES = {
    "history_index": _index,
    "history_metrics": _metrics,
    "history_enrichment": _enrich,
    "observation_key": _obs_key,
    "time_parser": _parse_time,
    "trend_key": _trend_key,
    "daily_median_events": _daily,
    "daily_median_categories": _daily_category,
    "trend_window": _clip,
    "trend_steps": _steps,
    "trend_current_run": _run_segment,
    "trend_table": _trend_table,
    "trend_counts": _trend_counts,
    "trend_report": _trend_report,
    "observation_kinds": _kinds,
    "listing_trend": _listing_trend,
    "state_key": _state_key,
    "state_key_migration": _resolved,
    "state_upsert": _upsert,
    "state_enrichment": _enriched,
    "already_alerted": _alerted,
    "alert_decisions": _decisions,
    "mark_alerted": _marked,
    "state_load_migration": _migrate,
    "state_snapshot": _snapshot,
}
