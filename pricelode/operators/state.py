"""Per-listing state across runs and the suppression of repeat alerts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.config import StateParams
from pricelode.functions.text import blank_to_null, strip


def _as_text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("None"))


def legacy_key() -> Column:
    """Key by value: used where a listing has no identifier, and by old state rows."""
    model = F.lower(F.coalesce(blank_to_null(F.col("model")), F.lit("v60")))
    return F.concat_ws(
        ":", F.lit("kal"), model, _as_text("variant"), _as_text("model_year"), _as_text("mileage")
    )


def state_key(df: DataFrame) -> Column:
    reg = F.replace(F.upper(blank_to_null(F.col("reg_no"))), F.lit(" "), F.lit(""))
    cut = lambda u: F.rtrim(strip(u), F.lit("/"))
    choices = [
        F.concat(F.lit("reg:"), reg),
        F.concat(F.lit("annons:"), strip(blank_to_null(F.col("listing_id")))),
        F.concat(F.lit("url:"), cut(blank_to_null(F.col("url")))),
    ]
    if "urls" in df.columns:
        usable = F.filter(F.col("urls"), lambda u: F.length(u) > 0)
        choices.append(F.concat(F.lit("url:"), cut(F.get(usable, F.lit(0)))))
    return F.coalesce(*choices, legacy_key())


def with_keys(run: DataFrame) -> DataFrame:
    if "state_key" not in run.columns:
        run = run.withColumn("state_key", state_key(run))
    return run if "legacy_key" in run.columns else run.withColumn("legacy_key", legacy_key())


def resolve_keys(run: DataFrame, state: DataFrame) -> DataFrame:
    """One row per key of the run with the state record it shares.

    A new key whose legacy key is known (stored, or created earlier in this
    run) shares that record; what the run changes then shows under both keys.
    """
    keys = (
        with_keys(run)
        .groupBy("state_key")
        .agg(
            F.min(F.struct("seq", "legacy_key", "price")).alias("first"),
            F.max(F.struct("seq", "price")).alias("last"),
        )
        .withColumn("old_key", F.col("first.legacy_key"))
    )
    stored = state.select(F.col("state_key").alias("k"))
    creators = keys.filter(F.col("state_key") == F.col("old_key")).select(
        F.col("state_key").alias("c"), F.col("first.seq").alias("c_seq")
    )
    keys = (
        keys.join(stored.withColumnRenamed("k", "k1"), F.col("state_key") == F.col("k1"), "left")
        .join(stored.withColumnRenamed("k", "k2"), F.col("old_key") == F.col("k2"), "left")
        .join(creators, F.col("old_key") == F.col("c"), "left")
    )
    shared = F.col("k2").isNotNull() | F.coalesce(F.col("c_seq") < F.col("first.seq"), F.lit(False))
    record = F.when(F.col("k1").isNotNull(), F.col("state_key")).when(
        (F.col("state_key") != F.col("old_key")) & shared, F.col("old_key")
    ).otherwise(F.col("state_key"))
    return keys.select("state_key", "first", "last", record.alias("record_key"))


def changed_state(
    run: DataFrame, state: DataFrame, as_of: Column, params: StateParams | None = None
) -> tuple[DataFrame, DataFrame]:
    """(run rows with days listed and price drop, the state rows that the run makes or changes).

    ``state`` needs the rows of the run's keys and legacy keys only.  Everything
    is per-key aggregates and joins: no key's rows are gathered.
    """
    params = params or StateParams()
    run = with_keys(run)
    keys = resolve_keys(run, state)
    known = state.select(
        F.col("state_key").alias("record_key"), "first_seen", "first_price", "notified", "notified_price",
        "migrated_from", F.lit(True).alias("known"),
    )
    made_here = F.col("state_key") == F.col("record_key")
    records = (
        keys.groupBy("record_key")
        .agg(
            F.max("last").alias("last"),
            F.max(F.when(made_here, F.struct("first.seq", "first.price"))).alias("origin"),
            F.max(F.when(~made_here, F.col("record_key"))).alias("shared_from"),
        )
        .join(known, "record_key", "left")
        .select(
            "record_key",
            F.coalesce("known", F.lit(False)).alias("known"),
            F.when(F.col("known"), F.col("first_seen")).otherwise(as_of).alias("first_seen"),
            F.when(F.col("known"), F.col("first_price")).otherwise(F.col("origin.price")).alias("first_price"),
            F.when(F.col("known").isNull(), F.col("origin.seq")).alias("origin_seq"),
            F.col("last.price").alias("last_price"),
            as_of.alias("last_seen"),
            F.coalesce("notified", F.lit(False)).alias("notified"),
            "notified_price",
            F.coalesce("shared_from", "migrated_from").alias("migrated_from"),
        )
    )
    by_key = keys.select("state_key", "record_key").join(records, "record_key")

    rows = run.join(
        by_key.select("state_key", "record_key", "first_seen", "first_price", "origin_seq"), "state_key"
    )
    is_origin = F.coalesce(F.col("seq") == F.col("origin_seq"), F.lit(False))
    days = F.when(is_origin, 0).otherwise(F.datediff(as_of, F.col("first_seen")))
    drop = F.when(is_origin, F.lit(0.0)).otherwise(F.col("first_price") - F.col("price"))
    rows = rows.withColumn("days_listed", days).withColumn("price_drop", drop)
    relevant = (F.col("price_drop") >= params.relevant_drop) & (F.col("days_listed") >= params.relevant_days)
    rows = rows.withColumn("drop_relevant", F.coalesce(~is_origin & relevant, F.lit(False)))
    rows = rows.drop("first_seen", "first_price", "origin_seq", "legacy_key")

    cols = ["first_seen", "first_price", "last_price", "last_seen", "notified", "notified_price", "migrated_from"]
    changed = by_key.select("state_key", "record_key", *cols).unionByName(
        records.join(keys.select("state_key"), F.col("record_key") == F.col("state_key"), "left_anti")
        .select(F.col("record_key").alias("state_key"), "record_key", *cols)
    )
    return rows, changed


def update_state(
    run: DataFrame, state: DataFrame, as_of: Column, params: StateParams | None = None
) -> tuple[DataFrame, DataFrame]:
    """(run rows with days listed and price drop, next state)."""
    rows, changed = changed_state(run, state, as_of, params)
    kept = state.join(changed.select("state_key"), "state_key", "left_anti").withColumn("record_key", F.col("state_key"))
    return rows, changed.unionByName(kept.select(*changed.columns))


def already_alerted(params: StateParams | None = None) -> Column:
    """Suppressed: alerted before and not cheaper by the required drop since."""
    params = params or StateParams()
    unknown = F.col("notified_price").isNull() | F.col("price").isNull()
    dear = F.col("price") > F.col("notified_price") - params.realert_drop
    return F.coalesce(F.col("notified"), F.lit(False)) & (unknown | F.coalesce(dear, F.lit(False)))


def alert_decisions(candidates: DataFrame, state: DataFrame, params: StateParams | None = None) -> DataFrame:
    """Add ``alert``: whether each candidate is sent, in input order per record.

    A candidate sees the alerts sent before it in the same run.  A price that
    was not sent at its first appearance is never sent later (the bar only
    falls), so one row per (record, price) is enough: repeats of a key collapse
    before they meet, and the ordered fold runs over distinct prices only.
    """
    params = params or StateParams()
    offers = candidates.groupBy("record_key", "price").agg(F.min("seq").alias("seq"))
    memory = state.select("record_key", "notified", "notified_price").groupBy("record_key").agg(
        F.max("notified").alias("notified"), F.max("notified_price").alias("notified_price")
    )
    # Of a record's offers only the first and new lows can be sent.
    earlier = Window.partitionBy("record_key").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    lowest, rank = F.min("price").over(earlier), F.count(F.lit(1)).over(earlier)
    offers = offers.withColumns({"lowest": lowest, "rank": rank}).filter(
        (F.col("rank") == 0) | F.col("lowest").isNull() | (F.col("price") < F.col("lowest"))
    )
    per_record = (
        offers.groupBy("record_key")
        .agg(F.sort_array(F.collect_list(F.struct("seq", "price"))).alias("offers"))
        .join(memory, "record_key", "left")
    )
    start = F.struct(
        F.coalesce("notified", F.lit(False)).alias("on"),
        F.col("notified_price").cast("double").alias("bar"),
        F.slice(F.transform("offers", lambda o: o.seq), 1, 0).alias("sent"),
    )

    def step(acc: Column, offer: Column) -> Column:
        cheap = F.coalesce(offer.price <= acc.bar - params.realert_drop, F.lit(False))
        send = ~acc.on | cheap
        return F.struct(
            (acc.on | send).alias("on"),
            F.when(send, offer.price.cast("double")).otherwise(acc.bar).alias("bar"),
            F.when(send, F.concat(acc.sent, F.array(offer.seq))).otherwise(acc.sent).alias("sent"),
        )

    sent = per_record.select(
        "record_key", F.explode(F.aggregate("offers", start, step).sent).alias("seq")
    ).withColumn("alert", F.lit(True))
    return candidates.join(sent, ["record_key", "seq"], "left").withColumn(
        "alert", F.coalesce("alert", F.lit(False))
    )


def mark_alerted(state: DataFrame, sent: DataFrame) -> DataFrame:
    """State after the alerts in ``sent`` (record_key, seq, price) went out."""
    last = sent.groupBy("record_key").agg(F.max(F.struct("seq", "price")).alias("last_sent"))
    joined = state.join(last, "record_key", "left")
    return joined.withColumn(
        "notified", F.col("notified") | F.col("last_sent").isNotNull()
    ).withColumn(
        "notified_price",
        F.when(F.col("last_sent").isNotNull(), F.col("last_sent.price")).otherwise(F.col("notified_price")),
    ).drop("last_sent")
