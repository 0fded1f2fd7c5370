"""Re-runs, snapshots, alerts of hot keys and the page patterns."""

from pyspark.sql import functions as F

from pricelode.functions import numbers, text
from pricelode.operators import extract, state
from pricelode.session import scratch_path
from pricelode.sources.state_store import StateStore
from pricelode.streaming.intake import ListingIntake

ROW = ("listing_id string, reg_no string, url string, model string, variant string, model_year int, mileage bigint, "
       "price double, seq bigint")


def run_of(spark, prices, key="a"):
    return spark.createDataFrame([(key, None, None, "v60", "T6", 2023, 5000, p, i) for i, p in enumerate(prices)], ROW)


def day(text_):
    return F.lit(text_).cast("date")


def test_alerts_within_one_run(spark):
    prices = [300000.0, 290000.0, 285000.0, 284000.0, 270001.0, 270000.0, 300000.0, 255000.0]
    rows, nxt = state.update_state(run_of(spark, prices), StateStore.temporary(spark).load(), day("2026-01-01"))
    out = [r.alert for r in state.alert_decisions(rows, nxt).orderBy("seq").collect()]
    assert out == [True, False, True, False, False, True, False, True]
    marked = state.mark_alerted(nxt, state.alert_decisions(rows, nxt).filter("alert")).collect()
    assert [(r.notified, r.notified_price, r.last_price) for r in marked] == [(True, 255000.0, 255000.0)]


def test_drop_becomes_relevant_after_14_days(spark):
    store = StateStore.temporary(spark)
    _, nxt = state.update_state(run_of(spark, [300000.0]), store.load(), day("2026-01-01"))
    store.write(nxt)
    for when, price, relevant in (("2026-01-14", 285000.0, False), ("2026-01-15", 285000.0, True), ("2026-01-15", 285001.0, False)):
        rows, _ = state.update_state(run_of(spark, [price]), store.load(), day(when))
        assert rows.first().drop_relevant is relevant


def test_rerun_of_a_batch_changes_nothing(spark):
    intake = ListingIntake(spark, scratch_path(spark, "s"), scratch_path(spark, "a"), day("2026-01-01"))
    batch = run_of(spark, [300000.0, 280000.0])
    intake.process(batch, 0)
    once = (StateStore(spark, intake.state_root).load().collect(), intake.alerts().count())
    intake.process(batch, 0)
    assert (StateStore(spark, intake.state_root).load().collect(), intake.alerts().count()) == once
    intake.process(run_of(spark, [279999.0, 265000.0]), 1)
    assert intake.alerts().count() == once[1] + 1


def test_stream_equals_batches(spark):
    landing = scratch_path(spark, "land")
    batch = run_of(spark, [300000.0, 299000.0, 284000.0])
    batch.coalesce(1).write.parquet(landing)
    intake = ListingIntake(spark, scratch_path(spark, "s"), scratch_path(spark, "a"), day("2026-01-01"))
    intake.start(landing, batch.schema, scratch_path(spark, "c")).awaitTermination()
    saved = StateStore(spark, intake.state_root).load().first()
    assert (saved.first_price, saved.last_price, saved.notified_price) == (300000.0, 284000.0, 284000.0)


def test_rounding_and_numbers(spark):
    df = spark.createDataFrame([("1 234,5",), ("kr -7",), ("x",), ("2.5",), ("3.5",)], "t string")
    got = df.select(numbers.to_number(F.col("t")), numbers.to_int(F.col("t"))).collect()
    assert [tuple(r) for r in got] == [(1234.5, 1234), (-7.0, -7), (None, None), (2.5, 2), (3.5, 4)]


def test_norm_text(spark):
    df = spark.createDataFrame([(" Škoda  Kombi & Co/é_Áx ",), (None,)], "t string")
    assert [r[0] for r in df.select(text.norm_text(F.col("t"))).collect()] == ["skoda kombi och co e ax", ""]


def test_regno_cascade(spark):
    pages = {
        "<p>Reg.nr: ABC 12D</p>": "ABC12D",
        "<dl><dt>Registreringsnummer</dt><dd>xyz-123</dd></dl>": "XYZ123",
        '<i data-registration-number="q"></i><div regnr="åäö123">x</div>': "ÅÄÖ123",
        '<script type="application/json">{"x":[{"regnr":"no"},{"registration_no":"DEF456"}]}</script>': "DEF456",
        "<p>Pris ABC123</p>": None,
        "<p>Regnr saknas</p>": None,
        "<p>Regnr XABC1234</p>": None,
    }
    df = spark.createDataFrame([(k,) for k in pages], "html string")
    flat = F.replace(extract.page_lines(F.col("html")), F.lit("\n"), F.lit(" "))
    got = {r.html: r.r for r in df.select("html", extract.regno(F.col("html"), flat).alias("r")).collect()}
    assert got == pages


def test_price_with_no_break_space(spark):
    html = "<p>Pris</p><p>349 900 kr</p><dl><dt>Mil</dt><dd>4 200</dd></dl>"
    row = extract.detail_facts(spark.createDataFrame([(1, html)], "page_id int, html string")).first()
    assert (row.price, row.mileage) == (349900, 4200)


def test_fresh_checkpoint_goes_on_from_the_state(spark):
    landing = scratch_path(spark, "land")
    batch = run_of(spark, [300000.0, 284000.0])
    batch.coalesce(1).write.parquet(landing)
    intake = ListingIntake(spark, scratch_path(spark, "s"), scratch_path(spark, "a"), day("2026-01-01"))
    intake.start(landing, batch.schema, scratch_path(spark, "c")).awaitTermination()
    sent = intake.alerts().count()
    again = ListingIntake(spark, intake.state_root, intake.alert_root, day("2026-01-02"))
    again.start(landing, batch.schema, scratch_path(spark, "c")).awaitTermination()
    assert again.origin >= 1 and again.alerts().count() == sent
    saved = StateStore(spark, intake.state_root).load().first()
    assert (saved.first_seen.isoformat(), saved.notified_price) == ("2026-01-01", 284000.0)


def keyed_run(spark, rows, checkpoint, landing, out, **options):
    from pricelode.streaming.alert_state import keyed_alerts

    schema = "state_key string, pos string, price double"
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
    keyed = keyed_alerts(spark.readStream.schema(schema).parquet(landing), **options)
    keyed.writeStream.outputMode("update").foreachBatch(lambda df, i: df.write.mode("overwrite").parquet(f"{out}/batch={i}")).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return {(r.batch, r.state_key): tuple(r)[1:6] for r in spark.read.parquet(out).select(
        "state_key", "n_seen", "first_price", "last_price", "n_alerts", "alert_price", "batch").collect()}


def test_keyed_alerts_go_on_from_a_snapshot(spark):
    """Known keys start with the batch state's prices and alert bar; others start empty; the next batch sees both."""
    snapshot = spark.createDataFrame(
        [("a", 300000.0, 290000.0, True, 280000.0), ("b", 200000.0, 200000.0, False, None)],
        "state_key string, first_price double, last_price double, notified boolean, notified_price double",
    )
    rows = [("a", "1", 270000.0), ("a", "2", 265000.0), ("a", "3", 299000.0), ("b", "1", 199000.0), ("c", "1", None), ("c", "2", 100000.0)]
    places = [scratch_path(spark, x) for x in ("c", "l", "o")]
    got = keyed_run(spark, rows, *places, snapshot=snapshot)
    assert got == {
        (0, "a"): (3, 300000.0, 299000.0, 2, 265000.0), (0, "b"): (1, 200000.0, 199000.0, 1, 199000.0), (0, "c"): (2, 100000.0, 100000.0, 1, 100000.0),
    }
    got = keyed_run(spark, [("a", "4", 250001.0), ("c", "3", 85000.0)], *places, snapshot=snapshot)
    assert got[1, "a"] == (4, 300000.0, 250001.0, 2, 265000.0) and got[1, "c"] == (3, 100000.0, 85000.0, 2, 85000.0)


def test_keyed_state_expires(spark):
    import time

    places = [scratch_path(spark, x) for x in ("c", "l", "o")]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        keyed_run(spark, [("a", "1", 300000.0)], *places, forget_after_ms=2000)
        time.sleep(4)
        got = keyed_run(spark, [("a", "2", 299000.0)], *places, forget_after_ms=2000)
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    assert got[1, "a"] == (1, 299000.0, 299000.0, 1, 299000.0)


def test_a_small_batch_rewrites_its_buckets_only(spark):
    intake = ListingIntake(spark, scratch_path(spark, "s"), scratch_path(spark, "a"), day("2026-01-01"))
    many = [(f"id{i}", None, None, "v60", "T6", 2023, 5000 + i, 300000.0, i) for i in range(300)]
    intake.process(spark.createDataFrame(many, ROW), 0)
    store = StateStore(spark, intake.state_root)
    before = store.manifest()
    intake.process(run_of(spark, [250000.0], "id7"), 1)
    after = store.manifest()
    assert len(before) > 50 and set(before) == set(after) and 1 <= sum(before[b] != after[b] for b in after) <= 2
    saved = {r.state_key: r for r in store.load().collect()}
    assert len(saved) == 300 and saved["annons:id7"].last_price == 250000.0 and saved["annons:id8"].last_price == 300000.0
    assert store.load(at_most=1).filter("last_price < 300000").count() == 0
