"""The complete run, twice: the second run repeats no alert."""

from dataclasses import replace

from pyspark.sql import functions as F

from pricelode.config import Params
from pricelode.plans.clean_queries import REQUIREMENTS
from pricelode.plans.listing_run import run
from pricelode.plans.valuation_queries import MARKET, SCORE, as_of
from pricelode.session import scratch_path
from pricelode.sources.state_store import StateStore
from pricelode.sources.tables import listings


def test_two_runs(spark):
    params = replace(Params(), requirements=REQUIREMENTS, market=MARKET, score=SCORE)
    store, log = StateStore.temporary(spark), scratch_path(spark, "log")
    df = listings(spark, "/root/testdata/sf0.001")
    first = run(df, store, log, as_of(), F.lit("2001-12-01 10:00:00").cast("timestamp"), params)
    a = first.statistics.first()
    assert a.total > 0 and a.sent == first.alerts.count() and a.already_alerted == 0
    second = run(df, store, log, as_of(), F.lit("2001-12-02 10:00:00").cast("timestamp"), params)
    b = second.statistics.first()
    assert (b.total, b.score_ok, b.already_alerted, b.sent) == (a.total, a.score_ok, a.sent, 0)
    assert second.listings.filter("hist_n_observations = 0").isEmpty()
    assert store.versions() == [1, 2]


def test_scratch_tables_can_be_dropped(spark, monkeypatch):
    from pricelode import session

    monkeypatch.setattr(session, "_made", [])
    table = session.materialize(spark.range(3).toDF("id"), "dropped")
    assert table.count() == 3
    path = session._made[0]
    assert session.drop_scratch(spark) == 1 and session.drop_scratch(spark) == 0
    assert not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(
        spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path))


def test_history_of_few_keys_reads_few_files(spark):
    from pricelode.sources import observation_log as log

    root, ts = scratch_path(spark, "log"), F.lit("2001-12-01 10:00:00").cast("timestamp")
    records = log.listing_records(listings(spark, "/root/testdata/sf0.001"), ts)
    for run_id in ("a", "b", "b"):  # the repeated run replaces its records
        log.append(records, root, run_id=run_id)
    whole = log.scan_log(spark, root)
    keys = records.select("listing_key").limit(2)
    few = log.scan_log(spark, root, keys)
    assert whole.count() == 2 * records.count() and len(few.inputFiles()) <= len(whole.inputFiles()) / 4
    mine = lambda df: sorted(map(str, df.join(keys.distinct(), "listing_key", "left_semi").collect()))
    assert mine(few) == mine(whole) != []
    assert log.scan_log(spark, root, keys.limit(0)).count() == 0


def test_from_pages_to_alerts(spark):
    from pricelode.plans import clean_queries as q
    from pricelode.plans.listing_run import PageSource, listings_of_pages, run_pages

    root = "/root/testdata/sf0.001"
    sources = [
        PageSource("w", q.V60, q.search_pages(spark, root), "https://w.example"),
        PageSource("b", q.BMW, q.slug_pages(spark, root), "https://b.example", q.detail_pages(spark, root, q._slug_href("https://b.example"))),
    ]
    params = replace(Params(), requirements=q.OLD_CARS, market=replace(MARKET, min_mileage=0, min_price=1), score=replace(SCORE, min_score=0, min_diff=0))
    found = listings_of_pages(sources, params.requirements)
    by_source = {r["source"]: r["count"] for r in found.groupBy("source").count().collect()}
    assert by_source == {"w": q.QUERIES["card_source"](spark, root).count(), "b": q.QUERIES["slug_listings"](spark, root).count()}
    store, log = StateStore.temporary(spark), scratch_path(spark, "log")
    out = run_pages(sources, store, log, as_of(), F.lit("2001-12-01 10:00:00").cast("timestamp"), params)
    total = out.statistics.first()
    assert 0 < total.total <= found.count() and total.sent == out.alerts.count()
    assert store.load().count() > 0
