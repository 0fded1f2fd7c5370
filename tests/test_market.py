"""Comparables against brute force, with copies and missing identities."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pricelode.config import MarketParams
from pricelode.operators import market
from pricelode.schema import LISTING, conform

SCHEMA = T.StructType([*LISTING.fields, T.StructField("seq", T.LongType())])


def rows_of(seed, n, ids, no_id, spread):
    rng = random.Random(seed)
    return [
        dict(seq=i, model=rng.choice(["V60", "v60"]), variant="T6", model_year=rng.choice([2023, None]),
             mileage=rng.choice([None] + [rng.randrange(500, spread)] * 9), price=rng.choice([99999.0, 3e5, 3.1e5, 2.9e5]),
             listing_id=None if rng.random() < no_id else f"i{rng.randrange(ids)}",
             trim=rng.choice(["Ultimate Dark", "core", None]), tow_hook=rng.choice([True, None]), heater=None,
             certified=None, big_battery=None)
        for i in range(n)
    ]


def equipment(r):
    total = {"Ultimate Dark": 15000, "core": -15000, None: 0}[r["trim"]] + (8000 if r["tow_hook"] else 0)
    return max(-40000, min(40000, total))


def same(t, b):
    if t["listing_id"] and b["listing_id"] and t["listing_id"] == b["listing_id"]:
        return True
    return (not t["listing_id"] or not b["listing_id"]) and (t["price"], t["mileage"]) == (b["price"], b["mileage"])


def brute(rows, t):
    basis = [b for b in rows if b["price"] >= 1e5 and b["mileage"] is not None and b["mileage"] >= 1000]
    if t["mileage"] is None:
        return []
    near = [b for b in basis if b["model_year"] == t["model_year"] and not same(t, b)]
    gap = lambda b: abs(b["mileage"] - t["mileage"])
    tight = sorted((b for b in near if gap(b) <= 1500), key=gap)
    return (tight if len(tight) >= 3 else sorted((b for b in near if gap(b) <= 3000), key=gap))[:15]


@pytest.mark.parametrize("seed,n,ids,no_id,spread", [
    (1, 120, 1000, 0.0, 30000), (2, 200, 6, 0.0, 4000), (3, 200, 4, 0.3, 2500), (4, 60, 1000, 0.5, 20000),
])
def test_comparables(spark, seed, n, ids, no_id, spread):
    rows = rows_of(seed, n, ids, no_id, spread)
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    out = market.value_listings(df.repartition(3), F.lit("2026-06-01").cast("date"), MarketParams(base_prices=()
        or (("v60", "T6", 2023, 300000),)))
    got = {r.seq: r for r in out.select(
        "seq", F.transform("comps", lambda x: x.seq).alias("c"), "market_price", "market_value").collect()}
    assert len(got) == n
    for t in rows:
        want = brute(rows, t)
        assert got[t["seq"]].c == [b["seq"] for b in want], t
        if len(want) >= 3:
            adjusted = [b["price"] + (b["mileage"] - t["mileage"]) * 12.0
                        + max(-40000, min(40000, equipment(t) - equipment(b))) for b in want]
            assert got[t["seq"]].market_price == round(median(adjusted) / 1000) * 1000


def test_level_edges(spark):
    cases = [(20000, 400000, 3, "FYND"), (19999, 300000, 9, None), (20000, 400001, 9, None), (35000, 437500, 5, "EXTREMT_FYND"),
             (35000, 437500, 4, "FYND"), (35000, 437501, 5, "FYND"), (60000, 300000, 2, None)]
    df = spark.createDataFrame([(float(v), float(v - d), n) for d, v, n, _ in cases],
                               "market_value double, price double, n_comparables int")
    got = [r.level for r in market.classify(df).collect()]
    assert got == [c[3] for c in cases]


def test_no_all_pairs_plan(spark):
    from pricelode.plans.valuation_queries import MARKET, valued
    from pricelode.sources.tables import listings

    rows = market.with_market_columns(listings(spark, "/root/testdata/sf0.001"), MARKET)
    basis = market._hashed(market.market_basis(rows, MARKET))
    near = market._nearest_by_point(rows.select("category", "mileage").distinct(), basis, MARKET, 24, market._CANDIDATE)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (near, valued(spark, "/root/testdata/sf0.001"))]
    assert "WindowGroupLimit" in plans[0]
    for plan in plans:
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
        assert "PythonUDF" not in plan and "ArrowEvalPython" not in plan


def test_rings_grow_past_copies(spark):
    """A thousand copies of one listing stand nearer than anything else: each still finds 15 others, and others find 15 of them."""
    base = dict(model="v60", variant="T6", model_year=2023, trim=None, tow_hook=None)
    rows = [dict(base, seq=i, mileage=5000 + i % 7, price=3e5, listing_id="hot") for i in range(1000)]
    rows += [dict(base, seq=1000 + i, mileage=6000 + 10 * i, price=3e5 + i, listing_id=f"i{i}") for i in range(30)]
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    out = market.value_listings(df.repartition(3), F.lit("2026-06-01").cast("date"), MarketParams())
    got = {r.seq: r.c for r in out.select("seq", F.transform("comps", lambda x: x.seq).alias("c")).collect()}
    for t in (rows[0], rows[999], rows[1000], rows[1029]):
        assert got[t["seq"]] == [b["seq"] for b in brute(rows, t)]


@pytest.fixture
def rounds(monkeypatch):
    """Lengths of the lists asked for, round by round."""
    asked, plain = [], market._nearest_by_point

    def counted(points, basis, params, keep, fields):
        asked.append(keep)
        return plain(points, basis, params, keep, fields)

    monkeypatch.setattr(market, "_nearest_by_point", counted)
    return asked


def valued_rows(spark, rows):
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    out = market.value_listings(df.repartition(3), F.lit("2026-06-01").cast("date"), MarketParams())
    return {r.seq: r.c for r in out.select("seq", F.transform("comps", lambda x: x.seq).alias("c")).collect()}


def test_equal_values_of_other_listings_need_no_second_round(spark, rounds):
    """Many listings of equal price and mileage, all with identities, are no copies of each other."""
    base = dict(model="v60", variant="T6", model_year=2023, trim=None, tow_hook=None)
    rows = [dict(base, seq=i, mileage=5000, price=3e5, listing_id=f"i{i}") for i in range(100)]
    rows += [dict(base, seq=100 + i, mileage=5010 + 10 * i, price=3e5 + i, listing_id=f"j{i}") for i in range(30)]
    got = valued_rows(spark, rows)
    assert rounds == [24]
    for t in rows:
        assert got[t["seq"]] == [b["seq"] for b in brute(rows, t)]


def test_equal_values_without_identity_need_one_more_round(spark, rounds):
    """Five hundred listings without identity and of one price: targets leave all of them out, or those of another price few."""
    base = dict(model="v60", variant="T6", model_year=2023, trim=None, tow_hook=None)
    rows = [dict(base, seq=i, mileage=5000, price=3e5 if i % 50 else 3e5 + i % 3, listing_id=None if i % 7 else f"h{i}") for i in range(500)]
    rows += [dict(base, seq=500 + i, mileage=5010 + 10 * i, price=3e5 + i, listing_id=None if i % 2 else f"j{i}") for i in range(30)]
    got = valued_rows(spark, rows)
    assert rounds == [24, 72]
    for t in rows:
        assert got[t["seq"]] == [b["seq"] for b in brute(rows, t)]


@pytest.mark.parametrize("seed,ids,no_id,prices", [(5, 40, 0.2, 2), (6, 12, 0.5, 3), (7, 1000, 0.6, 1), (8, 90, 0.0, 4)])
def test_many_copies_at_few_mileages(spark, seed, ids, no_id, prices):
    rng = random.Random(seed)
    rows = [
        dict(seq=i, model="v60", variant="T6", model_year=2023, trim=None, tow_hook=None, mileage=rng.choice([3000, 3010, 4400, 5900]),
             price=3e5 + rng.randrange(prices), listing_id=None if rng.random() < no_id else f"i{rng.randrange(ids)}")
        for i in range(400)
    ]
    got = valued_rows(spark, rows)
    for t in rows:
        assert got[t["seq"]] == [b["seq"] for b in brute(rows, t)], t
