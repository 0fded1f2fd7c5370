"""Queries over the market basis, comparables, valuation and scoring, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.config import MarketParams, ScoreParams
from pricelode.functions.numbers import age_in_years, half_even_digits
from pricelode.operators import funnel, market, score
from pricelode.sources.tables import listings

AS_OF = "2001-12-01"

# Words of the part names stand in for equipment levels.
TRIM_AMOUNTS = (("hot ring", 30000), ("hot", 25000), ("blue", 15000), ("large", 5000), ("old", -15000))
BASE_PRICES = (
    ("economy", "Brand#1", 1998, 300000), ("economy", "Brand#1", 2000, 320001),
    ("small", "Brand#2", 1999, 280000), ("promo", "Brand#3", 2001, 350000),
    ("standard", "Brand#4", 1997, 250000), ("medium", "Brand#5", 1996, 240000),
    ("large", "Brand#6", 1995, 230000), ("economy", "Brand#7", 1995, 230000),
)
MARKET = MarketParams(trim_amounts=TRIM_AMOUNTS, base_prices=BASE_PRICES, default_model="economy")
SCORE = ScoreParams(trim_points=(("hot", 5), ("blue", 4), ("large", 3), ("small", 2), ("old", 1)))


def as_of():
    return F.lit(AS_OF).cast("date")


def valued(spark: SparkSession, root: str, details: bool = False) -> DataFrame:
    return market.value_listings(listings(spark, root, written=True), as_of(), MARKET, details)


def _basis(spark, root):
    return market.market_basis(listings(spark, root), MARKET).select(
        "listing_id", F.translate("category", "\u0001\u0000", "|?").alias("category"), "price", "mileage",
        "ident", "url_key", "equipment",
    )


def _basis_counts(spark, root):
    return market.basis_counts(listings(spark, root), MARKET)


def _leasing(spark, root):
    df = listings(spark, root)
    return df.select("listing_id", market.leasing_flag(df).alias("leasing"))


def _cash(spark, root):
    df = listings(spark, root)
    p = MarketParams(min_price=150000, max_price=400000)
    return df.select("listing_id", market.plausible_price(F.col("price"), p).alias("plausible"))


def _min_mileage(spark, root):
    reason = F.when(F.col("mileage") < 1000, "mileage").otherwise("ok")
    return listings(spark, root).select("listing_id", reason.alias("reason"))


def _identity(spark, root):
    df = listings(spark, root)
    no_id = F.col("owners") == 2
    df = df.withColumn("listing_id", F.when(~no_id, F.col("listing_id"))).withColumn(
        "url", F.concat(F.lit(" "), F.col("url"), F.lit("/#top"))
    )
    return df.select("seq.k1", "seq.k2", "seq.k3", "seq.k4", "seq.k5", market.listing_identity(df).alias("ident"))


def _url(spark, root):
    df = listings(spark, root)
    hidden = F.col("owners") == 3
    df = df.withColumn("urls", F.array(F.lit(""), F.concat(F.col("url"), F.lit("//")))).withColumn(
        "url", F.when(~hidden, F.concat(F.col("url"), F.lit("#a#b")))
    )
    return df.select("listing_id", market.listing_url(df).alias("clean_url"))


def _trim_amount(spark, root):
    return listings(spark, root).select("listing_id", market.trim_amount(MARKET).alias("amount"))


def _option_amount(spark, root):
    return listings(spark, root).select("listing_id", market.option_amount(MARKET).alias("amount"))


def _equipment(spark, root):
    return listings(spark, root).select("listing_id", market.equipment_amount(MARKET).alias("amount"))


def _comparables(spark, root):
    df = listings(spark, root, written=True)
    out = market.comparables(market.with_market_columns(df, MARKET), market.market_basis(df, MARKET), MARKET)
    return out.select(
        "listing_id",
        F.size("comps").alias("n"),
        F.array_join(F.transform("comps", lambda x: x.ident), ",").alias("comp_ids"),
    )


def _self_exclusion(spark, root):
    """Listings without identifiers are told apart by their values alone."""
    df = listings(spark, root, written=True).withColumns(
        {"listing_id": F.when(F.col("seq.k2") != 1, F.col("listing_id")), "url": F.lit(None).cast("string")}
    )
    out = market.comparables(market.with_market_columns(df, MARKET), market.market_basis(df, MARKET), MARKET)
    return out.select(
        "seq.k1", "seq.k2", "seq.k3", "seq.k4", "seq.k5", F.size("comps").alias("n"),
        F.array_join(
            F.transform("comps", lambda x: F.concat_ws("-", *[x.seq[f"k{i}"] for i in range(1, 6)])), ","
        ).alias("comp_ids"),
    )


def _market_price(spark, root):
    return valued(spark, root).select("listing_id", "n_comparables", "market_price")


def _strength(spark, root):
    return valued(spark, root).groupBy("basis_strength").agg(
        F.count("*").alias("n"), F.min("n_comparables").alias("least"), F.max("n_comparables").alias("most")
    )


def _details(spark, root):
    text = F.transform(
        "details",
        lambda d: F.concat_ws(
            ":", d.listing_id, d.price, d.mileage, d.mileage_gap, d.mileage_adjustment, d.comp_equipment,
            d.target_equipment, d.equipment_adjustment, d.adjusted_price,
        ),
    )
    return valued(spark, root, details=True).select(
        "listing_id", "n_comparables", "basis_strength", "adjusted_median",
        F.array_join(text, " ").alias("details"),
    )


def _base_price(spark, root):
    return market.with_base_price(listings(spark, root), MARKET).select("listing_id", "base_price")


def _expectation(spark, root):
    return market.mileage_expectation(listings(spark, root), as_of(), MARKET).select(
        "listing_id", "age_years", "expected_mileage", "mileage_deviation", "mileage_effect"
    )


def _age(spark, root):
    age = age_in_years(F.col("model_year"), as_of())
    return listings(spark, root).select("listing_id", half_even_digits(age, 4).alias("age"))


def _market_value(spark, root):
    return valued(spark, root).select("listing_id", "market_value")


def _bargains(spark, root):
    return valued(spark, root).select(
        "listing_id", "market_value", "diff", F.round("bargain_ratio", 6).alias("bargain_ratio"), "level",
        "n_comparables", "basis_strength", "empirical",
    )


def _score_parts(spark, root):
    return score.with_score(valued(spark, root), SCORE).select(
        "listing_id", "price_points", "mileage_points", "equipment_points", "trust_points",
        "auction_deduction", "score", score.score_level(F.col("score")).alias("score_level"),
    )


def _one(column: str):
    def run(spark, root):
        return score.with_score(valued(spark, root), SCORE).groupBy(column).agg(F.count("*").alias("n"))

    return run


def _levels(spark, root):
    df = score.with_score(valued(spark, root), SCORE)
    return df.groupBy(score.score_level(F.col("score")).alias("score_level")).agg(F.count("*").alias("n"))


def _mileage_points(spark, root):
    p = score.mileage_points(F.col("mileage"), SCORE)
    return listings(spark, root).select("listing_id", p.alias("points"))


def _equipment_points(spark, root):
    p = score.equipment_points(F.col("trim"), F.col("tow_hook"), F.col("heater"), SCORE)
    return listings(spark, root).select("listing_id", p.alias("points"))


def _trust_points(spark, root):
    df = listings(spark, root)
    p = score.trust_points(F.col("certified"), F.col("owners"), F.col("rental"), F.col("imported"))
    return df.select("listing_id", p.alias("points"))


def _title(spark, root):
    from pricelode.plans.clean_queries import WATCH

    return score.with_display_title(listings(spark, root), WATCH).select("listing_id", "display_title")


def _funnel_rows(spark, root):
    return funnel.stages(score.with_score(valued(spark, root), SCORE), SCORE)


def _funnel(spark, root):
    return _funnel_rows(spark, root).select("listing_id", "stage")


def _funnel_stats(spark, root):
    return funnel.statistics(_funnel_rows(spark, root), SCORE)


def _candidates(spark, root):
    from pricelode.plans.clean_queries import WATCH

    df = score.with_display_title(_funnel_rows(spark, root), WATCH)
    return funnel.candidate_records(df, as_of(), MARKET, SCORE).select(
        "listing_id", "score", "price_points", "mileage_points", "equipment_points", "trust_points", "diff",
        "market_value", "price", "mileage", "model_year", "title", "trim", "status", "url", "age_years",
        "expected_mileage", "mileage_deviation", "mileage_effect",
    )


def _top(spark, root):
    from pricelode.plans.clean_queries import WATCH

    df = score.with_display_title(_funnel_rows(spark, root), WATCH)
    df = funnel.candidate_records(df, as_of(), MARKET, SCORE)
    return funnel.top_report(df.withColumn("trim", F.replace("trim", F.lit(" "), F.lit(", "))), SCORE)


def _messages(spark, root):
    from pricelode.plans.clean_queries import WATCH

    df = _funnel_rows(spark, root).filter(F.col("stage") == "sent")
    df = df.withColumn("trim", F.concat(F.lit("x2"), F.replace("trim", F.lit(" "), F.lit("-")), F.lit(" 4MOTION")))
    return score.alert_messages(score.with_display_title(df, WATCH)).select("listing_id", "subject", "message")


QUERIES = {
    "market_basis": _basis,
    "market_basis_counts": _basis_counts,
    "leasing_flag": _leasing,
    "plausible_cash_price": _cash,
    "minimum_mileage": _min_mileage,
    "listing_identity": _identity,
    "url_resolver": _url,
    "trim_amount": _trim_amount,
    "option_amount": _option_amount,
    "equipment_value": _equipment,
    "comparables": _comparables,
    "self_exclusion": _self_exclusion,
    "adjusted_median_price": _market_price,
    "basis_strength": _strength,
    "comparable_details": _details,
    "base_price_lookup": _base_price,
    "mileage_expectation": _expectation,
    "age_in_years": _age,
    "market_value": _market_value,
    "bargain_classes": _bargains,
    "price_points": _one("price_points"),
    "mileage_points": _mileage_points,
    "equipment_points": _equipment_points,
    "trust_points": _trust_points,
    "total_score": _score_parts,
    "score_levels": _levels,
    "display_title": _title,
    "candidate_funnel": _funnel,
    "funnel_statistics": _funnel_stats,
    "candidate_records": _candidates,
    "top_candidates": _top,
    "alert_messages": _messages,
}
