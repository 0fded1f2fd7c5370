"""Market basis, comparables and valuation.

The comparables of a listing are the nearest listings by mileage in its own
category.  A pairwise band join would grow with the square of a category, so
the work is split in three bounded steps:

1. per category and mileage only the first rows in input order can ever be
   among the nearest, so a top-k window (limited before its shuffle) keeps
   those;
2. a window over the mileages of a category gives each *mileage* its nearest
   candidates from below and above;
3. each listing looks its mileage up, leaves out its own copies and values
   itself from an array in one projection, without a further shuffle.

Mileage is integral and the windows run per band-wide cell, so the rows of a
window partition have a bound that does not depend on the data size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.config import (
    FORMER_LEASING_PHRASES,
    LEASING_KEYWORDS,
    LEVEL_BARGAIN,
    LEVEL_EXTREME,
    STRENGTH_LEVELS,
    STRENGTH_NONE,
    MarketParams,
)
from pricelode.functions.flags import is_true
from pricelode.functions.numbers import age_in_years, half_even, half_even_digits
from pricelode.functions.text import (
    blank_to_null,
    clean_url,
    contains_any,
    first_keyword_value,
    loose_text,
    strip,
)

LEASING_TEXT_COLUMNS = (
    "trim", "model", "variant", "price_text", "ad_title", "title", "description", "free_text",
    "leasing", "financing", "url",
)

from pricelode.schema import struct
from pricelode.session import materialize, release

# --- predicates and projections ---------------------------------------------


def leasing_flag(df: DataFrame) -> Column:
    """Offers that quote a leasing rate; mentions of a *former* lease do not count."""
    parts = [F.col(c).cast("string") for c in LEASING_TEXT_COLUMNS if c in df.columns]
    if "urls" in df.columns:
        parts.append(F.array_join("urls", " "))
    text = loose_text(F.concat_ws(" ", *parts))
    for phrase in FORMER_LEASING_PHRASES:
        text = F.replace(text, F.lit(phrase), F.lit(""))
    return contains_any(text, LEASING_KEYWORDS)


def plausible_price(price: Column, params: MarketParams) -> Column:
    return F.coalesce(price.between(params.min_price, params.max_price), F.lit(False))


def listing_url(df: DataFrame) -> Column:
    """Clean url, else the first usable one of ``urls``."""
    first = clean_url(blank_to_null(F.col("url")))
    if "urls" not in df.columns:
        return first
    cleaned = F.transform(F.col("urls"), lambda u: blank_to_null(clean_url(u)))
    fallback = F.get(F.filter(cleaned, lambda u: u.isNotNull()), F.lit(0))
    return F.when(F.length(F.col("url")) > 0, first).otherwise(fallback)


def listing_identity(df: DataFrame) -> Column:
    """listing id, else alternative id, else url, else null."""
    ids = [blank_to_null(strip(F.col(c))) for c in ("listing_id", "id") if c in df.columns]
    return F.coalesce(*ids, blank_to_null(listing_url(df)))


def category_key() -> Column:
    """One text key for (model, variant, year); missing parts group together."""
    missing = F.lit("\u0000")
    return F.concat_ws(
        "\u0001",
        F.coalesce(F.lower("model"), missing),
        F.coalesce(F.col("variant"), missing),
        F.coalesce(F.col("model_year").cast("string"), missing),
    )


def trim_amount(params: MarketParams, text: Column | None = None) -> Column:
    return first_keyword_value(loose_text(F.col("trim")) if text is None else text, params.trim_amounts)


def option_amount(params: MarketParams, dtypes: dict[str, str] | None = None) -> Column:
    total = F.lit(0)
    for name, amount in params.option_amounts:
        kind = (dtypes or {}).get(name, "boolean")
        total = total + F.when(is_true(F.col(name), kind), amount).otherwise(0)
    return total


def clamp(col: Column, cap: int) -> Column:
    return F.least(F.greatest(col, F.lit(-cap)), F.lit(cap))


def equipment_amount(
    params: MarketParams, dtypes: dict[str, str] | None = None, text: Column | None = None
) -> Column:
    return clamp(trim_amount(params, text) + option_amount(params, dtypes), params.equipment_cap)


def reject_reason(df: DataFrame, params: MarketParams) -> Column:
    """First reason a listing cannot serve as market evidence, null when it can."""
    mileage = F.col("mileage")
    return (
        F.when(leasing_flag(df), "leasing")
        .when(~plausible_price(F.col("price"), params), "price")
        .when(mileage.isNull() | (mileage < 0), "price")
        .when(mileage < params.min_mileage, "mileage")
    )


def with_market_columns(df: DataFrame, params: MarketParams) -> DataFrame:
    """Category, identity and equipment value of every listing."""
    df = df.withColumn("_trim", loose_text(F.col("trim")))
    return df.withColumns(
        {
            "category": category_key(),
            "ident": listing_identity(df),
            "url_key": blank_to_null(listing_url(df)),
            "equipment": equipment_amount(params, dict(df.dtypes), F.col("_trim")).cast("double"),
        }
    ).drop("_trim")


def market_basis(df: DataFrame, params: MarketParams | None = None) -> DataFrame:
    """Listings that may serve as market evidence; cheap tests come first."""
    params = params or MarketParams()
    leasing = F.col("leasing_offer") if "leasing_offer" in df.columns else leasing_flag(df)
    df = df.filter(
        plausible_price(F.col("price"), params)
        & F.coalesce(F.col("mileage") >= params.min_mileage, F.lit(False))
        & ~leasing
    )
    return df if "category" in df.columns else with_market_columns(df, params)


def basis_counts(df: DataFrame, params: MarketParams | None = None) -> DataFrame:
    """Rows per first reject reason; accepted rows count as ``ok``."""
    params = params or MarketParams()
    reason = F.coalesce(reject_reason(df, params), F.lit("ok")).alias("reason")
    return df.select(reason).groupBy("reason").agg(F.count("*").alias("n"))


# --- comparables --------------------------------------------------------------


_CANDIDATE = ("seq", "mileage", "price", "equipment", "ident_hash", "url_hash")
_TEXTS = ("ident", "url_key")


def _hashed(df: DataFrame) -> DataFrame:
    """8 bytes for each identity text, null where there is none."""
    short = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    return df.withColumns({"ident_hash": short("ident"), "url_hash": short("url_key")})


def _with_gap(c: Column, gap: Column, fields: tuple[str, ...]) -> Column:
    """The candidate with its distance first, so that structs sort nearest first."""
    return F.struct(gap.alias("gap"), *[c[f].alias(f) for f in fields])


def _nearest_by_point(points: DataFrame, basis: DataFrame, params: MarketParams, keep: int, fields: tuple[str, ...]) -> DataFrame:
    """``points`` (category, mileage, ...) with ``near``: array of the ``keep`` nearest basis rows."""
    # Led by a hash, so that sorting seldom compares texts.
    in_order = Window.partitionBy(F.xxhash64("category", "mileage"), "category", "mileage").orderBy("seq")
    own = (
        basis.select("category", "mileage", "seq", F.struct(*fields).alias("c"))
        .withColumn("rn", F.row_number().over(in_order))
        .filter(F.col("rn") <= keep)
        .groupBy("category", "mileage")
        .agg(F.sort_array(F.collect_list("c")).alias("own"))
    )
    points_columns = points.columns
    points = own.join(points.withColumn("wanted", F.lit(True)), ["category", "mileage"], "full")

    band = params.wide_band
    cell = F.floor(F.col("mileage") / band)
    spread = points.withColumn("home", cell).withColumn(
        "cell", F.explode(F.array(F.col("home") - 1, F.col("home"), F.col("home") + 1))
    )
    by_mileage = Window.partitionBy("category", "cell").orderBy("mileage")
    evidence = F.col("own").isNotNull()
    rank = F.sum(F.when(evidence, F.size("own")).otherwise(0)).over(by_mileage.rowsBetween(Window.unboundedPreceding, 0))
    # Places count rows.  Points without evidence sit half a row above the last point that has some.  A point has up to
    # ``keep`` rows, so the nearest ``keep`` rows of a side end within 2 * ``keep`` rows: a frame never holds more.
    spread = spread.withColumn("pos", rank * 2 + F.when(evidence, 0).otherwise(1))
    by_pos = Window.partitionBy("category", "cell").orderBy("pos")
    spread = spread.select(
        "*",
        F.collect_list("own").over(by_pos.rangeBetween(-4 * keep, -1)).alias("below"),
        F.collect_list("own").over(by_pos.rangeBetween(1, 4 * keep)).alias("above"),
    ).filter((F.col("cell") == F.col("home")) & F.col("wanted"))

    below = F.slice(F.flatten(F.reverse("below")), 1, keep)
    above = F.slice(F.flatten("above"), 1, keep)
    here = F.coalesce(F.col("own"), F.expr("slice(flatten(below), 1, 0)"))
    merged = F.transform(
        F.concat(below, here, above),
        lambda c: _with_gap(c, F.abs(c.mileage - F.col("mileage")), fields),
    )
    merged = F.sort_array(F.filter(merged, lambda x: x.gap <= band))
    return spread.select(*points_columns, F.slice(merged, 1, keep).alias("near"))


def _most_alike(near: Column, key: Callable[[Column], Column]) -> Column:
    """Rows of the commonest non-null key in an array; keys are counted only where some repeat."""
    keys = F.filter(F.transform(near, key), lambda x: x.isNotNull())
    alike = F.transform(F.array_distinct(keys), lambda k: F.size(F.filter(keys, lambda x: x == k)))
    differing = F.size(F.array_distinct(keys)) == F.size(keys)
    return F.when(differing, F.least(F.size(keys), F.lit(1))).otherwise(F.coalesce(F.array_max(alike), F.lit(0)))


def _nearest(points: DataFrame, basis: DataFrame, params: MarketParams, fields: tuple[str, ...]) -> DataFrame:
    """(category, mileage) → nearest rows, enough of them for every target of the point.

    A target leaves out its own copies: rows of its identity, of its url or, where
    it or the row has no identity, of its values.  A point is ``blind`` if one of
    its targets has no identity.  A list is enough if it holds the whole band, or
    if without its commonest identity, url and values that may be left out
    ``max_comparables`` rows are left.

    Points that have not enough go again, on a basis without the copies in every
    respect beyond ``max_comparables``, which no target can need.  There ``keep``
    rows of a value suffice as well: a target leaves out all of them or those of
    its identity and url only.  Lists thrice as long then hold ``keep`` rows of
    other values however many copies stand nearby; rings grow only where rows
    of one identity or url abound.
    """
    k, slack, done = params.max_comparables, params.identity_slack, None
    keep, near = k + slack, F.col("near")
    values = lambda x: F.struct(x.price.alias("p"), x.mileage.alias("m"), x.ident_hash.isNull().alias("n"))
    left_out = lambda x: F.when(F.col("blind") | x.ident_hash.isNull(), F.struct(x.price.alias("p"), x.mileage.alias("m")))
    copies = _most_alike(near, lambda x: x.ident_hash) + _most_alike(near, lambda x: x.url_hash)
    enough = (F.size(near) < keep) | (F.size(near) - copies - _most_alike(near, left_out) >= k)
    found = _nearest_by_point(points, basis, params, keep, fields)
    while True:
        found = materialize(found.withColumn("enough", enough), "nearest")
        ready = found.filter("enough").drop("enough", "blind")
        done = ready if done is None else done.unionByName(ready)
        points = found.filter("not enough").select("category", "mileage", "blind")
        if points.isEmpty():
            release(basis)
            return done
        if keep == k + slack:
            alike = Window.partitionBy("category", "mileage", "price", "ident_hash", "url_hash").orderBy("seq")
            basis = basis.join(points.select("category").distinct(), "category", "left_semi")
            basis = materialize(basis.withColumn("rn", F.row_number().over(alike)).filter(F.col("rn") <= k).drop("rn"), "nearest-basis")
        of_value = Window.partitionBy("category", "mileage", "price", F.col("ident_hash").isNull()).orderBy("seq")
        few = basis.withColumn("rn", F.row_number().over(of_value)).filter(F.col("rn") <= keep).drop("rn")
        found = _nearest_by_point(points, few, params, 3 * keep, fields)
        whole = (F.size(near) < 3 * keep) & (_most_alike(near, values) < keep)
        enough = whole | (copies <= keep - k)
        keep *= 4


def _same_listing(c: Column) -> Column:
    """``c`` is the target itself: same identity, same url or, when a side has neither, same values."""
    no_identity = F.col("ident_hash").isNull() | c.ident_hash.isNull()
    return (
        F.coalesce(F.col("ident_hash") == c.ident_hash, F.lit(False))
        | F.coalesce(F.col("url_hash") == c.url_hash, F.lit(False))
        | (
            no_identity
            & F.coalesce(F.col("price") == c.price, F.lit(False))
            & F.coalesce(F.col("mileage") == c.mileage, F.lit(False))
        )
    )


def comparables(targets: DataFrame, basis: DataFrame, params: MarketParams | None = None, texts: bool = True) -> DataFrame:
    """Add ``comps``: up to 15 nearest comparables per target, nearest first.

    Within the near band when at least ``min_comparables`` are there, else
    within the wide band; ties in input order; never the target itself.
    Identities are compared by their hashes; their texts come along with ``texts``.
    """
    params = params or MarketParams()
    fields = _CANDIDATE + (_TEXTS if texts else ())
    points = targets.filter(F.col("mileage").isNotNull()).groupBy("category", "mileage").agg(
        F.bool_or(F.col("ident").isNull()).alias("blind")
    )
    basis = _hashed(basis).select("category", *fields)
    near = _with_order(_nearest(points, basis, params, fields), params)
    joined = _hashed(targets).join(near, ["category", "mileage"], "left")
    return _pick(joined, params)


def _with_order(found: DataFrame, params: MarketParams) -> DataFrame:
    """What the lists of the points tell all their targets, once a point: identities, urls, how many are tight.

    A point is ``clear`` if no identity or url stands twice and no identity is missing:
    a target that has one can leave out a row by its place.
    """
    found = found.select(
        "*", F.col("near.ident_hash").alias("_idents"), F.col("near.url_hash").alias("_urls"),
        F.size(F.filter("near", lambda x: x.gap <= params.near_band)).alias("_n_tight"),
    )
    known = F.array_compact("_urls")
    return found.withColumn(
        "_clear",
        ~F.array_contains(F.transform("_idents", lambda i: i.isNull()), True)
        & (F.size(F.array_distinct("_idents")) == F.size("_idents"))
        & (F.size(F.array_distinct(known)) == F.size(known)),
    )


def _pick(df: DataFrame, params: MarketParams) -> DataFrame:
    """``comps`` from ``near``: the first rows that are not the target, of the near band if it has enough of them.

    In clear points the target stands in one place at most, which is cut out; elsewhere every row is compared.
    """
    k, near = params.max_comparables, F.col("near")
    at_ident = F.coalesce(F.array_position("_idents", F.col("ident_hash")), F.lit(0))
    at_url = F.coalesce(F.array_position("_urls", F.col("url_hash")), F.lit(0))
    df = df.withColumns({"_at_ident": at_ident, "_at_url": at_url})
    one_place = (F.col("_at_ident") == 0) | (F.col("_at_url") == 0) | (F.col("_at_ident") == F.col("_at_url"))
    df = df.withColumns(
        {
            "_at": F.greatest("_at_ident", "_at_url").cast("int"),
            "_by_place": F.coalesce(F.col("_clear") & F.col("ident_hash").isNotNull() & one_place, F.lit(False)),
        }
    )
    at = F.col("_at")
    n_tight = F.col("_n_tight") - (at.between(1, F.col("_n_tight"))).cast("int")
    n = F.least(F.lit(k), F.when(n_tight >= params.min_comparables, n_tight).otherwise(F.size(near)))
    cut = F.when(at == 0, near).otherwise(F.concat(F.slice(near, 1, F.greatest(at - 1, F.lit(0))), F.slice(near, at + 1, k)))
    df = df.withColumns(
        {
            "_placed": F.when(F.col("_by_place"), F.slice(cut, 1, n)),
            "accepted": F.filter(F.when(~F.col("_by_place"), near), lambda x: ~_same_listing(x)),
        }
    )
    df = df.withColumn("tight", F.filter("accepted", lambda x: x.gap <= params.near_band))
    chosen = F.when(F.size("tight") >= params.min_comparables, F.col("tight")).otherwise(F.col("accepted"))
    empty = F.expr("slice(array_repeat(accepted[0], 1), 1, 0)")
    df = df.withColumn("comps", F.coalesce(F.col("_placed"), F.slice(chosen, 1, k), empty))
    return df.drop(
        "near", "ident_hash", "url_hash", "_idents", "_urls", "_n_tight", "_clear", "_at_ident", "_at_url", "_at", "_by_place",
        "_placed", "accepted", "tight",
    )


# --- valuation ------------------------------------------------------------------


def _median_of(sorted_values: Column) -> Column:
    n = F.size(sorted_values)
    low = F.get(sorted_values, F.floor((n - 1) / 2).cast("int"))
    high = F.get(sorted_values, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def _adjusted(params: MarketParams):
    def price_of(x: Column) -> Column:
        by_mileage = (x.mileage - F.col("mileage")) * F.lit(params.price_per_mileage)
        by_equipment = clamp(F.col("equipment") - x.equipment, params.equipment_cap)
        return x.price + by_mileage + by_equipment

    return price_of


def basis_strength(n: Column) -> Column:
    expr = None
    for least, name in STRENGTH_LEVELS:
        expr = F.when(n >= least, name) if expr is None else expr.when(n >= least, name)
    return expr.otherwise(STRENGTH_NONE)


def adjusted_median_price(df: DataFrame, params: MarketParams) -> DataFrame:
    """``market_price``: median of the adjusted comparables to the nearest 1000."""
    df = df.withColumn("n_comparables", F.size("comps"))
    df = df.withColumn("_prices", F.sort_array(F.transform("comps", _adjusted(params))))
    median = F.when(F.col("n_comparables") >= params.min_comparables, _median_of(F.col("_prices")))
    return df.withColumn("market_price", half_even(median, 1000)).drop("_prices")


def comparable_details(df: DataFrame, params: MarketParams) -> DataFrame:
    """``details``: each comparable with its rounded adjustments; plus their median."""

    def detail(x: Column) -> Column:
        gap = x.mileage - F.col("mileage")
        by_equipment = clamp(F.col("equipment") - x.equipment, params.equipment_cap)
        rounded = lambda c: F.rint(c).cast("bigint")
        return F.struct(
            rounded(x.price).alias("price"),
            x.mileage.alias("mileage"),
            gap.alias("mileage_gap"),
            rounded(gap * F.lit(params.price_per_mileage)).alias("mileage_adjustment"),
            rounded(x.equipment).alias("comp_equipment"),
            rounded(F.col("equipment")).alias("target_equipment"),
            rounded(by_equipment).alias("equipment_adjustment"),
            rounded(_adjusted(params)(x)).alias("adjusted_price"),
            x.ident.alias("listing_id"),
            x.url_key.alias("url"),
        )

    df = df.withColumn("details", F.transform("comps", detail))
    prices = F.sort_array(F.transform("details", lambda d: d.adjusted_price))
    return df.withColumn("_sorted", prices).withColumn(
        "adjusted_median", F.rint(_median_of(F.col("_sorted"))).cast("bigint")
    ).drop("_sorted")


def base_price_table(df: DataFrame, params: MarketParams) -> tuple[DataFrame, DataFrame]:
    """Exact table and per (model, variant) median table of the fallback prices."""
    spark = df.sparkSession
    schema = struct("bp_model string, bp_variant string, bp_year int, bp_price double")
    exact = spark.createDataFrame([(m, v, y, float(p)) for m, v, y, p in params.base_prices], schema)
    spread = exact.groupBy("bp_model", "bp_variant").agg(
        F.floor(F.median("bp_price")).cast("double").alias("bp_median")
    )
    return exact, spread


def with_base_price(df: DataFrame, params: MarketParams) -> DataFrame:
    """``base_price``: exact (model, variant, year), else the median over years, else null.

    Both lookup tables come from the parameter list, which bounds their size.
    """
    exact, spread = base_price_table(df, params)
    model = F.lower(F.coalesce(blank_to_null(F.col("model")), F.lit(params.default_model)))
    spread = spread.withColumnsRenamed({"bp_model": "bs_model", "bp_variant": "bs_variant"})
    df = df.withColumn("_model", model)
    df = df.join(
        F.broadcast(exact),
        (F.col("_model") == F.col("bp_model"))
        & (F.col("variant") == F.col("bp_variant"))
        & (F.col("model_year") == F.col("bp_year")),
        "left",
    ).join(
        F.broadcast(spread),
        (F.col("_model") == F.col("bs_model")) & (F.col("variant") == F.col("bs_variant")),
        "left",
    )
    df = df.withColumn("base_price", F.coalesce("bp_price", "bp_median"))
    return df.drop("_model", "bp_model", "bp_variant", "bp_year", "bp_price", "bs_model", "bs_variant", "bp_median")


def mileage_expectation(df: DataFrame, as_of: Column, params: MarketParams | None = None) -> DataFrame:
    """Age, expected mileage, deviation and its price effect, for reports."""
    params = params or MarketParams()
    known = F.col("model_year").isNotNull() & (F.col("model_year") != 0)
    age = age_in_years(F.col("model_year"), as_of)
    expected = age * F.lit(float(params.expected_mileage_per_year))
    deviation = F.coalesce(F.col("mileage").cast("double"), expected) - expected
    effect = -deviation * F.lit(params.price_per_mileage)
    zero = F.lit(0.0)
    return df.withColumns(
        {
            "age_years": F.when(known, half_even_digits(age, 2)).otherwise(zero),
            "expected_mileage": F.when(known, F.rint(expected)).otherwise(zero).cast("bigint"),
            "mileage_deviation": F.when(known, F.rint(deviation)).otherwise(zero).cast("bigint"),
            "mileage_effect": F.when(known, F.rint(effect)).otherwise(zero).cast("bigint"),
        }
    )


def market_value(df: DataFrame, as_of: Column, params: MarketParams | None = None) -> DataFrame:
    """``market_value``: the comparables' price, else base price with adjustments, else 0."""
    params = params or MarketParams()
    df = with_base_price(df, params)
    expected = age_in_years(F.col("model_year"), as_of) * F.lit(float(params.expected_mileage_per_year))
    deviation = F.coalesce(F.col("mileage").cast("double"), expected) - expected
    fallback = F.col("base_price") - deviation * F.lit(params.price_per_mileage) + F.col("equipment")
    value = F.coalesce(F.col("market_price"), fallback)
    return df.withColumn("market_value", F.coalesce(half_even(value, 1000), F.lit(0.0)))


def classify(df: DataFrame, params: MarketParams | None = None) -> DataFrame:
    """Difference to the market, bargain percent and level."""
    params = params or MarketParams()
    df = df.withColumn("basis_strength", basis_strength(F.col("n_comparables")))
    df = df.withColumn("empirical", F.col("n_comparables") >= params.min_comparables)
    df = df.withColumn("diff", F.col("market_value") - F.col("price"))
    df = df.withColumn(
        "bargain_ratio",
        F.when(F.col("market_value") > 0, F.col("diff") / F.col("market_value") * 100).otherwise(F.lit(0.0)),
    )
    solid = F.col("basis_strength").isin(STRENGTH_LEVELS[0][1], STRENGTH_LEVELS[1][1])
    level = F.when(
        F.col("empirical") & solid
        & (F.col("diff") >= params.extreme_diff) & (F.col("bargain_ratio") >= params.extreme_pct),
        LEVEL_EXTREME,
    ).when(
        F.col("empirical")
        & (F.col("diff") >= params.bargain_diff) & (F.col("bargain_ratio") >= params.bargain_pct),
        LEVEL_BARGAIN,
    )
    return df.withColumn("level", level).withColumn(
        "bargain_pct", half_even_digits(F.col("bargain_ratio"), 1)
    )


def value_listings(
    listings: DataFrame, as_of: Column, params: MarketParams | None = None, details: bool = False
) -> DataFrame:
    """Value every listing against the basis formed by all of them."""
    params = params or MarketParams()
    targets = with_market_columns(listings, params).withColumn("leasing_offer", leasing_flag(listings))
    valued = comparables(targets, market_basis(targets, params), params, details)
    valued = adjusted_median_price(valued, params)
    if details:
        valued = comparable_details(valued, params)
    return classify(market_value(valued, as_of, params), params)
