"""Which two listings describe the same object: normal form, candidate pairs, score.

Listings that agree in every matching-relevant value share a *profile*.  Pairs
are formed between profiles only, so a mass of copies costs one row here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.config import MatchParams
from pricelode.functions.numbers import mileage_similarity, price_similarity
from pricelode.functions.similarity import with_ratio
from pricelode.functions.text import blank_to_null, norm_id, norm_text, norm_variant
from pricelode.session import materialize

TEXT_EQUIPMENT = ("trim", "service_history", "last_service", "next_service", "first_registration")
PLAIN_EQUIPMENT = ("tow_hook", "heater", "certified", "big_battery", "owners", "rental", "imported")
EXTRA_SIGNALS = ("owners", "tow_hook", "heater", "big_battery", "certified")


def completeness(df: DataFrame) -> Column:
    """How many of the descriptive fields are filled; false and 0 count as unfilled."""
    text = ("reg_no", "trim", "service_history", "last_service", "next_service", "first_registration",
            "listing_id", "variant", "model")
    flags = ("tow_hook", "heater", "certified", "big_battery", "rental", "imported")
    numbers = ("owners", "mileage", "price", "model_year")
    terms = [F.coalesce((F.length(F.col(c)) > 0).cast("int"), F.lit(0)) for c in text]
    terms += [F.coalesce(F.col(c).cast("int"), F.lit(0)) for c in flags]
    terms += [F.coalesce((F.col(c) != 0).cast("int"), F.lit(0)) for c in numbers]
    terms.append(F.coalesce(F.size(F.filter("vins", lambda v: F.length(v) > 0)), F.lit(0)))
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def with_profile(df: DataFrame, params: MatchParams | None = None) -> DataFrame:
    """Add ``p`` (normal form of the matching values) and ``pid`` (its digest)."""
    params = params or MatchParams()
    vins = F.array_sort(F.array_distinct(F.filter(
        F.transform("vins", lambda v: norm_id(v)), lambda v: F.length(v) > 0)))
    fields = [
        blank_to_null(norm_text(F.col("model"))).alias("model"),
        blank_to_null(norm_variant(F.col("variant"), params.variant_rewrites)).alias("variant"),
        F.col("model_year").cast("int").alias("year"),
        F.col("mileage").cast("double").alias("mileage"),
        F.col("price").cast("double").alias("price"),
        blank_to_null(norm_id(F.col("reg_no"))).alias("reg"),
        F.when(F.size(vins) > 0, vins).alias("vins"),
        blank_to_null(norm_text(F.col("first_registration"))).alias("first"),
        *[F.when(F.length(F.col(c)) > 0, norm_text(F.col(c))).alias(f"e_{c}") for c in TEXT_EQUIPMENT],
        *[F.col(c).alias(f"e_{c}") for c in PLAIN_EQUIPMENT],
        completeness(df).alias("completeness"),
    ]
    df = df.withColumn("p", F.struct(*fields))
    return df.withColumn("pid", F.unhex(F.md5(F.to_json("p", {"ignoreNullFields": "false"}))))


def profiles(rows: DataFrame) -> DataFrame:
    """One row per profile with its first position and number of copies."""
    return rows.groupBy("pid").agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("n"), F.first("p").alias("p")
    )


# --- the decision for one pair ----------------------------------------------


def _equal(x: Column, y: Column) -> Column:
    return F.coalesce(x == y, F.lit(False))


def _wild(x: Column, y: Column) -> Column:
    """Equal, or unknown on a side."""
    return F.coalesce(x == y, F.lit(True))


def _near(x: Column, y: Column, width: float) -> Column:
    return F.coalesce(F.abs(x - y) <= width, F.lit(True))


def reg_equal(a: Column, b: Column) -> Column:
    return _equal(a.reg, b.reg)


def vin_shared(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a.vins, b.vins), F.lit(False))


def identical(a: Column, b: Column) -> Column:
    """Same core data; unknown values agree with everything."""
    return (
        _equal(a.model, b.model) & _wild(a.year, b.year) & _wild(a.variant, b.variant)
        & _wild(a["first"], b["first"]) & _near(a.mileage, b.mileage, 1) & _near(a.price, b.price, 1)
        & _wild(a.reg, b.reg) & F.coalesce(F.arrays_overlap(a.vins, b.vins), F.lit(True))
    )


def equipment_agreement(a: Column, b: Column) -> tuple[Column, Column]:
    """(agreeing, known on both sides) over the equipment fields."""
    same, known = F.lit(0), F.lit(0)
    for c in (*TEXT_EQUIPMENT, *PLAIN_EQUIPMENT):
        x, y = a[f"e_{c}"], b[f"e_{c}"]
        known = known + (x.isNotNull() & y.isNotNull()).cast("int")
        same = same + _equal(x, y).cast("int")
    return same, known


def _share_points(hits: Column, of: Column, points: int) -> Column:
    return F.when(of > 0, F.rint(hits / of * points)).otherwise(F.lit(0.0))


VARIANT_POINTS = ((0.95, 25), (0.90, 23), (0.80, 18), (0.70, 10), (0.60, 5))


def base_points(a: Column, b: Column, params: MatchParams) -> Column:
    """Points for everything but the variant; the same in both directions."""
    same, known = equipment_agreement(a, b)
    extra, extra_known = F.lit(0), F.lit(0)
    for c in EXTRA_SIGNALS:
        x, y = a[f"e_{c}"], b[f"e_{c}"]
        extra_known = extra_known + (x.isNotNull() & y.isNotNull()).cast("int")
        extra = extra + _equal(x, y).cast("int")
    total = (
        F.when(_equal(a.year, b.year), 15).otherwise(0)
        + F.rint(mileage_similarity(F.abs(a.mileage - b.mileage), params.mileage_margin) * 25)
        + F.when(_equal(a["first"], b["first"]), 20).otherwise(0)
        + F.rint(price_similarity(F.abs(a.price - b.price), params.price_margin) * 3)
        + _share_points(same, known, 7)
        + _share_points(extra, extra_known, 5)
    )
    return total.cast("int")


def variant_points(similarity: Column) -> Column:
    points = F.when(similarity.isNull(), 0)
    for least, n in VARIANT_POINTS:
        points = points.when(similarity >= least, n)
    return points.otherwise(0)


def _blocked(a: Column, b: Column) -> Column:
    return ~_equal(a.model, b.model) | ~_wild(a.year, b.year)


def sure_kind(a: Column, b: Column) -> Column:
    """Why a pair matches without a score; null where only the score can tell."""
    return F.when(reg_equal(a, b), "regnr").when(vin_shared(a, b), "vin").when(identical(a, b), "identisk_annons")


def _verdict(sure: Column, points: Column, reason: Column, params: MatchParams) -> Column:
    """struct(matches, score, match_type, reason): reg-no, VIN, identical, then the score.

    A missing variant leaves at most 75 points, below the gate, so no extra
    rule about missing variants is needed.
    """
    known = sure.isNotNull()
    return F.struct(
        (known | (points >= params.score_gate)).alias("matches"),
        F.when(known, 100).otherwise(points).alias("score"),
        F.when(sure == "identisk_annons", "fingerprint").otherwise(F.coalesce(sure, F.lit("fingerprint"))).alias("match_type"),
        F.coalesce(sure, reason).alias("reason"),
    )


def with_decision(pairs: DataFrame, params: MatchParams, left: str = "a_p", right: str = "b_p",
                  out: str = "d", texts: DataFrame | None = None) -> DataFrame:
    """Add the decision struct for ``left`` as representative and ``right`` as newcomer.

    The dictionary of variant pairs is read from ``texts``, the same pairs with their variants
    and as little else as need be; without it, ``pairs`` is read twice.
    """
    a, b = F.col(left), F.col(right)
    reason = (
        F.when(~_equal(a.model, b.model), "olika_modell").when(~_wild(a.year, b.year), "olika_arsmodell")
        .otherwise("fingerprint")
    )
    # What only the sides can tell, so that they need not travel with the pair from here on.
    told = pairs.withColumns({
        "_sure": sure_kind(a, b), "_base": F.when(~_blocked(a, b), base_points(a, b, params)), "_reason": reason,
        "_left": a.variant, "_right": b.variant,
    })
    open_ = F.col("_sure").isNull() & F.col("_base").isNotNull()
    least = F.lit(VARIANT_POINTS[-1][0])
    if texts is not None:
        texts = texts.select(a.variant.alias("x"), b.variant.alias("y"), least.alias("least"))
    scored = with_ratio(told, F.col("_left"), F.col("_right"), F.when(open_, least), "_ratio", texts)
    points = F.when(F.col("_base").isNull(), 0).otherwise(F.least(F.lit(100), F.col("_base") + variant_points(F.col("_ratio"))))
    return scored.withColumn(out, _verdict(F.col("_sure"), points, F.col("_reason"), params)).drop(
        "_ratio", "_sure", "_base", "_reason", "_left", "_right"
    )


# --- candidate pairs -----------------------------------------------------------


def _cells(value: Column, gap: int, width: int) -> Column:
    """Cells of ``width`` that hold values within ``gap``."""
    return F.sequence(F.floor((value - gap) / width), F.floor((value + gap) / width))


#: What decides whether two profiles are candidates.
_CORE = ("model", "year", "variant", "mileage", "price", "reg", "vins", "first")
PAIR_COLUMNS = ["a_pid", "a_first_seq", "a_p", "b_pid", "b_first_seq", "b_p"]


def _sides(prof: DataFrame, fields: tuple[str, ...], *more: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a pair with the ``fields`` of ``p`` that are read from pairs; they travel once a profile, not once a pair."""
    read = F.struct(*[F.col(f"p.{c}").alias(c) for c in fields])
    side = lambda s: prof.select(
        F.col("pid").alias(f"{s}_pid"), F.col("first_seq").alias(f"{s}_first_seq"), read.alias(f"{s}_p"), *[F.col(c).alias(f"{s}_{c}") for c in more]
    )
    return side("a"), side("b")


#: Rows of a side that one task compares with as many of the other side.
BLOCK_ROWS = 2000


def in_blocks(a: DataFrame, b: DataFrame, on: list[str], block: int = BLOCK_ROWS) -> DataFrame:
    """Inner join of ``a`` (``a_pid``, ...) and ``b`` (``b_pid``, ...) on ``on``, hot keys dealt over many tasks.

    A key with more than ``block`` rows on a side falls into parts of about
    ``block`` rows by the hash of ``pid``; each pair of parts is a key of its
    own.  Keys are counted first, so only the hot ones are repeated.
    """
    # Keys are counted by their hash: 8 bytes a row. Where two share one, a key is dealt that need not be.
    a, b = (df.withColumn("_key", F.xxhash64(*on)) for df in (a, b))
    counted = a.select("_key", F.lit(1).alias("_na"), F.lit(0).alias("_nb")).unionByName(b.select("_key", F.lit(0).alias("_na"), F.lit(1).alias("_nb")))
    parts = [F.ceil(F.sum(n) / block).cast("int").alias(n) for n in ("_na", "_nb")]
    # Written, so that Spark knows how few they are and need not shuffle for them.
    hot = materialize(counted.groupBy("_key").agg(*parts).filter("_na > 0 AND _nb > 0 AND _na + _nb > 2"), "hot-keys")

    def dealt(df: DataFrame, pid: str, own: str, other: str) -> DataFrame:
        n, m = (F.coalesce(f"_n{x}", F.lit(1)) for x in (own, other))
        placed = df.join(hot, "_key", "left").drop("_key").withColumn(f"_{own}", F.pmod(F.xxhash64(pid), n).cast("int"))
        return placed.withColumn(f"_{other}", F.explode(F.sequence(F.lit(0), m - 1))).drop("_na", "_nb")

    joined = dealt(a, "a_pid", "a", "b").join(dealt(b, "b_pid", "b", "a"), [*on, "_a", "_b"])
    return joined.drop("_a", "_b")


def score_pairs(prof: DataFrame, params: MatchParams, fields: tuple[str, ...] | None = None) -> DataFrame:
    """``PAIR_COLUMNS`` of the pairs the score route can accept; the sides show all of ``p``, or its ``fields`` and the key.

    Reaching the gate needs an equal first registration and mileages within
    the margin, so (model, first registration, mileage cell) loses nothing.
    The texts of the key travel as 8 bytes; that they are equal is checked on the pairs that met.
    """
    usable = F.col("p.model").isNotNull() & F.col("p.first").isNotNull() & F.col("p.mileage").isNotNull()
    every = tuple(f.name for f in prof.schema["p"].dataType)
    a, b = _sides(prof.filter(usable), every if fields is None else tuple(dict.fromkeys((*fields, "model", "first", "mileage", "year"))))
    margin = params.mileage_margin
    key = lambda side: F.xxhash64(f"{side}_p.model", f"{side}_p.first").alias("k_texts")
    a = a.select("*", key("a"), F.floor(F.col("a_p.mileage") / (2 * margin)).alias("k_cell"))
    b = b.select("*", key("b"), F.explode(_cells(F.col("b_p.mileage"), margin, 2 * margin)).alias("k_cell"))
    gap = F.abs(F.col("a_p.mileage") - F.col("b_p.mileage"))
    met = in_blocks(a, b, ["k_texts", "k_cell"]).filter(F.col("a_first_seq") < F.col("b_first_seq"))
    same = _equal(F.col("a_p.model"), F.col("b_p.model")) & _equal(F.col("a_p.first"), F.col("b_p.first"))
    return met.filter((gap <= margin) & _wild(F.col("a_p.year"), F.col("b_p.year")) & same).select(*PAIR_COLUMNS)


def in_score_route(a: Column, b: Column, params: MatchParams) -> Column:
    """Whether :func:`score_pairs` forms this pair."""
    near = F.abs(a.mileage - b.mileage) <= params.mileage_margin
    return _equal(a["first"], b["first"]) & F.coalesce(near, F.lit(False)) & _equal(a.model, b.model) & _wild(a.year, b.year)


#: Fields that may be unknown on a side of an identical pair, and the cell width of the numeric ones.  A value within 1 of
#: a cell's edge stands in two cells; round numbers, which are common, would all stand at the edges of a round width.
_MAYBE = (("year", None), ("variant", None), ("mileage", 31), ("price", 31))


def identical_pairs(prof: DataFrame) -> DataFrame:
    """``PAIR_COLUMNS`` of the pairs with the same core data, which is all that the sides show; unknown values agree with everything.

    Profiles are sorted by the pattern of fields that they know.  Two patterns
    meet on what both know: that is one route, with its own key, and all routes
    share one join.  The texts of a key travel as 8 bytes; all of the agreement is checked on the pairs that met.
    """
    prof = prof.filter(F.col("p.model").isNotNull())
    mask = F.lit(0)
    for bit, (field, _) in enumerate(_MAYBE):
        mask = mask + F.when(F.col(f"p.{field}").isNotNull(), 1 << bit).otherwise(0)
    prof = prof.withColumn("mask", mask)
    found = sorted(r["mask"] for r in prof.select("mask").distinct().collect())  # 16 at most
    a, b = _sides(prof, _CORE, "mask")
    patterns = F.explode(F.array(*[F.lit(m) for m in found]))
    a, b = a.withColumnRenamed("a_mask", "k_a").withColumn("k_b", patterns), b.withColumnRenamed("b_mask", "k_b").withColumn("k_a", patterns)
    both = F.col("k_a").bitwiseAND(F.col("k_b"))

    def keyed(df: DataFrame, side: str) -> DataFrame:
        df, texts = df.filter("k_a <= k_b"), [F.col(f"{side}_p.model")]
        for bit, (field, width) in enumerate(_MAYBE):
            value, shared = F.col(f"{side}_p.{field}"), both.bitwiseAND(F.lit(1 << bit)) != 0
            if width is None:
                texts.append(F.when(shared, value))
            elif side == "a":
                df = df.withColumn(f"k_{field}", F.when(shared, F.floor(value / width)).otherwise(0))
            else:
                df = df.withColumn(f"k_{field}", F.explode(F.when(shared, _cells(value, 1, width)).otherwise(F.array(F.lit(0).cast("bigint")))))
        return df.withColumn("k_texts", F.xxhash64(*texts))

    on = ["k_a", "k_b", "k_texts", *[f"k_{field}" for field, width in _MAYBE if width]]
    met = in_blocks(keyed(a, "a"), keyed(b, "b"), on)
    once = (F.col("k_a") < F.col("k_b")) | (F.col("a_first_seq") < F.col("b_first_seq"))
    met = met.filter(once & identical(F.col("a_p"), F.col("b_p")))
    swap = F.col("a_first_seq") > F.col("b_first_seq")
    ordered = lambda side, other: [
        F.when(swap, F.col(f"{other}_{c}")).otherwise(F.col(f"{side}_{c}")).alias(f"{side}_{c}") for c in ("pid", "first_seq", "p")
    ]
    return met.select(*ordered("a", "b"), *ordered("b", "a")).select(*PAIR_COLUMNS)


def match_edges(prof: DataFrame, params: MatchParams | None = None) -> DataFrame:
    """(a, b, forward, backward): value-based matches between profiles.

    ``forward`` is the decision with a as representative and b as newcomer.
    Equal reg-nos and VINs are not paired up here; they stay keys.  Only the
    variant's points depend on the direction; pairs that no variant can bring
    over the gate go before texts are compared.
    """
    params = params or MatchParams()
    a, b = F.col("a_p"), F.col("b_p")
    narrow = lambda pairs, base: pairs.select(
        "a_pid", "b_pid", "a_first_seq", "b_first_seq", a.variant.alias("a_variant"), b.variant.alias("b_variant"),
        sure_kind(a, b).alias("sure"), base.alias("base"),
    )
    pairs = narrow(score_pairs(prof, params), base_points(a, b, params)).unionByName(
        narrow(identical_pairs(prof).filter(~in_score_route(a, b, params)), F.lit(None).cast("int"))  # sure without points
    )
    pairs = pairs.filter(F.col("sure").isNotNull() | (F.col("base") + VARIANT_POINTS[0][1] >= params.score_gate))
    pairs = materialize(pairs, "match-pairs")
    least = F.when(F.col("sure").isNotNull(), None)  # the similarity that reaches the gate
    for similarity, points in reversed(VARIANT_POINTS):
        least = least.when(F.col("base") + points >= params.score_gate, similarity)
    x, y = F.col("a_variant"), F.col("b_variant")
    both = with_ratio(with_ratio(pairs, x, y, least, "r_fwd"), y, x, least, "r_bwd")
    points = lambda r: F.least(F.lit(100), F.col("base") + variant_points(F.col(r)))
    verdict = lambda r: _verdict(F.col("sure"), points(r), F.lit("fingerprint"), params)
    both = both.withColumns({"fwd": verdict("r_fwd"), "bwd": verdict("r_bwd")})
    return both.filter(F.col("fwd.matches") | F.col("bwd.matches")).select(
        F.col("a_pid").alias("a"), F.col("b_pid").alias("b"),
        F.col("fwd.matches").alias("forward"), F.col("bwd.matches").alias("backward"),
        "fwd", "a_first_seq", "b_first_seq",
    )


def shared_key_links(prof: DataFrame) -> DataFrame:
    """Links from each profile to the first one with the same reg-no or VIN.

    A star per value: linear in the number of profiles however hot the value.
    """
    keyed = prof.select(
        "pid", "first_seq",
        F.explode(
            F.concat(
                F.when(F.col("p.reg").isNotNull(), F.array(F.concat(F.lit("r:"), F.col("p.reg"))))
                .otherwise(F.array().cast("array<string>")),
                F.coalesce(F.transform("p.vins", lambda v: F.concat(F.lit("v:"), v)),
                           F.array().cast("array<string>")),
            )
        ).alias("key"),
    )
    root = keyed.groupBy("key").agg(
        F.min_by("pid", "first_seq").alias("root"), F.count("*").alias("n")
    ).filter("n > 1")
    return keyed.join(root, "key").select("key", F.col("root").alias("a"), F.col("pid").alias("b"))
