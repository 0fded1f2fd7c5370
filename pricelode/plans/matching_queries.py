"""Queries over duplicate matching, grouping and merging."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricelode.config import MatchParams
from pricelode.functions import numbers, text
from pricelode.functions.similarity import text_similarity
from pricelode.operators import cluster, match
from pricelode.session import materialize
from pricelode.sources.tables import listings, read_table

PARAMS = MatchParams()
KEYS = ("k1", "k2", "k3", "k4", "k5")


def _pair_keys(a: str = "a_first_seq", b: str = "b_first_seq"):
    return [F.col(f"{a}.{k}").alias(f"a_{k}") for k in KEYS] + [F.col(f"{b}.{k}").alias(f"b_{k}") for k in KEYS]


def profiles(spark, root, identifiers: bool = True):
    found = match.profiles(match.with_profile(listings(spark, root, identifiers), PARAMS))
    return materialize(found, "profiles")


def _links(kind: str):
    def run(spark, root):
        prof = profiles(spark, root)
        links = match.shared_key_links(prof).filter(F.col("key").startswith(kind) & (F.col("a") != F.col("b")))
        seqs = prof.select("pid", "first_seq")
        a = seqs.select(F.col("pid").alias("a"), F.col("first_seq").alias("a_first_seq"))
        b = seqs.select(F.col("pid").alias("b"), F.col("first_seq").alias("b_first_seq"))
        return links.join(a, "a").join(b, "b").select(F.substring("key", 3, 100).alias("value"), *_pair_keys())

    return run


def _profile_copies(spark, root):
    return profiles(spark, root).groupBy("n").agg(F.count("*").alias("n_profiles"))


def _completeness(spark, root):
    df = listings(spark, root, True)
    return df.select("listing_id", match.completeness(df).alias("completeness"))


def _identical(spark, root):
    return match.identical_pairs(profiles(spark, root)).select(*_pair_keys())


def _identical_unknown(spark, root):
    """The same over listings that lack a year, variant, mileage or price here and there."""
    df = listings(spark, root, True)
    gaps = {"model_year": 11, "variant": 13, "mileage": 17, "price": 19}
    df = df.withColumns({c: F.when(F.col("seq.k1") % m != 3, F.col(c)) for c, m in gaps.items()})
    prof = materialize(match.profiles(match.with_profile(df, PARAMS)), "profiles")
    return match.identical_pairs(prof).select(*_pair_keys())


def _model_year(spark, root):
    """Year conflicts among pairs of the score route's blocks."""
    pairs = match.score_pairs(profiles(spark, root), PARAMS, ("price",))
    return pairs.select(
        *_pair_keys(),
        (F.col("a_p.year") == F.col("b_p.year")).alias("same_year"),
        F.rint(numbers.mileage_similarity(F.abs(F.col("a_p.mileage") - F.col("b_p.mileage"))) * 25)
        .cast("int").alias("mileage_points"),
        F.rint(numbers.price_similarity(F.abs(F.col("a_p.price") - F.col("b_p.price"))) * 3)
        .cast("int").alias("price_points"),
    )


def _scores(spark, root):
    prof = profiles(spark, root)
    texts = match.score_pairs(prof, PARAMS, ("variant",))
    pairs = match.with_decision(match.score_pairs(prof, PARAMS), PARAMS, texts=texts)
    return pairs.select(*_pair_keys(), F.col("d.score").alias("score"), F.col("d.match_type").alias("match_type"),
                        F.col("d.reason").alias("reason"), F.col("d.matches").alias("matches"))


def _edges(spark, root):
    return match.match_edges(profiles(spark, root), PARAMS).select(
        *_pair_keys(), "forward", F.col("fwd.score").alias("score"), F.col("fwd.reason").alias("reason")
    )


def _equipment(spark, root):
    fields = tuple(f"e_{c}" for c in (*match.TEXT_EQUIPMENT, *match.PLAIN_EQUIPMENT))
    pairs = match.score_pairs(profiles(spark, root), PARAMS, fields)
    same, known = match.equipment_agreement(F.col("a_p"), F.col("b_p"))
    return pairs.select(*_pair_keys(), same.alias("same"), known.alias("known"))


#: What a merged row shows of its members.
_NAMED = ("listing_id", "source", "url", "urls")


def members(spark, root, fields=None):
    return cluster.members(listings(spark, root, True), PARAMS, fields)


def _groups(spark, root):
    return members(spark, root, ("listing_id",)).select(
        "listing_id", F.array_join("group_pos", "-").alias("group_id"), "group_size", "is_rep"
    )


def _merged(spark, root):
    return cluster.merge_members(members(spark, root, _NAMED)).select(
        "listing_id", F.array_join("sources", ",").alias("sources"), F.array_join("urls", " ").alias("urls"),
        "n_duplicates", "n_duplicate_sources", "fingerprint_score", "match_type", "match_reason",
        F.array_join("duplicate_ids", ",").alias("duplicate_ids"),
    )


def _match_details(spark, root):
    rows = members(spark, root, ("listing_id", "source"))
    reps = rows.filter("is_rep and grouped").select("group_pos", F.col("listing_id").alias("rep_id"))
    return cluster.group_matches(rows).join(reps, "group_pos").select(
        F.col("rep_id").alias("listing_id"), "source", F.col("listing_id").alias("duplicate_id"), "score", "match_type", "reason",
    )


def _summary(spark, root):
    return cluster.summary(members(spark, root, ()))


def _overlap(spark, root):
    return cluster.source_overlap(cluster.merged_groups(members(spark, root, _NAMED)))


def _review(spark, root):
    return cluster.review_queue(members(spark, root, ("listing_id", "source", "model", "variant", "model_year", "mileage", "price")), PARAMS)


def _components(spark, root):
    prof = profiles(spark, root)
    edges = match.identical_pairs(prof).select(F.col("a_pid").alias("a"), F.col("b_pid").alias("b"))
    comps = cluster.connected_components(edges)
    first = prof.select("pid", "first_seq")
    named = comps.join(first, F.col("node") == F.col("pid"))
    heads = named.groupBy("component").agg(F.min("first_seq").alias("head"))
    return named.join(heads, "component").select(
        *[F.col(f"first_seq.{k}").alias(k) for k in KEYS], *[F.col(f"head.{k}").alias(f"head_{k}") for k in KEYS]
    )


def _norm_text(spark, root):
    docs = read_table(spark, root, "documents").select("doc_id", "text")
    raw = F.concat("text", F.when(F.col("doc_id") % 3 == 0, " ﬁn ½ ＡＢ ① Ⅳ").otherwise(""))
    return docs.select("doc_id", F.md5(text.norm_text(raw)).alias("digest"))


def _norm_id(spark, root):
    pages = read_table(spark, root, "pages")
    return pages.select("page_id", text.norm_id(F.col("url")).alias("norm_id"))


def _norm_variant(spark, root):
    df = read_table(spark, root, "part")
    raw = F.concat(F.lit("X-Drive & "), F.col("p_name"), F.lit(" / 4 Motion Plug-In É"), F.col("p_brand"))
    return df.select("p_partkey", text.norm_variant(raw, PARAMS.variant_rewrites).alias("norm_variant"))


def _numbers(spark, root):
    df = read_table(spark, root, "part")
    raw = F.concat(
        F.lit("kr "), F.col("p_size").cast("string"), F.lit(" "),
        F.format_string("%03d", (F.col("p_partkey") % 1000).cast("int")), F.lit(",5"),
    )
    raw = F.when(F.col("p_partkey") % 7 == 0, "okänt").otherwise(raw)
    big = F.col("p_partkey").cast("double") * 1e7 + 0.25
    return df.select(
        "p_partkey", numbers.to_number(raw).alias("number"), numbers.to_int(raw).alias("whole"),
        numbers.to_number(big).alias("from_number"), numbers.to_number(F.col("p_partkey") > 3).alias("from_flag"),
    )


def _text_similarity(spark, root):
    names = read_table(spark, root, "part").select("p_name").distinct()
    a, b = names.withColumnRenamed("p_name", "a"), names.withColumnRenamed("p_name", "b")
    # Names meet when they share a word.
    word = lambda c: F.explode(F.split(F.col(c), " "))
    pairs = a.withColumn("w", word("a")).join(b.withColumn("w", word("b")), "w").filter("a < b")
    return pairs.select("a", "b").distinct().select(
        "a", "b", F.round(text_similarity(F.col("a"), F.col("b")), 6).alias("similarity")
    )


def _similarities(spark, root):
    df = listings(spark, root)
    gap = F.col("mileage") % 400
    price_gap = F.col("price") % 7000
    return df.select(
        "listing_id",
        F.round(numbers.mileage_similarity(gap.cast("double")), 6).alias("mileage_similarity"),
        F.round(numbers.price_similarity(price_gap), 6).alias("price_similarity"),
    )


QUERIES = {
    "norm_text": _norm_text,
    "norm_id": _norm_id,
    "norm_variant": _norm_variant,
    "lenient_numbers": _numbers,
    "text_similarity": _text_similarity,
    "mileage_price_similarity": _similarities,
    "completeness": _completeness,
    "profile_copies": _profile_copies,
    "regno_links": _links("r:"),
    "vin_links": _links("v:"),
    "identical_pairs": _identical,
    "identical_pairs_unknown": _identical_unknown,
    "score_blocks": _model_year,
    "equipment_agreement": _equipment,
    "fingerprint_scores": _scores,
    "match_edges": _edges,
    "identical_components": _components,
    "duplicate_groups": _groups,
    "merged_listings": _merged,
    "match_details": _match_details,
    "duplicate_summary": _summary,
    "source_overlap": _overlap,
    "review_queue": _review,
}
