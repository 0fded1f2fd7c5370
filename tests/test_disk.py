"""What stays on disk while a query runs."""

import os
import time

import pytest
from pyspark.sql import functions as F

from pricelode import session
from pricelode.operators import cluster, extract, match
from pricelode.plans import clean_queries, stream_queries, valuation_queries
from pricelode.session import materialize, part_of, release
from test_moves import _tables


def _shuffle_files(spark):
    tops = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in tops for _, _, names in os.walk(top) for f in names if f.startswith("shuffle_")}


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_shuffle_files_go_with_their_table(spark):
    """All findings of r04: nothing reads the shuffle files of a written table."""
    was = _shuffle_files(spark)
    known = spark.conf.get(session.SHUFFLE_CLEANUP_KEY, None)
    table = materialize(spark.range(10000).repartition(4, "id"), "test")
    for _ in range(50):
        if not (left := _shuffle_files(spark) - was):
            break
        time.sleep(0.2)
    assert not left and table.count() == 10000
    assert spark.conf.get(session.SHUFFLE_CLEANUP_KEY, None) == known


def test_released_tables_are_gone(spark):
    a, b = (materialize(spark.range(3), "test") for _ in "ab")
    path = b.inputFiles()[0].removeprefix("file://").removeprefix("file:")
    release(part_of(b, b.drop("id")), None, spark.range(1))
    assert not os.path.exists(path) and a.count() == 3
    release(a, a)
    assert a._scratch not in session._made


def test_links_are_read_once(spark):
    """forming the links is most of the work."""
    n = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            n.add(batch.num_rows)
            yield batch

    links = spark.createDataFrame([("a", "b"), ("b", "c"), ("d", "d"), ("f", "e")], "a string, b string").mapInArrow(counted, "a string, b string")
    out = {r.node: r.component for r in cluster.connected_components(links).collect()}
    assert out == {"a": "a", "b": "a", "c": "a", "d": "d", "e": "e", "f": "e"} and n.value == 4


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_a_clique_leaves_a_tree(spark, kind):
    """as many links as nodes go on, not a row a pair."""
    pairs = [(f"{c}{i}", f"{c}{j}") for c in "xy" for i in range(30) for j in range(i)]
    links = spark.createDataFrame([*pairs, ("z", "z"), (None, "x1"), (None, "y1")], "a string, b string").coalesce(1)
    kept = cluster._spanning(links.select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b")))
    got = [(r.a, r.b) for r in kept.select(F.col("a").cast("string"), F.col("b").cast("string")).collect()]
    assert len(got) == 2 * 29 + 3 and set(got) >= {("z", "z"), (None, "x1"), (None, "y1")}
    joined = {frozenset(c for c in p if c) for p in got if None not in p}
    for c in "xy":
        seen = {f"{c}0"}
        for _ in range(30):
            seen |= {x for p in joined if p & seen for x in p}
        assert seen == {f"{c}{i}" for i in range(30)}


def _listings(spark):
    rows = [(i, f"id{i}", "m", "v", 2000, 1000, 100.0 + i % 2, "2000-01-01") for i in range(6)]
    df = spark.createDataFrame(rows, "seq long, listing_id string, model string, variant string, model_year int, mileage long, price double, first_registration string")
    from pricelode.schema import conform

    return conform(df)


def test_members_carry_what_is_asked_for(spark):
    """columns that a query does not show are not written and shuffled with the members."""
    df = _listings(spark)
    all_, some = cluster.members(df), cluster.members(df, fields=("listing_id",))
    assert "trim" in all_.columns and "trim" not in some.columns
    shown = ("listing_id", "group_pos", "group_size", "is_rep")
    assert sorted(map(str, all_.select(*shown).collect())) == sorted(map(str, some.select(*shown).collect()))


def test_keys_of_pairs_are_short(spark):
    """The texts of a key move once a profile, not twice."""
    prof = materialize(match.profiles(match.with_profile(_listings(spark))), "profiles")
    from pricelode.config import MatchParams

    assert dict(prof.dtypes)["pid"] == "binary"
    for pairs in (match.identical_pairs(prof), match.score_pairs(prof, MatchParams(), ("price",))):
        assert not any(k in _plan(pairs) for k in ("k_model", "k_variant", "k_first"))
        assert pairs.count() == 1


def test_texts_with_one_hash_are_no_pair(spark, monkeypatch):
    """Keys are hashes; what they stand for is compared on the pairs."""
    from pricelode.config import MatchParams

    df = _listings(spark).withColumn("model", F.when(F.col("seq") > 2, "other").otherwise("m"))
    prof = materialize(match.profiles(match.with_profile(df)), "profiles")
    monkeypatch.setattr(match.F, "xxhash64", lambda *c: F.lit(7).cast("bigint"))
    assert match.identical_pairs(prof).count() == match.score_pairs(prof, MatchParams()).count() == 2


@pytest.mark.parametrize("name", ["bargain_classes", "comparable_details", "candidate_records", "self_exclusion"])
def test_valuation_joins_its_tables_once(spark, tmp_path, name):
    """Points, basis and targets read the joined lines."""
    df = valuation_queries.QUERIES[name](spark, _tables(spark, tmp_path))
    assert "lineitem.parquet" not in _plan(df) and df.count() == (0 if name == "candidate_records" else 8)


def test_slugs_join_their_lines_once(spark, tmp_path):
    """F22."""
    assert "lineitem.parquet" not in _plan(clean_queries.QUERIES["slug_listings"](spark, _tables(spark, tmp_path)))


def test_a_detail_page_moves_once(spark, tmp_path):
    """by its url; the first of its copies is told by order."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        pages = spark.createDataFrame([(i, u, f"<p>Pris</p><p>{k} 000 kr</p><dt>Mil</dt><dd>500</dd>") for i, u, k in ((2, "u", 2), (1, "u", 1), (None, "u", 3), (1, "w", 4))], "page_id long, url string, html string")
        found = extract.detail_join(spark.createDataFrame([("u",), ("u",), ("v",)], "url string"), pages)
        plan = str(found._jdf.queryExecution().executedPlan())
        assert "hashpartitioning(url" in plan and "page_id" not in "".join(x for x in plan.splitlines() if "Exchange hashpartitioning" in x)
        assert [r.price for r in found.collect()] == [1000, 1000]
    finally:
        spark.conf.set(key, was)


def test_intake_leaves_no_tables_of_its_batches(spark, tmp_path):
    """F11."""
    before = set(session._made)
    assert stream_queries.QUERIES["stream_intake"](spark, _tables(spark, tmp_path)).count() > 0
    assert not [p for p in set(session._made) - before if "/intake-" in p or "/landing-rows-" in p]
