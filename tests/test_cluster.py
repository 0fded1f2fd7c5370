"""Grouping against a plain sequential fold on random small inputs."""

import random
from difflib import SequenceMatcher

import pytest

from pricelode import session
from pricelode.operators import cluster, match
from pricelode.operators.match import with_decision, with_profile
from pricelode.config import MatchParams
from pricelode.schema import LISTING, conform
from pricelode.session import materialize
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = T.StructType([*LISTING.fields, T.StructField("seq", T.LongType())])
FLAGS = ("tow_hook", "heater", "certified", "big_battery", "rental", "imported")


def make(rng, n, copies):
    base = []
    for i in range(n):
        base.append(dict(
            source=rng.choice("ab"), listing_id=f"x{i}", model=rng.choice(["v60", "v60", "v90", None]),
            variant=rng.choice(["t6 awd", "t6 awd", "t8 awd", None]), model_year=rng.choice([2023, 2023, 2024, None]),
            mileage=rng.choice([5000, 5001, 5040, 5090, 5200, None]), price=rng.choice([300000.0, 300001.0, 302000.0, None]),
            reg_no=rng.choice([None] * 5 + ["ABC123", "abc 124"]), vins=rng.choice([None, None, ["V1"], ["V2", "V1"]]),
            first_registration=rng.choice(["2023-01-01", "2023-01-01", "2023-02-02", None]),
            trim=rng.choice(["plus", "core", None]), owners=rng.choice([1, 2, None]),
            url=f"http://e/{i % 7}", **{f: rng.choice([True, False, None]) for f in FLAGS},
        ))
    rows = [dict(r) for r in base]
    for _ in range(copies):
        rows.append(dict(rng.choice(base)))
    rng.shuffle(rows)
    return [{**r, "seq": i} for i, r in enumerate(rows)]


def completeness(r):
    keys = ("reg_no", "trim", "owners", "first_registration", "listing_id", "mileage", "price", "variant",
            "model_year", "model", *FLAGS)
    return sum(r[k] not in (None, "", False, 0) for k in keys) + len(r["vins"] or [])


def norm_id(v):
    return "".join(c for c in (v or "") if c.isalnum()).upper()


def gap(a, b, k):
    return None if a[k] is None or b[k] is None else abs(a[k] - b[k])


def decide(a, b):
    ra, rb, va, vb = norm_id(a["reg_no"]), norm_id(b["reg_no"]), set(a["vins"] or []), set(b["vins"] or [])
    if ra and ra == rb:
        return 100, "regnr"
    if va & vb:
        return 100, "vin"
    wild = lambda k: a[k] is None or b[k] is None or a[k] == b[k]
    same_model = a["model"] is not None and a["model"] == b["model"]
    dm, dp = gap(a, b, "mileage"), gap(a, b, "price")
    if (same_model and wild("model_year") and wild("variant") and wild("first_registration")
            and (dm is None or dm <= 1) and (dp is None or dp <= 1) and not (ra and rb) and not (va and vb)):
        return 100, "identisk_annons"
    if not same_model:
        return 0, "olika_modell"
    if not wild("model_year"):
        return 0, "olika_arsmodell"
    score = 15 if a["model_year"] is not None and a["model_year"] == b["model_year"] else 0
    if a["variant"] and b["variant"]:
        s = 1.0 if a["variant"] == b["variant"] else SequenceMatcher(None, a["variant"], b["variant"]).ratio()
        score += next((p for t, p in ((.95, 25), (.9, 23), (.8, 18), (.7, 10), (.6, 5)) if s >= t), 0)
    if dm is not None:
        m = 1 if dm <= 50 else .95 if dm <= 100 else 0 if dm > 300 else .95 - (dm - 100) / 200 * .95
        score += round(m * 25)
    first = a["first_registration"] is not None and a["first_registration"] == b["first_registration"]
    score += 20 if first else 0
    if dp is not None:
        score += round((1 if dp <= 1000 else 0 if dp > 5000 else 1 - (dp - 1000) / 4000 * .5) * 3)
    known = [k for k in ("trim", "owners", "first_registration", *FLAGS) if a[k] is not None and b[k] is not None]
    if known:
        score += round(sum(a[k] == b[k] for k in known) / len(known) * 7)
    known = [k for k in ("owners", "tow_hook", "heater", "big_battery", "certified")
             if a[k] is not None and b[k] is not None]
    if known:
        score += round(sum(a[k] == b[k] for k in known) / len(known) * 5)
    return min(100, score), "fingerprint"


def fold(rows):
    groups = []
    for r in rows:
        for g in groups:
            score, why = decide(max(g, key=completeness), r)
            if score >= 82:
                g.append(r)
                break
        else:
            groups.append([r])
    return groups


@pytest.mark.parametrize("seed,copies", [(1, 0), (2, 40), (3, 60), (4, 200)])
def test_groups_equal_sequential_fold(spark, seed, copies):
    rows = make(random.Random(seed), 40, copies)
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    got = {
        r.seq: r for r in cluster.members(df.repartition(3)).select(
            "seq", "group_pos", "rep_pos", "group_size", "d.score", "d.reason").collect()
    }
    assert len(got) == len(rows)
    for group in fold(rows):
        rep = max(group, key=completeness)
        for r in group:
            mine = got[r["seq"]]
            assert mine.group_pos == [group[0]["seq"]]
            assert mine.rep_pos == [rep["seq"]]
            assert mine.group_size == len(group)
            if r is not rep:
                assert (mine.score, mine.reason) == decide(rep, r)


def test_merged_rows(spark):
    rows = make(random.Random(5), 30, 20)
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    merged = {r.seq: r for r in cluster.survivors(df).collect()}
    groups = fold(rows)
    assert len(merged) == len(groups)
    for group in groups:
        rep = max(group, key=completeness)
        m = merged[rep["seq"]]
        assert m.sources == sorted({r["source"] for r in group})
        assert m.urls == list(dict.fromkeys(r["url"] for r in group))
        assert m.duplicate_ids == list(dict.fromkeys(r["listing_id"] for r in group))
        assert m.n_duplicates == len(group)
        assert [x.listing_id for x in m.matches] == [r["listing_id"] for r in group if r is not rep]
        if len(group) > 1:
            best = max(decide(rep, r)[0] for r in group if r is not rep)
            assert m.fingerprint_score == best


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}") for i in range(60)] + [("z1", "z2")], "a string, b string")
    out = {r.node: r.component for r in cluster.connected_components(links).collect()}
    assert {out[f"n{i:03d}"] for i in range(61)} == {"n000"}
    assert out["z2"] == "z1"


def test_decision_edges(spark):
    """Mileage 50/100/300, price 1000/5000."""
    base = dict(model="v60", variant="t6", model_year=2023, mileage=5000, price=300000.0,
                first_registration="2023-01-01", listing_id="a", seq=0, source="a")
    variants = [dict(base, mileage=5000 + m, price=300000.0 + p, seq=1) for m in (2, 50, 51, 100, 101, 300, 301)
                for p in (2, 1000, 1001, 5000, 5001)]
    a = conform(spark.createDataFrame([tuple(base.get(f.name) for f in SCHEMA)], SCHEMA))
    b = conform(spark.createDataFrame([tuple(v.get(f.name) for f in SCHEMA) for v in variants], SCHEMA))
    params = MatchParams()
    pairs = with_profile(a, params).select(F.col("p").alias("a_p")).crossJoin(
        with_profile(b, params).select("mileage", "price", F.col("p").alias("b_p")))
    full = lambda r: {k: r.get(k) for k in ("reg_no", "vins", "trim", "owners", *FLAGS, *base)}
    for r in with_decision(pairs, params).select("mileage", "price", "d.score", "d.matches").collect():
        want = decide(full(base), full(dict(base, mileage=r.mileage, price=r.price)))[0]
        assert (r.score, r.matches) == (want, want >= 82)


def rounds(spark, nodes, accepts, places):
    """Groups by ``representative_rounds``: {position: position of the row that opened its group}."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    n = frame(nodes, "component string, pid string, n long, rank int, keys array<string>, first_pos array<long>")
    out = cluster.representative_rounds(n, frame(accepts, "rep string, pid string"), frame(places, "pid string, pos array<long>"))
    return sorted((r.pid, r.from_pos[0], r.creator_pos[0]) for r in out.collect())


def test_hot_key_is_one_group(spark):
    """50 000 profiles of one registration number are one group, led by the most complete; no Python worker holds it."""
    rng = random.Random(7)
    nodes = [("c", f"p{i}", 1, rng.randrange(15), ["r:ABC123"], [i]) for i in range(50_000)]
    got = rounds(spark, nodes, [], [])
    assert len(got) == 50_000 and {creator for _, _, creator in got} == {0}


def test_rounds_equal_sequential_fold_on_random_graphs(spark):
    """Asymmetric matches, changing representatives, copies and keys, in many components at once."""
    nodes, accepts, places, want = [], [], [], []
    for c in range(60):
        rng = random.Random(c)
        size = rng.randrange(2, 14)
        rank = [rng.randrange(4) for _ in range(size)]
        keys = [[k for k in ("k1", "k2") if rng.random() < 0.15] for _ in range(size)]
        pairs = {(a, b) for a in range(size) for b in range(size) if a == b or rng.random() < 0.35}
        order = list(range(size)) + [rng.randrange(size) for _ in range(rng.randrange(25))]
        rng.shuffle(order)
        start, groups, opened = c * 1000, [], {}
        for at, x in enumerate(order):
            meets = lambda rep: (rep, x) in pairs or set(keys[rep]) & set(keys[x])
            g = next((g for g in groups if meets(g["rep"])), None)
            if g is None:
                g = {"rep": x, "at": at}
                groups.append(g)
            elif rank[x] > rank[g["rep"]]:
                g["rep"] = x
            opened[at] = g["at"]
        name = lambda x: f"{c}-{x}"
        for x in range(size):
            own = [at for at, y in enumerate(order) if y == x]
            nodes.append((str(c), name(x), len(own), rank[x], [f"{c}{k}" for k in keys[x]], [start + own[0]]))
            places += [(name(x), [start + at]) for at in own if len(own) > 1]
            last = None
            for at in own:
                if opened[at] != last:
                    want.append((name(x), start + at, start + opened[at]))
                last = opened[at]
        accepts += [(name(a), name(b)) for a, b in pairs]
    got, last = [], (None, None)
    for pid, at, creator in rounds(spark, nodes, accepts, places):
        if (pid, creator) != last:
            got.append((pid, at, creator))
        last = (pid, creator)
    assert got == sorted(want)


def _rows_written(spark, since):
    return sum(spark.read.parquet(path).count() for path in session._made[since:])


def test_pairs_of_a_cell_are_not_written(spark):
    """300 profiles of one cell make 44 850 pairs; what goes to the shared folder grows with the profiles."""
    base = dict(model="v60", variant="t6", model_year=2023, mileage=5000, first_registration="2023-01-01", source="a")
    rows = [dict(base, listing_id=f"x{i}", price=300000.0, trim=f"t{i}", seq=i) for i in range(300)]
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    prof = materialize(match.profiles(with_profile(df)), "profiles")
    since = len(session._made)
    params = MatchParams()
    same, known = match.equipment_agreement(F.col("a_p"), F.col("b_p"))
    pairs = match.score_pairs(prof, params).select("a_first_seq", "b_first_seq", same.alias("same"), known.alias("known"))
    assert pairs.groupBy("same", "known").count().collect() == [(1, 2, 300 * 299 // 2)]
    decided = with_decision(match.score_pairs(prof, params), params).select("d.*")
    assert decided.filter("matches and score = 100 and reason = 'identisk_annons'").count() == 300 * 299 // 2
    found = match.identical_pairs(prof)
    assert found.filter("a_first_seq < b_first_seq AND a_p.price = b_p.price").count() == 300 * 299 // 2
    assert _rows_written(spark, since) < 300


def test_components_of_a_long_chain_take_few_rows(spark, monkeypatch):
    """Each round reads a fraction of the last one's links; a chain of 2 000 nodes is not walked again and again."""
    written = []

    def counted(df, label):
        out = materialize(df, label)
        written.append((label, out.count()))
        return out

    monkeypatch.setattr(cluster, "materialize", counted)
    names = [f"n{i:04d}" for i in range(2000)]
    random.Random(3).shuffle(names)
    links = spark.createDataFrame(list(zip(names, names[1:])) + [("z", "z")], "a string, b string")
    out = {r.node: r.component for r in cluster.connected_components(links).collect()}
    assert out == {**dict.fromkeys(names, "n0000"), "z": "z"}
    assert sum(n for label, n in written if label == "components-links") < 4 * 2000


def test_rounds_place_only_what_changed(spark, monkeypatch):
    """A slow chain at the end of a component does not have its 400 settled profiles placed again every round."""
    placed = []
    plain = cluster._homes
    monkeypatch.setattr(cluster, "_homes", lambda nodes, *more: placed.append(nodes.count()) or plain(nodes, *more))
    nodes = [("c", f"p{i:03d}", 1, 0, [], [i]) for i in range(410)]
    accepts = [(f"p{i:03d}", f"p{i + 1:03d}") for i in range(399, 409)] + [("p000", f"p{i:03d}") for i in range(1, 400)]
    got = rounds(spark, nodes, accepts, [])
    groups, want = [], []
    for i in range(410):
        home = next((g for g in groups if (f"p{g:03d}", f"p{i:03d}") in set(accepts)), None)
        groups += [i] if home is None else []
        want.append((f"p{i:03d}", i, i if home is None else home))
    assert got == want
    assert len(placed) > 4 and sum(placed[3:]) < 100


@pytest.mark.parametrize("fold_rows", [0, 60, 1000])
def test_components_by_rounds_and_by_fold_alike(spark, monkeypatch, fold_rows):
    """Components up to a bound are folded in one expression, larger ones go through rounds, with the same groups."""
    monkeypatch.setattr(cluster, "FOLD_ROWS", fold_rows)
    called = []
    rounds = cluster.representative_rounds
    monkeypatch.setattr(cluster, "representative_rounds", lambda *a: called.append(1) or rounds(*a))
    rows = make(random.Random(7), 30, 50) + [  # a second component of two rows
        dict(source="a", listing_id=f"z{i}", model="xc40", variant="b4", model_year=2021, mileage=100, price=1.0, vins=["V9"], url="u", seq=80 + i)
        for i in range(2)
    ]
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    got = {r.seq: (r.group_pos[0], r.group_size) for r in cluster.members(df).select("seq", "group_pos", "group_size").collect()}
    full = [{**dict.fromkeys(SCHEMA.fieldNames()), **r} for r in rows]
    assert got == {r["seq"]: (g[0]["seq"], len(g)) for g in fold(full) for r in g}
    assert bool(called) == (fold_rows < 1000)  # before: rounds for every component


def test_text_ratio_needs_no_package_at_the_workers(spark):
    """The text ratio travels by value; a function wrapped by ``lru_cache`` was looked up in the package at the worker."""
    from pricelode.functions import similarity
    from pyspark import cloudpickle

    assert b"lru_cache_wrapper" not in cloudpickle.dumps(similarity.gestalt_ratio.func)
    assert not any(hasattr(v, "cache_info") for v in similarity.gestalt_ratio.func.__globals__.values() if getattr(v, "__name__", "") == "_ratio")


def test_round_numbers_stand_in_one_cell(spark):
    """round mileages and prices stood in two cells each; a side of identical pairs was moved four times."""
    values = [100 * i for i in range(1000)]
    for _, width in match._MAYBE:
        if width:
            cells = spark.createDataFrame([(float(v),) for v in values], "v double").select(F.size(match._cells(F.col("v"), 1, width)).alias("n"))
            assert cells.agg(F.sum("n")).first()[0] < 1.2 * len(values)  # before: 1.5 to 2 cells a value
    rows = [dict(source="a", listing_id=f"x{i}", model="m", variant="v", model_year=2020, mileage=m, price=p, owners=i, seq=i)
            for i, (m, p) in enumerate([(30, 61.0), (31, 62.0), (32, 63.0), (33, 92.0), (None, 93.0)])]
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    found = match.identical_pairs(match.profiles(with_profile(df))).select("a_first_seq", "b_first_seq").collect()
    assert sorted(tuple(r) for r in found) == [(0, 1), (1, 2), (3, 4)]


def test_decision_with_a_narrow_table_of_texts(spark):
    """the dictionary of texts comes from a narrower table of the same pairs, with the same decisions."""
    rows = make(random.Random(11), 40, 0)
    df = conform(spark.createDataFrame([tuple(r.get(f.name) for f in SCHEMA) for r in rows], SCHEMA))
    prof, params = materialize(match.profiles(with_profile(df)), "profiles"), MatchParams()
    read = lambda found: sorted(map(str, found.select("a_first_seq", "b_first_seq", "d").collect()))
    plain = read(with_decision(match.score_pairs(prof, params), params))
    narrow = match.score_pairs(prof, params, ("variant",))
    assert "e_trim" not in narrow.schema["a_p"].dataType.fieldNames()
    assert plain and read(with_decision(match.score_pairs(prof, params), params, texts=narrow)) == plain
