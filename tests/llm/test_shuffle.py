"""Exact shard sizes, gapless slots, a uniform shuffle, and the hypergeometric draw."""

import zlib
from collections import Counter

import numpy as np

from pricelode.llm import exact_shuffle as es
from pricelode.llm.common import seeded


def test_sizes_and_slots(spark):
    rows = [(i, None if i % 50 == 0 else f"é{i % 40}", "x") for i in range(1003)] + [(None, "same", "x")] * 5
    df = spark.createDataFrame(rows, "doc_id long, text string, shard string").repartition(7)
    got = es.shards_query(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    sizes = Counter(r.shard for r in got)
    assert sorted(sizes) == list(range(8)) and max(sizes.values()) - min(sizes.values()) <= 1
    for j in range(8):
        assert sorted(r.slot for r in got if r.shard == j) == list(range(sizes[j]))
    by = dict((r[0], r[1]) for r in rows)
    for r in got:
        text = (by[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(text) + 1, zlib.crc32(text), "rows", None)
    assert es.shards_query(df.limit(0)).count() == 0
    assert es.shards_query(df.limit(3)).count() == 3


def test_uniform(spark):
    df = spark.range(4000).repartition(5)
    first = {r.id: (r.shard, r.slot) for r in es.shuffle_into_shards(df, 4, seed=1).collect()}
    again = {r.id: (r.shard, r.slot) for r in es.shuffle_into_shards(df, 4, seed=2).collect()}
    for placed in (first, again):
        table = np.zeros((8, 4))
        for i, (shard, _) in placed.items():
            table[i // 500, shard] += 1
        assert ((table - 125) ** 2 / 125).sum() < 60
        slots = np.array([placed[i][1] for i in range(4000)])
        assert abs(np.corrcoef(np.arange(4000), slots)[0, 1]) < 0.06
    assert sum(first[i] == again[i] for i in range(4000)) < 20


def test_draws():
    rng = seeded(3)
    rows = np.array([es.draw_row(rng, [300, 200, 100], 60) for _ in range(2000)])
    assert (rows.sum(1) == 60).all() and np.allclose(rows.mean(0), [30, 20, 10], atol=0.4)
    left = [5, 3, 2]
    total = np.sum([es.draw_row(rng, left, m) for m in (4, 0, 6)], axis=0)
    assert total.tolist() == [5, 3, 2] and left == [0, 0, 0]


def test_large_population_follows_the_law(monkeypatch):
    rng = seeded(4)
    want = np.array([es.hypergeometric(rng, 700, 300, 100) for _ in range(3000)])
    monkeypatch.setattr(es, "NUMPY_LIMIT", 0)
    got = np.array([es.hypergeometric(rng, 700, 300, 100) for _ in range(3000)])
    assert abs(got.mean() - want.mean()) < 0.4 and abs(got.std() - want.std()) < 0.3
    assert es.hypergeometric(rng, 3, 0, 2) == 2 and es.hypergeometric(rng, 0, 3, 2) == 0
    huge = [es.hypergeometric(rng, 6 * 10**9, 4 * 10**9, 10**6) for _ in range(200)]
    assert abs(np.mean(huge) - 600_000) < 200


def test_clashing_columns_pass_through(spark):
    names = ["id", "cuts", "shard", "slot", "__row", "__pid", "__rank", "__block", "__before", "rows", "row", "a.b"]
    df = spark.createDataFrame([(i, *[f"{n}{i}" for n in names[1:]]) for i in range(40)], names).repartition(3)
    got = es.shuffle_into_shards(df, 4)
    assert got.columns == [n for n in names if n not in ("shard", "slot")] + ["shard", "slot"]
    for r in got.collect():
        assert (r["cuts"], r["__row"], r["__before"], r["a.b"]) == tuple(f"{n}{r['id']}" for n in ("cuts", "__row", "__before", "a.b"))
    assert sorted((r.shard, r.slot) for r in got.collect()) == [(j, k) for j in range(4) for k in range(10)]
