"""Source mixing against a sort by hash."""

import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from pricelode.llm import source_mix as sm

COLUMNS = "doc_id long, text string, source string, size string, target long"


def targets(sizes, weights, ceiling):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while len(full) < len(order):
        left = total - sum(ceiling * sizes[s] for s in full)
        share = {s: left * weight[s] / sum(weight[x] for x in order if x not in full) for s in order if s not in full}
        more = {s for s in share if share[s] >= ceiling * sizes[s]}
        if not more:
            return share | {s: float(ceiling * sizes[s]) for s in full}
        full |= more
    return {s: float(ceiling * sizes[s]) for s in full}


def brute(rows, weights=sm.WEIGHTS, ceiling=sm.CEILING):
    size = lambda text: len((text or "").split())
    sizes, by_hash = defaultdict(int), defaultdict(lambda: defaultdict(int))
    digest = lambda i: int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)
    for i, text, source in rows:
        sizes[source] += size(text)
        by_hash[source][digest(i)] += size(text)
    aims, last, whole = targets(sizes, weights, ceiling), {}, {}
    for s in sizes:
        whole[s] = int(aims[s] // sizes[s]) if sizes[s] else 0
        budget, last[s] = aims[s] - whole[s] * sizes[s], -1
        if budget <= 0:
            continue
        for h in sorted(by_hash[s]):
            if by_hash[s][h] > budget:
                last[s] = h if by_hash[s][h] - budget < budget else h - 1
                break
            budget -= by_hash[s][h]
    return [(i, size(t), sizes[s], round(aims[s], 6), size(t) * (whole[s] + (digest(i) <= last[s]))) for i, t, s in rows]


def rows_of(seed, n=400):
    rnd = random.Random(seed)
    names = ["hot"] * 5 + ["a", "B", "ä", "", None, "tiny", "none"]
    out = []
    for i in range(n):
        s = rnd.choice(names)
        out.append((i, rnd.choice([None, "", " \n"]) if s == "none" or rnd.random() < 0.1 else "w " * rnd.randrange(1, 9 if s != "tiny" else 2), s))
    return [*out, (n, "big " * 500, "hot"), (None, "a b", "a"), out[5], out[5]]


def test_against_a_sort(spark):
    for seed in (1, 2):
        rows = rows_of(seed)
        df = spark.createDataFrame([(i, t, s, "clash", 1) for i, t, s in rows], COLUMNS).repartition(6)
        made = sm.mixture(df, sm.word_count(F.col("text")))
        assert made.columns == ["row", "size", "source_size", "target", "copies"]
        got = [(r.row.doc_id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in made.collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)
        by_source = defaultdict(lambda: [0, 0.0])
        for r in made.collect():
            by_source[r.row.source][0] += r.size * r.copies
            by_source[r.row.source][1] = r.target
            assert r.copies <= 3
        assert all(abs(taken - aim) <= 250 for taken, aim in by_source.values())
        out = sm.mixed(df, sm.word_count(F.col("text")))
        assert out.columns == df.columns and out.count() == sum(r.copies for r in made.collect())


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert sm.mix_query(empty).count() == 0
    silent = spark.createDataFrame([(1, None, None, "", 0), (2, "", "x", "", 0)], COLUMNS)
    assert [(r.size, r.source_size, r.target, r.taken) for r in sm.mix_query(silent).collect()] == [(0, 0, 0.0, 0)] * 2
    one = spark.createDataFrame([(i, "w " * 5, "only", "", 0) for i in range(9)], COLUMNS)
    assert all(r.taken == 5 for r in sm.mix_query(one).collect())
    same = spark.createDataFrame([(7, "w " * 5, "only", "", 0)] * 9, COLUMNS)
    assert sum(r.taken for r in sm.mix_query(same).collect()) == 45
