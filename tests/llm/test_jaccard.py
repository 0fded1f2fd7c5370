"""The near-duplicate join against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest

from pricelode.llm import bayes_jaccard as bj

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    out = []
    for g in range(25):
        base = [word() for _ in range(rnd.choice([6, 40, 120, 400]))]
        for k in range(rnd.choice([1, 2, 2, 5])):
            copy = list(base)
            for _ in range(rnd.randrange(0, 1 + len(base) // 30)):
                copy[rnd.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    hot = [word() for _ in range(200)]
    for k in range(90):
        copy = list(hot)
        copy[k * 2] = word()
        out.append(" ".join(copy))
    out += [" ".join(hot)] * 30 + ["", None, "  .", "one", "One!", "one two three four", "tail " * 20_000]
    rnd.shuffle(out)
    return [(i * 3, t, "en", "s", 1) for i, t in enumerate(out)] + [(5, out[0], "en", "s", 1), (5, out[0], "en", "s", 1), (None, out[1], "en", "s", 1)]


def brute(rows):
    sets = [frozenset(s.tolist()) for s in bj.shingles([(r[1] or "").encode() for r in rows])]
    links, parent = [0] * len(rows), list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if not sets[i] or not sets[j]:
                continue
            shared = len(sets[i] & sets[j])
            if shared >= 0.8 * (len(sets[i]) + len(sets[j]) - shared) - 1e-9:
                if sets[i] != sets[j]:
                    links[i] += 1
                    links[j] += 1
                parent[root(i)] = root(j)
    groups = defaultdict(list)
    for i, r in enumerate(rows):
        groups[root(i)].append(r[0])
    least = lambda ids: min((x for x in ids if x is not None), default=None)
    return [(r[0], None if not sets[i] else least(groups[root(i)]), links[i]) for i, r in enumerate(rows)]


@pytest.mark.parametrize("block", [512, 16])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(bj, "BLOCK", block)
    rows = corpus()
    got = sorted(((r.doc_id, r.class_id, r.n_links) for r in bj.join_query(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted(brute(rows), key=str)


def test_stage_keeps_one_of_each(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    kept = bj.keep_one(df)
    assert kept.columns == df.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    want, seen = [], set()
    for i, label, _ in sorted(brute(rows), key=lambda r: -1 if r[0] is None else r[0]):
        if label is None:
            want.append(i if i is not None else -1)
        elif label not in seen:
            seen.add(label)
            want.append(i if i is not None else -1)
    assert len(got) == len(want)
    assert bj.keep_one(df.limit(0)).count() == 0 and bj.join_query(df.limit(0)).count() == 0


def test_pruning_bounds():
    least = bj.least_matches(0.8, 1e-9)
    assert least == sorted(least) and 70 < least[-1] < 90
    rng = np.random.default_rng(0)
    same = (rng.random((20_000, bj.VALUES)) < 0.8).cumsum(1)[:, bj.STEP - 1 :: bj.STEP]
    assert (same >= np.array(least)).all()


def test_min_hash_estimates():
    a, b = np.arange(1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    from pricelode.llm.word_hash import mix

    agree = (bj.min_hash(mix(a)) == bj.min_hash(mix(b))).mean()
    assert abs(agree - 800 / 1200) < 0.15
