"""Repeated 400-byte strings against a table of all strings."""

import hashlib
import random

import numpy as np
import pytest

from pricelode.llm import bwt_repeats as br


def corpus(seed=3):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randrange(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(n) for n in (80, 90, 150, 400)]
    exact = ("x" * 5 + prose(200))[:400]
    out = [None, "", "short", exact + "tail", "head" + exact, exact[:399] + "#", "a" * 1500, "a" * 401, "ab" * 700 + "c" + "ab" * 300]
    for _ in range(40):
        out.append(" ".join(rnd.choice([prose(rnd.randrange(60)), rnd.choice(passages)]) for _ in range(rnd.randrange(1, 5))))
    base = prose(300).split()
    for _ in range(25):
        copy = list(base)
        for _ in range(3):
            copy[rnd.randrange(len(copy))] = word()
        out.append(" ".join(copy))
    out += [passages[3]] * 3 + [passages[2][3:] + "!", prose(900) + passages[1][:420] + passages[1]]
    return out


def test_query_against_brute_force(spark, monkeypatch):
    data = corpus()
    rows = [(i, t, "x") for i, t in enumerate(data)] + [(None, data[20], "x"), (7, data[6], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, low string")
    want = br.brute_force([(r[1] or "").encode() for r in rows])
    expected = sorted(
        ((r[0], len((r[1] or "").encode()), w[1], w[2], hashlib.sha256(w[0]).hexdigest()) for r, w in zip(rows, want)), key=str
    )
    rows_of = br.repeats_query(df).collect()
    got = sorted((tuple(r)[:5] for r in rows_of), key=str)
    assert got == expected
    assert sorted(r.text for r in rows_of) == sorted(w[0].decode("utf-8", "replace") for w in want)
    assert sum(x[2] > 0 for x in got) > 40 and sum(x[2] == 0 for x in got) > 5
    assert br.repeats_query(df.limit(0)).count() == 0


def test_long_text_in_slices(monkeypatch):
    rnd = random.Random(1)
    part = bytes(rnd.randrange(97, 123) for _ in range(700))
    data = bytes(rnd.randrange(97, 123) for _ in range(9000)) + part + b"--" + part
    whole = br.find_anchors(data)
    monkeypatch.setattr(br, "SLICE", 1000)
    cutup = br.find_anchors(data)
    for p in range(len(data) - br.LENGTH + 1):  # every string has its anchor, wherever slices end
        for found in (whole, cutup):
            assert ((found["place"] - found["far"] <= p) & (p <= found["place"] - found["near"])).sum() == 1
    assert set(zip(cutup["place"].tolist(), cutup["core"].tolist())) == set(zip(whole["place"].tolist(), whole["core"].tolist()))


@pytest.mark.parametrize("least", [1, 12])
def test_hot_cores_are_counted_in_spark(spark, monkeypatch, least):
    """No task of the merge gets a core that stands more than HOT times; the result is the same."""
    merge = br.repeated_offsets

    def watched(core, *more):
        assert np.unique(core, return_counts=True)[1].max() <= least
        return merge(core, *more)

    monkeypatch.setattr(br, "HOT", least, raising=False)
    monkeypatch.setattr(br, "repeated_offsets", watched)
    rnd = random.Random(7)
    text = lambda n: "".join(rnd.choice("abcdéfgh") for _ in range(n))
    passage = text(450)
    data = [text(rnd.randrange(500)) + passage[rnd.randrange(60) :] + text(rnd.randrange(300)) for _ in range(60)]
    data += [data[3], passage[:330] + text(200), text(300) + passage[100:], *corpus()]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in br.repeats_query(df).collect()}
    want = br.brute_force([(x or "").encode() for x in data])
    assert got == {i: (n, k, hashlib.sha256(kept).hexdigest()) for i, (kept, n, k) in enumerate(want)}


def test_slice_edges_repeat_nothing(spark, monkeypatch):
    rnd = random.Random(4)
    text = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    shared = text(700)
    data = [text(6000), text(900) + shared + text(3000), text(450) + shared + text(2000), text(1250) + shared, text(2500) + shared[:450] + text(1500)]
    monkeypatch.setattr(br, "SLICE", 1000)
    for x in data:
        assert len(set(br.find_anchors(x.encode())["place"].tolist())) == len(br.find_anchors(x.encode())["place"])
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.kept_sha256) for r in br.repeats_query(df).collect()}
    assert got == {i: (n, k, hashlib.sha256(kept).hexdigest()) for i, (kept, n, k) in enumerate(br.brute_force([x.encode() for x in data]))}
    assert got[0][0] == 0 and got[1][0] == 700 and got[4][0] == 450


def test_merge_gives_the_blocks_of_one_sort():
    rng = np.random.default_rng(2)
    group = np.sort(rng.integers(0, 4, 60))
    symbols = rng.integers(0, 2, (60, 9))
    shard = rng.integers(0, 3, 60)
    rows = [np.flatnonzero(shard == s) for s in range(3)]
    got = br.merge_shards([br.shard_columns(symbols[r], group[r]) for r in rows], [group[r] for r in rows], 9)
    order = np.concatenate(rows)
    for d in range(10):
        keys = [(int(group[i]), *symbols[i, :d].tolist()) for i in order]
        rank = {k: n for n, k in enumerate(sorted(set(keys)))}
        assert got[d].tolist() == [rank[k] for k in keys]


@pytest.mark.parametrize("n, width", [(1, 1), (7, 3), (400, 128), (129, 128), (128, 128)])
def test_sliding_least(n, width):
    x = np.random.default_rng(n).integers(0, 50, n).astype(np.uint64)
    assert br.sliding_least(x, width).tolist() == [x[i : i + width].min() for i in range(n - width + 1)]
