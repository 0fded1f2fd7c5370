"""Interning by open addressing and importance resampling against plain Python."""

import hashlib
import math
import random
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
import xxhash

from pricelode.llm import gram_table, target_resample as tr

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
COLUMNS = "doc_id long, text string, bucket string, weight int"


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def brute(rows, target, percent, least, seed, buckets):
    count = lambda texts: Counter(crc32(f.encode()) % buckets for t in texts for f in features(t)[1])
    raw, aim = count(t for _, t in rows), count(target)
    gain = [
        math.floor(1000 * math.log((aim[b] + 1) * float(raw.total() + buckets) / ((raw[b] + 1) * float(aim.total() + buckets)))) for b in range(buckets)
    ]
    out = []
    for i, text in rows:
        words, found = features(text)
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[crc32(f.encode()) % buckets] for f in found)
        out.append([i, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0]))
    rank = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return [(*r, rank.get(id(r))) for r in out]


def corpus(n, seed):
    rnd = random.Random(seed)
    vocabulary = ["Alpha", "beta", "ÄRGER", "ärger", "42", "x", "漢字", "a" * 40, "b" * 40] + [f"w{i}" for i in range(60)]
    text = lambda: rnd.choice([" ", ", ", "\n", "_"]).join(rnd.choices(vocabulary, k=rnd.randrange(0, 60)))
    rows = [(i, rnd.choice([None, "", " . "]) if rnd.random() < 0.1 else text()) for i in range(n)]
    return rows + [(n + i, rows[7][1]) for i in range(20)] + [(3, rows[3][1])] * 2


def test_hash_equals_the_library():
    rnd = random.Random(5)
    data = rnd.randbytes(5000)
    start = np.array([rnd.randrange(4000) for _ in range(2000)])
    size = np.array([rnd.randrange(0, 70) for _ in range(2000)])
    got = gram_table.Ranges(np.frombuffer(data, np.uint8)).xxhash64(start, size)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n]) for a, n in zip(start, size)]


@pytest.mark.parametrize("blunt", [False, True])
def test_slots_are_distinct_bytes(monkeypatch, blunt):
    if blunt:  # all hashes collide: only the bytes tell ranges apart
        monkeypatch.setattr(gram_table.Ranges, "xxhash64", lambda self, start, size: np.full(len(start), 7, np.uint64))
    rnd = random.Random(6)
    data = bytes(rnd.choices(b"ab", k=300)) * 2
    start = np.array([rnd.randrange(500) for _ in range(400)])
    size = np.array([rnd.choice([1, 2, 7, 8, 9, 31, 32, 33, 80]) for _ in range(400)])
    slots, holder = gram_table.Ranges(np.frombuffer(data, np.uint8)).intern(start, size)
    text = [data[a : a + n] for a, n in zip(start, size)]
    assert len(set(zip(slots.tolist(), text))) == len(set(text)) == len(set(slots.tolist())) == int((holder >= 0).sum())
    assert all(text[h] == text[i] for i, h in enumerate(holder[slots].tolist()))


def test_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(tr, "BLOCK", 37)
    monkeypatch.setattr(tr, "SLICE", 3000)
    rows, target = corpus(300, 1), ["alpha beta w1 w2 w3", None, "", "w1 w2 w3 w4"]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], COLUMNS).repartition(5)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = [tuple(r) for r in tr.resample(df, aim, percent=20, min_words=20, seed=9, buckets=500).collect()]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(brute(rows, target, 20, 20, 9, 500), key=key)
    kept = tr.drawn(df, aim, percent=20, seed=9, buckets=500)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in got if r[5]}


def test_awkward_tables(spark):
    df = spark.createDataFrame([(None, "a b c", "x", 1), (1, None, None, None)], COLUMNS)
    none = df.limit(0)
    got = sorted((tuple(r) for r in tr.resample(df, none.select("text"), min_words=1, percent=100).collect()), key=str)
    assert [r[:3] + r[5:] for r in got] == [(1, 0, 0, None), (None, 3, 6, 1)]
    assert tr.resample(none, df.select("text")).count() == 0
    long_text = spark.createDataFrame([(1, "word " * 300_000, None, 1)], COLUMNS)
    assert tr.resample(long_text, none.select("text")).first()["n_features"] == 3 * 300_000 - 3
