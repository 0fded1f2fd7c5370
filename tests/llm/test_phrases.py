"""Prefix-free parsing and collocations against plain counts."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from pricelode.llm import phrase_parse as pp

COLUMNS = "doc_id long, text string, lang string, phrase string, n long, chunk int"


def pieces(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [[w for w in re.split(r"[ \t]+", p) if w] for p in re.split(r"[.,;:!?\x0A-\x0D]", low)]


def brute(rows, least, top, percent):
    counts = defaultdict(Counter)
    for text, lang in rows:
        for words in pieces(text):
            for k in (1, 2, 3):
                counts["und" if lang is None else lang].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in counts.items():
        n = sum(c for p, c in f.items() if len(p) == 1)
        able = [p for p in f if len(p) > 1 and f[p] >= least]
        gone = {q for p in able if len(p) == 3 for q in (p[:2], p[1:]) if q in f and 100 * f[p] >= percent * f[q]}
        rows = []
        for p in able:
            if p in gone:
                continue
            score, _, l, r = min((1000000 * f[p] ** 2 // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -f[p], " ".join(p).encode(), l, r))
        for rank, (s, a, p, l, r) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -s))
    return sorted(out)


def corpus(seed, n=250):
    rnd = random.Random(seed)
    words = ["New", "york", "ÄÖ", "äö", "漢", "a-b", "x y", "\x00", "it's"] + [f"w{i}" for i in range(25)]
    rows = []
    for _ in range(n):
        parts = rnd.choices(words, k=rnd.randrange(0, 70))
        text = "".join(w + rnd.choice([" ", " ", " ", "  ", "\t", ", ", ".", "\n", "\r\n"]) for w in parts)
        rows.append((rnd.choice([None, "", " . "]) if rnd.random() < 0.1 else text, rnd.choice(["en", "en", "en", "de", None, ""])))
    return rows + [rows[3]] * 30 + [("go go go go go " * 900, "en"), ("long" * 9000 + " tail", "de")]


@pytest.mark.parametrize("trigger", [1, 2, 16])
def test_chunks_own_every_word_once(monkeypatch, trigger):
    monkeypatch.setattr(pp, "TRIGGER", trigger)
    monkeypatch.setattr(pp, "RUN", 7)
    data = [(t or "").encode() for t, _ in corpus(4)]
    text, again, chunks = pp.parse(data)
    got, want = Counter(), Counter()
    for t, a, c in zip(text.tolist(), again.tolist(), chunks):
        words = c.split(b" ")
        assert len(words) > a
        for k in (1, 2, 3):
            got.update((t, *words[e - k + 1 : e + 1]) for e in range(max(a, k - 1), len(words)))
    for t, x in enumerate(data):
        for words in pieces(x.decode()):
            for k in (1, 2, 3):
                want.update((t, *(w.encode() for w in words[i : i + k])) for i in range(len(words) - k + 1))
    assert got == want


@pytest.mark.parametrize("bits", [1 << 26, 1 << 16])
def test_against_plain_counts(spark, monkeypatch, bits):
    monkeypatch.setattr(pp, "FILTER_BITS", bits)
    monkeypatch.setattr(pp, "SLICE", 5000)
    monkeypatch.setattr(pp, "BLOCK", 3000)
    rows = corpus(8)
    df = spark.createDataFrame([(i, t, g, "clash", 1, 2) for i, (t, g) in enumerate(rows)], COLUMNS).repartition(5)
    for least, top in ((3, 40), (10, 2000)):
        got = sorted(tuple(r) for r in pp.collocations(df, least, top).collect())
        assert got == brute(rows, least, top, 50)


def test_exact_scores_beyond_64_bits(spark):
    big = 3_000_000_017
    counts = spark.createDataFrame([(big, big + 4, big + 9)], "a long, l long, r long")
    got = counts.selectExpr(pp.SCORE + " AS score").first()[0]
    assert got == 1000000 * big * big // ((big + 4) * (big + 9))


def test_awkward_tables(spark):
    empty = spark.createDataFrame([], COLUMNS)
    assert pp.phrase_query(empty).count() == 0
    silent = spark.createDataFrame([(1, None, None, "", 0, 0), (2, " .,\n", "en", "", 0, 0)], COLUMNS)
    assert pp.phrase_query(silent).count() == 0


def test_word_hashes_depend_on_the_bytes_alone():
    rnd = random.Random(3)
    words = [rnd.randbytes(rnd.choice([1, 2, 5, 63, 64, 65, 300, 9000])).translate(None, b" \t\n.,;:!?\v\f\r") or b"x" for _ in range(500)]
    for k in (1, 7):
        found = pp.Words(np.frombuffer(b" ".join(words * k) + b"\n", np.uint8)).hash.tolist()
        assert found == found[: len(words)] * k
        assert len(set(found)) == len(set(words))
