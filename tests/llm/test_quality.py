"""Robust outliers: counts against plain Python, the estimate against a direct one, planted outliers, edge inputs."""

import random
import re

import numpy as np
from pyspark.sql import types as T

from pricelode.llm import robust_outliers as ro

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def brute(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(words) - 2):
        seen.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 3)}
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_counts():
    rnd = random.Random(2)
    bits = ["a", "b", "é", "漢字", " ", " ", "\n", "\t", "\x0b", "\x1c", "\xa0", "#", "<>", "a b a b", "\r\n"]
    for _ in range(800):
        t = "".join(rnd.choice(bits) for _ in range(rnd.randrange(60)))
        assert ro.text_counts(t.encode())[:5] == brute(t), t
    long = "word " * 300_000
    assert ro.text_counts(long.encode())[:5] == (300_000, 1_200_000, 0, 0, 300_000)


def prose(rnd, n):
    return " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randrange(2, 8))) + rnd.choice(["", "", "", ","]) for _ in range(n)) + "."


def corpus():
    rnd, rows = random.Random(4), []
    for i in range(900):
        rows.append((i, prose(rnd, rnd.randrange(60, 600)), "en", "a" if i % 3 else "b", "x"))
    for i in range(900, 930):
        rows.append((i, prose(rnd, 200).upper().replace(" ", "!! "), "en", "a", "x"))
    for i in range(930, 940):
        rows.append((i, prose(rnd, 100), None, None if i % 2 else "tiny", "x"))
    rows += [(940, None, "en", "a", "x"), (941, "", "en", "a", "x"), (942, prose(rnd, 20000), "en", "a", "x"), (942, rows[0][1], "en", "a", None), (None, rows[0][1], "en", "a", None)]
    return rows


def test_planted_outliers(spark):
    got = ro.quality_query(spark.createDataFrame(corpus(), SCHEMA)).collect()
    assert len(got) == len(corpus())
    by = {r.doc_id: r for r in got}
    for i, text, *_ in corpus():
        if i is not None and i != 942:
            n, chars, symbols, dup, repeat = brute(text or "")
            r = by[i]
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, dup, repeat)
            assert r.base_failed == (n < 50 or 100 * repeat > 50 * n)
            assert not (r.base_failed and r.kept)
    assert all(by[i].kept for i in range(900)) and not any(by[i].kept for i in range(900, 930))
    assert all(by[i].kept and by[i].distance is None for i in range(930, 940)), "a pool that is too small gives no verdict"
    assert all(r.kept for r in got if r.doc_id == 942)


def test_empty_table(spark):
    assert ro.quality_query(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spark_steps_reach_the_direct_estimate(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 0.3, (3000, 5)) + np.array([1, 2, 0, 0, 3])
    x[:500] += 4
    fields = [T.StructField("grp", T.StringType()), T.StructField("tie", T.LongType()), *[T.StructField(f"x{i}", T.DoubleType()) for i in range(5)]]
    rows = spark.createDataFrame([("g", i, *map(float, r)) for i, r in enumerate(x)], T.StructType(fields))
    state = ro.group_estimates(rows, ro.Rules()).collect()[0]
    centre, cov = ro.fast_mcd(x, ro.Rules(), 0)
    assert np.allclose(state.centre, centre, atol=0.05)
    assert np.allclose(np.linalg.inv(np.array(state.inverse).reshape(5, 5)), cov, atol=0.03)
    assert np.allclose(state.centre, [1, 2, 0, 0, 3], atol=0.05)
