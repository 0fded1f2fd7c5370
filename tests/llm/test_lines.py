"""Site-relative line frequency against a plain count."""

import random
from collections import Counter

from pyspark.sql import functions as F

from pricelode.llm import site_lines as sl


def brute(rows, ratio, least):
    pages, seen = Counter(), Counter()
    trim = lambda x: x.strip(" \t\r")
    for _, site, text in rows:
        pages[site] += 1
        for line in {trim(x) for x in (text or "").split("\n")} - {""}:
            seen[site, line] += 1
    out = []
    for i, site, text in rows:
        if text is None:
            out.append((i, None))
            continue
        kept = [x for x in text.split("\n") if not trim(x) or not (seen[site, trim(x)] >= least and seen[site, trim(x)] > ratio * pages[site])]
        out.append((i, "\n".join(kept)))
    return out


def test_against_plain_count(spark):
    rnd, rows = random.Random(9), []
    lines = ["menu", " menu\t", "footer\r", "", "  ", "漢", "a" * 50_000] + [f"l{i}" for i in range(40)]
    for i in range(300):
        site = rnd.choice(["hot", "hot", "hot", "b", None, "tiny%d" % rnd.randrange(60)])
        rows.append((i, site, rnd.choice([None, "", "\n"]) if rnd.random() < 0.1 else "\n".join(rnd.choice(lines) for _ in range(rnd.randrange(1, 9)))))
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, site string, text string, line string")
    got = sl.drop_lines(df, F.col("site"), ratio=0.15, min_pages=3)
    assert set(got.columns) == {"doc_id", "site", "text", "line", "__n_lines", "__n_dropped"}
    key = lambda r: (r[0], r[1] or "")
    assert sorted([(r.doc_id, r.text) for r in got.collect()], key=key) == sorted(brute(rows, 0.15, 3), key=key)
    assert sl.drop_lines(df.limit(0), F.col("site")).count() == 0


def test_stage_updates_the_length(spark):
    rows = [(i, f"menu\nown {i}", "en", "s", 10) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sl.without_boilerplate(docs).collect()
    assert all(r.text == f"own {r.doc_id}" and r.n_chars == len(r.text) for r in got) and len(got) == 10


def test_host(spark):
    urls = ["https://Blog.x.org:80/a?b", "http://u:p@h.net#t", "nothing", None]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(sl.host_of(F.col("u"))).collect()]
    assert got == ["blog.x.org", "h.net", "", None]
