"""The pipeline against brute-force versions of its stages, and on awkward rows."""

import re

import public_tokenizers
import sentencepiece

import corpus_pipeline
from pricelode.llm import robust_outliers
from test_decontamination import brute as contaminated
from test_jaccard import brute as near
from test_lines import brute as cut

SF = "/root/testdata/sf0.001"


def test_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    verdicts = {r.doc_id: r for r in robust_outliers.quality_query(docs).collect()}
    rows = [r for r in docs.collect() if verdicts[r.doc_id].kept]
    for r in docs.collect():  # the base rules, counted plainly
        words = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        assert len(words) >= 50 or not verdicts[r.doc_id].kept
    texts = dict(cut([(r.doc_id, r.source, r.text) for r in rows], 0.1, 3))
    grouped = near(sorted((i, t) for i, t in texts.items()))
    first = {}
    for i, label, _ in grouped:
        first.setdefault(i if label is None else label, i)
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    want = {i: library.encode(texts[i]) for i in first.values() if not any(contains(texts[i], x) for x in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(want)
    assert all(got[i].ids == want[i] and got[i].n_tokens == len(want[i]) for i in got)
    assert 20 < len(got) < len(rows)


def contains(doc, item):
    """A run of 13 equal words, or the whole of a shorter item."""
    plain = lambda t: " " + " ".join(re.findall(r"(?:[^\W_]|[^\x00-\x7f])+", t.lower())) + " "
    words = plain(item).split()
    n = min(13, len(words))
    runs = (" " + " ".join(words[k : k + n]) + " " for k in range(len(words) - n + 1))
    return len(words) >= 5 and any(x in plain(doc) for x in runs)


def test_helper_agrees():
    item = " ".join(f"w{i}" for i in range(20))
    for doc in (item, "a " + item.upper(), "w1 w2 w3", ""):
        assert contains(doc, item) == contaminated(doc, item, 13, 1.0)


def test_stages_on_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (1, "", "en", "s", 0), (None, "word " * 60, "en", None, 300), (2, "x" * 9000, "en", "s", 9000)]
    rows += [(3, " ".join(f"w{i}" for i in range(80)), "en", "s", 1)] * 2
    for data in (rows, []):
        docs = spark.createDataFrame(data, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF)
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    assert corpus_pipeline.STAGES[2][1](spark, spark.createDataFrame(rows, schema), SF).count() == 5


def test_one_of_a_large_group_of_copies_stays(spark):
    """A third of a source is one text, another source has three copies only; both texts stay whole, once."""
    text = lambda k, n: "\n".join(" ".join(f"w{k}x{i}y{j}" for j in range(10)) for i in range(n))
    rows = [(i, text(0, 6), "en", "s", 1) for i in range(20)] + [(100 + i, "menu line\n" + text(1 + i, 6), "en", "s", 1) for i in range(40)]
    rows += [(200 + i, text(99, 5), "en", "small", 1) for i in range(3)] + [(300 + i, t, "en", "dash", 1) for i in range(4) for t in ("", "-- --", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES[1:3]:
        docs = stage(spark, docs, SF)
    got = {(r.doc_id, r.text) for r in docs.collect()}
    assert docs.count() == len(got)
    want = {(0, text(0, 6)), (200, text(99, 5)), (300, ""), (300, "-- --"), (300, None)} | {(100 + i, text(1 + i, 6)) for i in range(40)}
    assert got == want
