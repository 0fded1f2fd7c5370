"""Numbers in texts at the edges of 64 bits."""

from pricelode.functions.text import digits, norm_text
from pyspark.sql import functions as F


def test_digits_cast_only_what_fits(spark, monkeypatch):
    want = {
        "": 0, "no digits": 0, "000": 0, "12 345 kr": 12345, "0" * 30 + "7": 7, "9223372036854775807": 2**63 - 1,
        "9223372036854775808": 0, "000-9223372036854775807": 2**63 - 1, "9" * 19: 0, "1" * 25: 0, "١٢": 0,
    }
    df = spark.createDataFrame([(t,) for t in want], "t string")
    got = df.select("t", digits(F.col("t")).alias("n")).collect()
    assert {r.t: r.n for r in got} == want
    # A cast that fails raises inside Spark, at many times the cost of a good one: a plain cast shows that none is reached.
    monkeypatch.setattr(type(F.lit(1)), "try_cast", lambda self, kind: self.cast(kind))
    assert {r.t: r.n for r in df.select("t", digits(F.col("t")).alias("n")).collect()} == want


def test_norm_text_folds_what_is_not_ascii(spark):
    df = spark.createDataFrame([("VÄRMARE & Tak-box",), ("Plain  A/B",), ("ﬁn ½",), (None,)], "t string")
    assert [r[0] for r in df.select(norm_text(F.col("t"))).collect()] == ["varmare och tak box", "plain a b", "fin 1 2", ""]


def test_body_words_are_looked_for_before_their_patterns(spark):
    """the letters that ``(?iu)`` takes for ASCII ones pass the cheap test; words inside others are no body words."""
    from pricelode.functions import text

    cases = {
        "Volvo TOURİNG": "Touring", "tourıng": "Touring", "Kombi": "Kombi", "ſedan": "Sedan", "CROſS \n country": "Cross Country",
        "suvar, SUV": "SUV", "atouring kombis": None, "Sedan kombi": "Kombi", "": None, None: None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, want string").withColumn("got", text.body_type(F.col("t")))
    assert [r for r in df.collect() if r.got != r.want] == []
    plan = df._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "contains" in plan  # before: five patterns over every page
