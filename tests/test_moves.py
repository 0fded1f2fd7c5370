"""How often rows move between tasks where no table is small enough to be sent to all of them."""

import datetime

from pricelode.plans import clean_queries
from pricelode.sources import tables


def _tables(spark, folder):
    day = datetime.datetime(1998, 2, 6)
    frame = lambda rows, schema, name: spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    frame([(o, o % 2, 3, n, 5.0, 1000.0, 0.0, 0.0, "N", "O", day) for o in range(4) for n in (1, 2)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double,"
          " l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp", "lineitem")
    frame([(p, "hot ring", "Brand#7", "LARGE") for p in (0, 1)], "p_partkey long, p_name string, p_brand string, p_type string", "part")
    frame([(o, day) for o in range(4)], "o_orderkey long, o_orderdate timestamp", "orders")
    return str(folder)


def _moves(spark, make):
    key = "spark.sql.autoBroadcastJoinThreshold"
    was = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        df = make()
        return str(df._jdf.queryExecution().executedPlan()).count("Exchange hashpartitioning"), df.count()
    finally:
        spark.conf.set(key, was)


def test_pages_of_lines_do_not_move(spark, tmp_path):
    """Lines and parts meet, then the lines go to their order; the pages are made where they are."""
    assert _moves(spark, lambda: clean_queries.search_pages(spark, _tables(spark, tmp_path))) == (3, 4)


def test_lines_stay_with_their_orders(spark, tmp_path):
    assert _moves(spark, lambda: tables.listings(spark, _tables(spark, tmp_path))) == (4, 8)


def test_regno_reads_a_page_once(spark):
    """the visible text of a page is made once, not once for each place that is searched."""
    from pricelode.plans.clean_queries import QUERIES

    plan = QUERIES["regno_extraction"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("(script|style)") == 1


def test_regno_where_the_letters_hide(spark):
    """patterns are left out only where none can match."""
    from pyspark.sql import functions as F

    from pricelode.operators import extract

    pages = {
        "<p>REGISTRERINGSNUMMER&nbsp;abc 123</p>": "ABC123",
        '<script type="application/json">{"R-e-g n.r":"def456"}</script>': "DEF456",
        '<b REGISTERNUMBER="ghö789">x</b>': "GHÖ789",
        "<p>reg</p><script>regnr: abc123</script>": "ABC123",
        "<p>re</p><p>gnr abc123</p>": None,
        "": None,
    }
    df = spark.createDataFrame([*[(k,) for k in pages], (None,)], "html string")
    flat = F.replace(extract.page_lines(F.col("html")), F.lit("\n"), F.lit(" "))
    got = {r.html: r.r for r in df.select("html", extract.regno(F.col("html"), flat).alias("r")).collect()}
    assert got == pages | {None: None}
