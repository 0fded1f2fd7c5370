"""Listing-shaped views over star-schema tables.

They let every operator run on general priced, categorised and dated rows: a
sales line becomes a listing, a part's sales become its price observations and
an event stream becomes a daily price series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.schema import conform
from pricelode.session import materialize


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{root.rstrip('/')}/{name}.parquet")


def _cents():
    return F.round(F.col("l_extendedprice") * 100).cast("bigint")


def listings(spark: SparkSession, root: str, identifiers: bool = False, written: bool = False) -> DataFrame:
    """Sales lines as listings; ``seq`` is the total order of the input.

    With ``identifiers`` some rows carry registration or chassis numbers, so
    that the identifier routes of the matching have work to do.  With ``written``
    the joined tables are written, for plans that read the listings several times.
    """
    lines = read_table(spark, root, "lineitem").repartition("l_orderkey")  # as the join with the orders needs them
    part = read_table(spark, root, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    orders = read_table(spark, root, "orders").select("o_orderkey", "o_orderdate")
    # The orders first: the lines lie by order, so they move once more at most, for a large part table.
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(
        part, F.col("l_partkey") == F.col("p_partkey")
    )
    if written:
        joined = materialize(joined.drop("o_orderkey", "p_partkey"), "sales")
    listing_id = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", _cents())
    source = F.concat(F.lit("s"), (F.col("l_suppkey") % 4).cast("string"))
    first_reg = F.when(F.col("l_linenumber") % 3 != 0, F.date_format("o_orderdate", "yyyy-MM-dd"))
    kind = F.col("l_orderkey") % 40
    description = (
        F.when(kind == 0, "Privatleasing 4 995 kr/mån")
        .when(kind == 1, "Tidigare leasingbil med en ägare")
        .when(kind == 2, "fd leasingbil, nu privatleasing")
    )
    reg = F.when(
        F.col("l_linenumber") == 7,
        F.concat(
            F.lit("R"),
            F.chr(65 + F.col("l_orderkey") % 26),
            F.chr(65 + (F.col("l_orderkey") / 26).cast("bigint") % 26),
            F.lpad((F.col("l_orderkey") / 676).cast("bigint").cast("string"), 3, "0"),
        ),
    )
    vins = F.when(
        F.col("l_linenumber") == 6,
        F.array(F.concat(F.lit("VIN"), F.col("l_orderkey").cast("string"))),
    )
    none = F.lit(None).cast("string")
    out = joined.select(
        source.alias("source"),
        listing_id.alias("listing_id"),
        F.concat(F.lit("https://"), source, F.lit(".example/ad/"), listing_id).alias("url"),
        (reg if identifiers else none).alias("reg_no"),
        (vins if identifiers else F.lit(None).cast("array<string>")).alias("vins"),
        F.lit("acme").alias("make"),
        F.lower("p_type").alias("model_slug"),
        F.lower("p_type").alias("model"),
        F.col("p_brand").alias("variant"),
        F.year("l_shipdate").alias("model_year"),
        (F.col("l_quantity") * 240).cast("bigint").alias("mileage"),
        (F.floor(F.col("l_extendedprice") / 1000) * 4000 + 100000).cast("double").alias("price"),
        F.when(F.col("l_suppkey") % 10 == 3, "Manuell").otherwise("Automat").alias("gearbox"),
        (F.col("l_orderkey") % 50 == 7).alias("damaged"),
        (F.col("l_orderkey") % 30 == 11).alias("auction"),
        F.col("p_name").alias("trim"),
        F.col("l_linenumber").cast("int").alias("owners"),
        (F.col("l_returnflag") == "R").alias("tow_hook"),
        (F.col("l_linestatus") == "F").alias("heater"),
        (F.col("l_discount") >= 0.05).alias("certified"),
        (F.col("l_tax") >= 0.04).alias("big_battery"),
        first_reg.alias("first_registration"),
        description.alias("description"),
        F.struct(
            F.col("l_orderkey").alias("k1"),
            F.col("l_linenumber").cast("bigint").alias("k2"),
            F.col("l_partkey").alias("k3"),
            F.col("l_suppkey").alias("k4"),
            _cents().alias("k5"),
        ).alias("seq"),
    )
    return conform(out)


def part_observations(spark: SparkSession, root: str) -> DataFrame:
    """Every sale of a part as a dated price observation of that part."""
    lines = read_table(spark, root, "lineitem")
    return lines.select(
        F.lit("annons").alias("kind"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_partkey").cast("string").alias("listing_key"),
        F.floor("l_extendedprice").cast("double").alias("price"),
        F.struct(
            F.col("l_orderkey").alias("k1"),
            F.col("l_linenumber").cast("bigint").alias("k2"),
            F.col("l_suppkey").alias("k3"),
            _cents().alias("k4"),
        ).alias("seq"),
    )


def event_observations(spark: SparkSession, root: str) -> DataFrame:
    """Events as price observations of their event type."""
    events = read_table(spark, root, "events")
    return events.select(
        F.lit("annons").alias("kind"),
        F.col("ts").cast("timestamp").alias("ts"),
        F.col("event_type").alias("model"),
        F.lit(None).cast("string").alias("variant"),
        F.lit(None).cast("int").alias("model_year"),
        F.col("value").alias("price"),
    )
