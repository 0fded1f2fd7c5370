"""Listing sources and their union."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.functions.text import blank_to_null, strip
from pricelode.operators.clean import fill_from_text
from pricelode.schema import conform

_JSON_SCHEMA = "subject string, body string, share_url string, url string, price struct<value:double>"


def union_sources(sources: dict[str, DataFrame], active: list[str]) -> DataFrame:
    """Active sources below each other; ``source_rank`` keeps their order.

    Names without a table are skipped, missing columns become null.
    """
    parts = [
        sources[name].withColumn("source_rank", F.lit(rank))
        for rank, name in enumerate(active) if name in sources
    ]
    if not parts:
        raise ValueError("no active source has a table")
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _short_variant(title: Column) -> Column:
    lowered = F.lower(title)
    return F.when(F.contains(lowered, F.lit("t6")), "T6 AWD").when(F.contains(lowered, F.lit("t8")), "T8 AWD")


def json_listings(raw: DataFrame, source: str, column: str = "raw") -> DataFrame:
    """JSON records as listings; unreadable records and those without a price drop out."""
    df = raw.withColumn("j", F.from_json(column, _JSON_SCHEMA)).filter(
        F.col("j").isNotNull() & (F.col("j.price.value") != 0)
    )
    title = F.coalesce("j.subject", F.lit(""))
    body = F.coalesce("j.body", F.lit(""))
    has = lambda word: F.contains(F.lower(body), F.lit(word))
    out = df.withColumns(
        {
            "source": F.lit(source),
            "url": F.coalesce(blank_to_null(F.col("j.share_url")), F.col("j.url")),
            "price": F.col("j.price.value"),
            "variant": _short_variant(title),
            "gearbox": F.lit("Automat"),
            "damaged": has("skadad") | has("rep-objekt"),
            "imported": has("import"),
        }
    )
    out = fill_from_text(out, F.concat_ws(" ", title, body)).drop("j", column)
    return conform(out)


def template_cards(pages: DataFrame, source: str) -> DataFrame:
    """Cards marked by class names; cards without a price drop out."""
    def by_class(name: str) -> Column:
        body = F.regexp_extract(
            "piece", rf"""(?is)class\s*=\s*["'][^"']*\b{name}\b[^"']*["'][^>]*>(.*?)</""", 1
        )
        return strip(F.regexp_replace(body, r"<[^>]*>", ""))

    split = F.split("html", r"""(?i)(?=<[a-z]+[^>]*class\s*=\s*["'][^"']*\bad-card\b)""")
    parts = pages.select("page_id", F.posexplode(split).alias("pos", "piece")).filter(
        F.col("piece").rlike(r"""(?i)^<[a-z]+[^>]*class\s*=\s*["'][^"']*\bad-card\b""")
    )
    price = F.regexp_replace(by_class("ad-price"), r"\D", "").try_cast("double")
    out = parts.select(
        "page_id", "pos", F.lit(source).alias("source"), by_class("ad-title").alias("_title"),
        price.alias("price"),
        blank_to_null(F.regexp_extract("piece", r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"']*)["']""", 1)).alias("url"),
    ).filter(F.col("price") != 0)
    out = out.withColumns(
        {"variant": _short_variant(F.col("_title")), "gearbox": F.lit("Automat"), "damaged": F.lit(False)}
    )
    return conform(fill_from_text(out, F.col("_title")).drop("_title"))


