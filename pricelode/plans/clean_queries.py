"""Queries over requirements, free text, pages and sources."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelode.config import WATCH_LIST, RequirementParams, WatchRule
from pricelode.functions import text
from pricelode.functions.flags import is_true
from pricelode.operators import clean, extract
from pricelode.session import materialize, scratch_path
from pricelode.sources import observation_log, records
from pricelode.sources.tables import listings, read_table

_BRANDS = tuple((f"Brand#{i}", (rf"\bbrand#{i}\b",)) for i in range(1, 21))
WATCH = (
    WatchRule("acme", "economy", "Acme", "Economy", 1996, 2000, _BRANDS),
    WatchRule("acme", "small", "Acme", "Small", 1997, 2001, _BRANDS),
)
REQUIREMENTS = RequirementParams(watch_list=WATCH, year_min=1995, year_max=1999, mileage_max=9600)
# Words of the documents stand in for variant patterns, most specific first.
TEXT_RULE = WatchRule(
    "acme", "doc", "Acme", "Doc", 0, 9999,
    (("both", (r"\bthe\b", r"\band\b")), ("article", (r"\bthe\b",)), ("und", (r"\bund\b",))),
)
V60 = WATCH_LIST[0]
BMW = WATCH_LIST[2]
# The watched models with years of the sales lines.
OLD_CARS = RequirementParams(
    watch_list=tuple(replace(r, year_min=1996, year_max=2000) for r in (V60, BMW)), year_min=1996, year_max=2000, mileage_max=9600
)


def documents(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "documents").select("doc_id", "text")


def pages(spark: SparkSession, root: str) -> DataFrame:
    return read_table(spark, root, "pages")


# --- pages derived from sales lines -------------------------------------------------


def _sales(spark: SparkSession, root: str) -> DataFrame:
    """Sales lines with the names of their parts."""
    lines = read_table(spark, root, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    part = read_table(spark, root, "part").select("p_partkey", "p_name")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey"))


def _lines(spark: SparkSession, root: str) -> DataFrame:
    # Dealt by order behind the join: the pages made from a line are far larger and dearer than the line and need not move.
    return _described(_sales(spark, root).repartition("l_orderkey"))


def _described(lines: DataFrame) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    return lines.withColumns(
        {
            "cents": cents,
            "id": F.concat_ws("-", "l_partkey", "l_suppkey", cents),
            "year": F.year("l_shipdate"),
            "km": (F.col("l_quantity") * 240).cast("int"),
            "kr": F.floor("l_extendedprice").cast("bigint"),
        }
    )


def _spaced(col):
    """Thousands parted by a no-break space, as on web pages."""
    return F.translate(F.format_number(col, 0), ",", " ")


def search_pages(spark: SparkSession, root: str) -> DataFrame:
    """A search page per order: an image link and a labelled card for each line."""
    df = _lines(spark, root)
    link = F.concat(F.lit("/objekt/"), F.col("id"))
    dealer = F.when(F.col("l_suppkey") % 11 == 0, "SÅLD Bil AB").otherwise("Bil & Co")
    model = F.element_at(F.array(*[F.lit(v) for v in ("T6 AWD", "T8 AWD", "B4")]), F.col("l_linenumber") % 3 + 1)
    price = F.when(F.col("l_suppkey") % 7 == 0, F.lit("<b>Ring oss</b>")).otherwise(
        F.concat(F.lit("<b>Kontantpris</b>"), _spaced(F.col("kr")), F.lit(" kr"))
    )
    card = F.concat(
        F.lit('<a href="'), link, F.lit('"><img src="x.jpg"></a><div><a class="t" href="'), link,
        F.lit('"><i>Plats:</i> Växjö <i>Återförsäljare:</i>'), dealer, F.lit("<h2>Volvo V60 "), model, F.lit(" "),
        F.col("p_name"), F.lit("</h2><i>Fuel Type:</i>Hybrid<i>Mätarställning:</i>"), _spaced(F.col("km")),
        F.lit(" mil<i>Model Year:</i>"), F.col("year"), F.lit("<i>Gearbox Type:</i>"),
        F.when(F.col("l_suppkey") % 3 == 0, "Manuell ").otherwise("Automatisk"), price, F.lit("</a></div>"),
    )
    return df.select(F.col("l_orderkey").alias("page_id"), F.struct("l_linenumber", "id").alias("o"), card.alias("card")).groupBy(
        "page_id"
    ).agg(F.concat(
        F.lit("<html><body>"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "card"))), lambda x: x.card), ""),
        F.lit("</body></html>"),
    ).alias("html"))


def detail_pages(spark: SparkSession, root: str, url=None, sold: DataFrame | None = None) -> DataFrame:
    """A detail page per line, in several layouts, some without a price; from the lines ``sold`` where they are at hand."""
    df = _lines(spark, root) if sold is None else _described(sold)
    kind = F.col("l_linenumber") % 4
    price = (
        F.when(kind == 0, F.concat(F.lit("<p>Pris</p><p>"), _spaced(F.col("kr")), F.lit(" kr</p>")))
        .when(kind == 1, F.concat(F.lit("<p>PRIS (inkl. moms) "), _spaced(F.col("kr")), F.lit(" kr</p>")))
        .when(kind == 2, F.concat(F.lit("<p>Pris</p>\n <p>"), F.col("kr").cast("string"), F.lit("kr</p>")))
        .otherwise(F.lit("<p>Ring för pris</p>"))
    )
    mil = F.when(
        F.col("l_suppkey") % 2 == 0, F.concat(F.lit("<dt>Mil</dt><dd>"), _spaced(F.col("km")), F.lit("</dd>"))
    ).otherwise(F.concat(F.lit("<dt>Mil "), F.col("km").cast("string"), F.lit(" 1:a regdatum</dt>")))
    owners = F.when(
        F.col("l_partkey") % 3 > 0,
        F.concat(F.lit("<dt>Antal ägare</dt><dd>"), (F.col("l_partkey") % 3).cast("string"), F.lit("</dd>")),
    ).otherwise("")
    reg = F.concat(F.lit("ABC"), F.lpad((F.col("cents") % 1000).cast("string"), 3, "0"))
    where = F.col("l_partkey") % 6
    reg_html = (
        F.when(where == 0, F.concat(F.lit("<p>Registreringsnummer saknas i annonsen</p><p>"), F.repeat(F.lit("utan nummer "), F.lit(15)),
                                F.lit("</p><p>Regnr | "), reg, F.lit("</p>")))
        .when(where == 1, F.concat(F.lit("<dl><dt>Registreringsnummer</dt><dd>"), F.substring(reg, 1, 3), F.lit(" "),
                                   F.substring(reg, 4, 3), F.lit("</dd></dl>")))
        .when(where == 2, F.concat(F.lit('<div data-regnr="'), F.lower(reg), F.lit('">x</div>')))
        .when(where == 3, F.concat(F.lit('<script type="application/ld+json">{"x":1,"a":{"Registration-Number":"'), reg,
                                   F.lit('"}}</script>')))
        .when(where == 4, F.concat(F.lit("<p>Kod "), reg, F.lit("</p>")))
        .otherwise("")
    )
    body = F.element_at(
        F.array(*[F.lit(b) for b in ("Touring", "cross  country", "KOMBI", "Sedan", "suv", "Coupé")]),
        (F.col("l_suppkey") % 6 + 1).cast("int"),
    )
    extra = F.when(F.col("l_suppkey") % 5 == 0, "<p>Detta är ett Auktionsobjekt</p>").otherwise("")
    html = F.concat(
        F.lit("<html><head><style>p{}</style></head><body>"), price, F.lit("<dl>"), mil, owners, F.lit("</dl>"),
        reg_html, F.lit("<p>"), body, F.lit("</p>"), extra, F.lit("</body></html>"),
    )
    return df.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "id").alias("page_id"),
        (F.concat(F.lit("https://x.example/"), F.col("id")) if url is None else url).alias("url"), html.alias("html"),
    )


def _slug_href(site: str = ""):
    words = F.element_at(
        F.array(*[F.lit(w) for w in ("530-e-xdrive-touring", "530e-xdrive", "530-e-x-drive-m-sport", "530e-touring", "520d")]),
        (F.col("l_linenumber") % 5 + 1).cast("int"),
    )
    return F.concat(
        F.when(F.col("l_suppkey") % 2 == 0, site).otherwise("https://y.example"),
        F.lit("/bil/BMW-"), words, F.lit("-"), F.col("year"), F.lit("-kombi-"), F.col("l_partkey"),
    )


def slug_pages(spark: SparkSession, root: str, sold: DataFrame | None = None) -> DataFrame:
    """A result page per order with one slug link per line, repeats included; from the lines ``sold`` where they are at hand."""
    df = _lines(spark, root) if sold is None else _described(sold.repartition("l_orderkey"))
    a = F.concat(F.lit('<a class="x" href="'), _slug_href(), F.lit('">bil</a> <a href="/om-oss">om</a>'))
    return df.select(F.col("l_orderkey").alias("page_id"), F.struct("l_linenumber", "id").alias("o"), a.alias("a")).groupBy(
        "page_id"
    ).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "a"))), lambda x: x.a), "\n").alias("html"))


# --- queries -----------------------------------------------------------------------


def _violations(spark, root):
    return clean.with_violations(listings(spark, root), REQUIREMENTS).select(
        "listing_id", F.array_join("violations", "; ").alias("violations")
    )


def _requirements(spark, root):
    return clean.meets_requirements(listings(spark, root), REQUIREMENTS).select("listing_id")


def _variant(spark, root):
    return documents(spark, root).select("doc_id", clean.variant_of(F.col("text"), TEXT_RULE).alias("variant"))


def _flags(spark, root):
    df = listings(spark, root)
    words = F.element_at(
        F.array(*[F.lit(w) for w in ("hyrbil", "Volvo SELEKT", "18,8 kWh", "dragkrok", "Kupévärmare", "inget")]),
        (F.col("owners") % 6 + 1),
    )
    unknown = F.col("seq.k4") % 2 == 0
    df = df.withColumns({c: F.when(~unknown, F.col(c)) for c in ("certified", "big_battery", "tow_hook", "heater")})
    return clean.fill_from_text(df, F.concat_ws(" ", "trim", words)).select(
        "listing_id", "rental", "certified", "big_battery", "tow_hook", "heater"
    )


def _truth(spark, root):
    conv = read_table(spark, root, "conversations")
    word = F.element_at(
        F.array(*[F.lit(w) for w in (" Ja", "NEJ ", "0", "1", "", "none", "x")]),
        ((F.col("conv_id") + F.col("turn")) % 7 + 1).cast("int"),
    )
    return conv.select(
        "conv_id", "turn", is_true(word, "string").alias("from_text"), is_true(F.col("turn") % 2, "bigint").alias("from_number")
    )


def _page_scan(spark, root):
    return pages(spark, root).select("page_id", "url", F.length("html").alias("n_chars"))


def _links(spark, root):
    return extract.links(pages(spark, root), r'href="/[^"]+', "https://base.example ")


def _cards(spark, root):
    found = extract.cards(search_pages(spark, root), V60, "https://w.example")
    return found.select(
        "page_id", "url", text.strip(F.col("place")).alias("place"), "dealer", text.strip(F.col("title")).alias("title"),
        "fuel", text.digits(F.col("mileage")).alias("mileage"), "year", "gearbox", text.digits(F.col("price")).alias("price"),
    )


def _card_listings(spark, root):
    found = extract.cards(search_pages(spark, root), V60, "https://w.example")
    return extract.card_listings(found, V60, "w").select(
        "page_id", "url", "variant", "model_year", "mileage", "price", "gearbox", "trim", "place", "dealer"
    )


def _unparsed(spark, root):
    html = search_pages(spark, root)
    base = "https://w.example"
    return extract.link_statistics(extract.links(html, base=base), extract.cards(html, V60, base))


def _unparsed_list(spark, root):
    html = search_pages(spark, root)
    base = "https://w.example"
    return extract.unparsed_links(extract.links(html, base=base), extract.cards(html, V60, base)).select("page_id", "url")


def _slugs(spark, root):
    return extract.slugs(slug_pages(spark, root), BMW, "https://b.example").filter("variant is not null").select(
        "page_id", "url", "listing_id", "slug_text", "model_year", "variant", "needs_body_check"
    )


def _slug_listings(spark, root):
    """Result pages to finished listings, over the detail pages of their links."""
    base = "https://b.example"
    sold = materialize(_sales(spark, root), "sales")  # read for the links, for the pages' urls and for the pages
    sheets = detail_pages(spark, root, _slug_href(base), sold)
    rows = extract.slug_listings(extract.slugs(slug_pages(spark, root, sold), BMW, base), sheets, BMW, "b")
    return extract.complete(rows, OLD_CARS).select(
        "page_id", "listing_id", "url", "variant", "model_year", "mileage", "price", "owners", "auction", "body", "tow_hook", "trim"
    )


def _card_source(spark, root):
    """Search pages to finished listings."""
    found = extract.cards(search_pages(spark, root), V60, "https://w.example")
    return extract.complete(extract.card_listings(found, V60, "w"), OLD_CARS, "full_title").select(
        "page_id", "url", "variant", "model_year", "mileage", "price", "tow_hook", "heater", "certified", "rental"
    )


def _rejected(spark, root):
    parsed = extract.slugs(slug_pages(spark, root), BMW, "https://b.example")
    return extract.rejected_slugs(parsed).select(
        "page_id", "n_ids", "n_kept", F.coalesce(F.array_join("sample", "|"), F.lit("")).alias("sample")
    )


def _facts(spark, root):
    return extract.detail_facts(detail_pages(spark, root)).select(
        "page_id", "price", "mileage", "owners", "auction", "body"
    )


def _detail_join(spark, root):
    """Candidates of the lines against pages by part: many share a page."""
    sheets = detail_pages(spark, root)
    key = F.regexp_extract("url", r"example/(\d+)-", 1)
    sheets = sheets.withColumn("url", F.concat(F.lit("https://x.example/"), key))
    cand = _lines(spark, root).select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "id").alias("candidate"),
        F.concat(F.lit("https://x.example/"), F.col("l_partkey")).alias("url"),
    )
    out = extract.detail_join(cand, sheets)
    return out.select("candidate", "price", "mileage")


def _regno(spark, root):
    flat = F.replace(extract.page_lines(F.col("html")), F.lit("\n"), F.lit(" "))
    # The one-element explode keeps the optimizer from repeating the text step in every use.
    sheets = detail_pages(spark, root).select("page_id", "html", F.explode(F.array(flat)).alias("flat"))
    return sheets.select("page_id", extract.regno(F.col("html"), F.col("flat")).alias("reg_no"))


def _valid_regno(spark, root):
    df = read_table(spark, root, "orders")
    raw = F.concat(
        F.lit(" aåö"), F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise(""),
        (F.col("o_orderkey") % 2000).cast("string"), F.when(F.col("o_orderkey") % 3 == 0, "b").otherwise(""),
    )
    return df.select("o_orderkey", text.valid_regno(raw).alias("reg_no"))


def _body(spark, root):
    return detail_pages(spark, root).select("page_id", text.body_type(extract.page_lines(F.col("html"))).alias("body"))


def _body_rule(spark, root):
    facts = extract.detail_facts(detail_pages(spark, root))
    return facts.select("page_id", extract.body_matches(F.col("body"), F.col("mentions_body"), BMW).alias("accepted"))


def _tokens(spark, root):
    df = read_table(spark, root, "part")
    raw = F.concat(F.lit("BMW 530 E "), F.col("p_name"), F.lit(" 330  e 1530 e"))
    return df.select("p_partkey", text.join_model_tokens(raw).alias("joined"))


def _digits(spark, root):
    df = listings(spark, root)
    return df.select("listing_id", text.digits(F.col("listing_id")).alias("number"), text.digits(F.col("trim")).alias("none"))


def _sold(spark, root):
    return documents(spark, root).select(
        "doc_id", extract.sold(F.concat(F.when(F.col("doc_id") % 3 == 0, "SÅLT ").otherwise("salt "), F.col("text"))).alias("sold")
    )


def _gearbox(spark, root):
    return listings(spark, root).select("listing_id", text.gearbox(F.concat(F.lit(" "), F.col("gearbox"), F.lit("sk "))).alias("gearbox"))


def _coverage(spark, root):
    return extract.coverage(extract.detail_facts(detail_pages(spark, root)))


def _template(spark, root):
    df = _lines(spark, root)
    html = F.concat(
        F.lit('<ul><li class="big ad-card"><a href="/a/'), F.col("id"), F.lit('"><h3 class="ad-title">Volvo '),
        F.when(F.col("l_linenumber") % 2 == 0, "T6").otherwise("t8"), F.lit(' Dragkrok</h3></a><span class="ad-price">'),
        F.when(F.col("l_suppkey") % 4 == 0, "ring").otherwise(F.concat(_spaced(F.col("kr")), F.lit(" kr"))),
        F.lit('</span></li></ul>'),
    )
    sheets = df.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "id").alias("page_id"), html.alias("html"))
    return records.template_cards(sheets, "t").select("page_id", "url", "price", "variant", "tow_hook", "rental")


def _json(spark, root):
    df = _lines(spark, root)
    raw = F.to_json(F.struct(
        F.concat(F.lit("Volvo "), F.when(F.col("l_linenumber") % 2 == 0, "T6").otherwise("D4")).alias("subject"),
        F.concat(F.col("p_name"), F.when(F.col("l_suppkey") % 6 == 0, " Rep-objekt, IMPORT").otherwise(" med dragkrok")).alias("body"),
        F.when(F.col("l_suppkey") % 4 > 0, F.struct(F.col("kr").cast("double").alias("value"))).alias("price"),
        F.concat(F.lit("https://j.example/"), F.col("id")).alias("url"),
    ))
    raw = F.when(F.col("l_suppkey") % 9 == 0, F.substring(raw, 1, 20)).otherwise(raw)
    rows = df.select(F.concat_ws("-", "l_orderkey", "l_linenumber", "id").alias("record_id"), raw.alias("raw"))
    return records.json_listings(rows, "j").select(
        "record_id", "url", "price", "variant", "damaged", "imported", "tow_hook", "rental"
    )


def _union(spark, root):
    df = listings(spark, root)
    parts = {f"s{i}": df.filter(F.col("source") == f"s{i}") for i in range(4)}
    parts["s1"] = parts["s1"].drop("owners")
    return records.union_sources(parts, ["s2", "missing", "s0", "s1"]).select("listing_id", "source", "source_rank", "owners")


def _log_round_trip(spark, root):
    df = listings(spark, root)
    folder = scratch_path(spark, "log")
    recs = observation_log.listing_records(df, F.lit("2001-07-01 00:30:00").cast("timestamp"))
    observation_log.append(recs, folder)
    return observation_log.scan_log(spark, folder).select(
        "kind", "listing_key", "model", "variant", "model_year", "mileage", "price", "trim", "tow_hook", "heater", "url"
    )


def _log_scan(spark, root):
    """Log lines with blank, broken and non-object lines among them."""
    folder = scratch_path(spark, "log-text")
    ev = read_table(spark, root, "events")
    good = F.to_json(F.struct(
        F.lit("annons").alias("kind"), F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        F.col("event_id").cast("string").alias("listing_key"), F.col("value").alias("price"),
    ))
    kind = F.col("event_id") % 10
    line = F.when(kind == 3, "").when(kind == 5, F.substring(good, 1, 25)).when(kind == 7, "[1, 2]").otherwise(good)
    ev.select(line.alias("value")).write.text(folder)
    return observation_log.scan(spark, folder).select("kind", "listing_key", "price", F.unix_timestamp("ts").alias("epoch"))


def _valuation_log(spark, root):
    from pricelode.plans.valuation_queries import valued

    folder = scratch_path(spark, "value-log")
    recs = observation_log.valuation_records(valued(spark, root), F.lit("2001-07-01 00:30:00").cast("timestamp"))
    observation_log.append(recs, folder)
    return observation_log.scan_log(spark, folder).select(
        "kind", "listing_key", "asking_price", "market_value", "diff", "n_comparables", "basis_strength"
    )


QUERIES = {
    "requirement_violations": _violations,
    "requirement_filter": _requirements,
    "variant_of_text": _variant,
    "flags_from_text": _flags,
    "truth_values": _truth,
    "page_scan": _page_scan,
    "page_links": _links,
    "labelled_cards": _cards,
    "card_listings": _card_listings,
    "link_statistics": _unparsed,
    "unparsed_links": _unparsed_list,
    "slug_parse": _slugs,
    "slug_listings": _slug_listings,
    "card_source": _card_source,
    "rejected_slugs": _rejected,
    "detail_facts": _facts,
    "detail_join": _detail_join,
    "regno_extraction": _regno,
    "regno_validation": _valid_regno,
    "body_type": _body,
    "body_requirement": _body_rule,
    "model_tokens": _tokens,
    "digits": _digits,
    "sold_filter": _sold,
    "gearbox": _gearbox,
    "field_coverage": _coverage,
    "template_cards": _template,
    "json_listings": _json,
    "source_union": _union,
    "listing_log": _log_round_trip,
    "valuation_log": _valuation_log,
    "log_scan": _log_scan,
}
