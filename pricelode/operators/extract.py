"""Fields from page tables: links, cards, slugs, detail facts, registration numbers.

Everything is a pattern over the page text, so a page stays one row and the
work spreads with the pages.  Wide HTML columns are dropped as soon as the
fields are out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pricelode.config import (
    CARD_TRIM_LENGTH, REG_FAR, REG_KEY_WORDS, REG_KEYS, REG_LABEL, REG_NEAR, REJECTED_SAMPLE,
    RequirementParams, WatchRule,
)
from pricelode.functions.text import (
    blank_to_null,
    body_type,
    digits,
    find_regno,
    gearbox,
    join_model_tokens,
    quote_pattern,
    strip,
)
from pricelode.operators.clean import fill_from_text, meets_requirements, variant_of

OBJECT_LINK = r"/objekt/[0-9a-fA-F-]+"


# --- links and cards -----------------------------------------------------------


def links(pages: DataFrame, pattern: str = OBJECT_LINK, base: str = "") -> DataFrame:
    """(page_id, pos, url): distinct links of each page in order of first appearance."""
    found = F.array_distinct(F.regexp_extract_all("html", F.lit(pattern), F.lit(0)))
    return pages.select("page_id", F.posexplode(found).alias("pos", "link")).select(
        "page_id", "pos", F.concat(F.lit(base), F.col("link")).alias("url")
    )


def strip_tags(html: Column, gap: str) -> Column:
    return F.regexp_replace(html, r"<[^>]*>", gap)


def card_pattern(anchor: str) -> str:
    """Labels of a search card in page order around the model name (fixed values); needs the flags s and U."""
    return (
        r"Plats:(.*?)Återförsäljare:(.*?)(?:I lager)?" + quote_pattern(anchor)
        + r"(.*?)Fuel Type:(.*?)Mätarställning:([\d\s]+?)\s*milModel Year:(\d{4})"
        + r"Gearbox Type:(.*?)Kontantpris([\d\s]+?)\s*kr"
    )


def cards(pages: DataFrame, rule: WatchRule, base: str = "") -> DataFrame:
    """Search cards with all their labels, one per page and link.

    The page is cut before each object link; a card is the text from its link
    to the next.  A link met again without a readable card does not count.
    """
    pieces = F.split("html", rf"(?={OBJECT_LINK})")
    parts = pages.select("page_id", F.posexplode(pieces).alias("pos", "piece")).filter("pos > 0")
    parts = parts.withColumn("link", F.regexp_extract("piece", rf"^{OBJECT_LINK}", 0))
    text = strip_tags(F.regexp_replace("piece", r"^[^>]*>", ""), "")
    # One run of the pattern: its first match as its groups, parted by a sign that is in no page.
    whole = r"(?sU)^.*?" + card_pattern(rule.card_anchor) + r".*$"
    read = F.split(F.regexp_replace(text, whole, "\u0001" + "\u0001".join(f"${i}" for i in range(1, 9))), "\u0001")
    # The one-element explode keeps the optimizer from repeating the text step in every use.
    found = parts.filter(F.length("link") > 0).select("page_id", "pos", "link", F.explode(F.array(read)).alias("read"))
    found = found.filter(F.size("read") == 9)
    group = lambda i: F.get(F.col("read"), F.lit(i))
    found = found.select(
        "page_id", "pos", F.concat(F.lit(base), F.col("link")).alias("url"),
        group(1).alias("place"), group(2).alias("dealer"), group(3).alias("title"), group(4).alias("fuel"),
        group(5).alias("mileage"), group(6).alias("year"), group(7).alias("gearbox"), group(8).alias("price"),
    )
    first = Window.partitionBy("page_id", "url").orderBy("pos")
    return found.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")


def sold(dealer: Column) -> Column:
    return F.coalesce(dealer.rlike(r"(?iu)sål[dt]"), F.lit(False))


def card_listings(found: DataFrame, rule: WatchRule, source: str, trim_length: int = CARD_TRIM_LENGTH) -> DataFrame:
    """Cards as listings; sold ones and unknown variants are left out.

    ``trim`` shows the first ``trim_length`` characters of the title; ``full_title`` has all of it.
    """
    title = strip(F.col("title"))
    variant = variant_of(F.concat(F.lit(f"{rule.card_anchor} "), F.col("title")), rule)
    return found.filter(~sold(F.col("dealer"))).select(
        "page_id", "pos",
        F.lit(source).alias("source"),
        F.col("url"),
        F.lit(rule.make).alias("make"),
        F.lit(rule.model_slug).alias("model_slug"),
        F.lit(rule.model_slug).alias("model"),
        variant.alias("variant"),
        F.col("year").cast("int").alias("model_year"),
        digits(F.col("mileage")).alias("mileage"),
        digits(F.col("price")).cast("double").alias("price"),
        gearbox(F.col("gearbox")).alias("gearbox"),
        F.lit(False).alias("damaged"),
        blank_to_null(F.substring(title, 1, trim_length)).alias("trim"),
        blank_to_null(title).alias("full_title"),
        strip(F.col("place")).alias("place"),
        strip(F.col("dealer")).alias("dealer"),
    ).filter(F.col("variant").isNotNull())


def unparsed_links(all_links: DataFrame, parsed: DataFrame) -> DataFrame:
    """Links of a page for which no card could be read."""
    return all_links.join(parsed.select("page_id", "url"), ["page_id", "url"], "left_anti")


def link_statistics(all_links: DataFrame, parsed: DataFrame) -> DataFrame:
    """Per page: distinct links, cards read and links without a card."""
    done = parsed.select("page_id", "url", F.lit(1).alias("ok"))
    return all_links.join(done, ["page_id", "url"], "left").groupBy("page_id").agg(
        F.count("*").alias("n_links"), F.count("ok").alias("n_cards"), F.count_if(F.col("ok").isNull()).alias("n_unparsed")
    )


# --- slugs -----------------------------------------------------------------------


def slugs(pages: DataFrame, rule: WatchRule, base: str = "") -> DataFrame:
    """First link per listing id of a page, with slug words, year and variant.

    ``needs_body_check`` marks slugs that name model and drive but no body
    word; they take the rule's variant and are checked on the detail page.
    """
    pattern = rf"(?i){quote_pattern(rule.make)}-([a-z0-9-]+?)-(\d{{4}})-kombi-(\d+)"
    hrefs = F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))
    parts = pages.select("page_id", F.posexplode(hrefs).alias("pos", "href")).filter(F.col("href").rlike(pattern))
    parts = parts.select(
        "page_id", "pos", "href",
        F.regexp_extract("href", pattern, 3).alias("listing_id"),
        join_model_tokens(F.replace(F.regexp_extract("href", pattern, 1), F.lit("-"), F.lit(" "))).alias("slug_text"),
        F.regexp_extract("href", pattern, 2).cast("int").alias("model_year"),
    )
    first = Window.partitionBy("page_id", "listing_id").orderBy("pos")
    parts = parts.withColumn("rn", F.row_number().over(first)).filter("rn = 1").drop("rn")
    check = needs_body_check(F.col("slug_text"), rule)
    variant = F.when(check, F.lit(rule.body_variant)).otherwise(variant_of(F.col("slug_text"), rule))
    url = F.when(F.col("href").startswith("/"), F.concat(F.lit(base), F.col("href"))).otherwise(F.col("href"))
    return parts.select(
        "page_id", "pos", url.alias("url"), "listing_id", "slug_text", "model_year",
        variant.alias("variant"), check.alias("needs_body_check"),
    )


def needs_body_check(slug_text: Column, rule: WatchRule) -> Column:
    if not rule.body:
        return F.lit(False)
    has = lambda p: slug_text.rlike(f"(?iuU){p}")
    return has(rule.body_model_pattern) & has(rule.body_drive_pattern) & ~has(rf"\b{rule.body}\b")


def rejected_slugs(parsed: DataFrame, sample: int = REJECTED_SAMPLE) -> DataFrame:
    """Per page: ids seen, slugs kept, and the first slugs that fit no variant."""
    first = Window.partitionBy("page_id").orderBy("pos")
    few = (
        parsed.filter(F.col("variant").isNull())
        .withColumn("rn", F.row_number().over(first)).filter(F.col("rn") <= sample)
        .groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("pos", "slug_text"))).alias("s"))
        .select("page_id", F.transform("s", lambda x: x.slug_text).alias("sample"))
    )
    counts = parsed.groupBy("page_id").agg(
        F.count("*").alias("n_ids"), F.count("variant").alias("n_kept")
    )
    return counts.join(few, "page_id", "left")


# --- detail pages ------------------------------------------------------------------


def page_lines(html: Column) -> Column:
    """Visible text, one text node per line."""
    visible = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    text = F.replace(F.replace(strip_tags(visible, "\n"), F.lit("&nbsp;"), F.lit(" ")), F.lit("\u00a0"), F.lit(" "))
    return F.regexp_replace(text, r"[ \t]*\n\s*", "\n")


def _first(*options: Column) -> Column:
    return F.coalesce(*[blank_to_null(o) for o in options])


def detail_facts(pages: DataFrame, body_word: str = "touring") -> DataFrame:
    """Price, mileage, owners, auction, registration number and body of each page, and whether it says ``body_word``.

    Pages without a readable price or mileage are left out.
    """
    # The one-element explode keeps the optimizer from repeating the text step in every use.
    df = pages.select("*", F.explode(F.array(page_lines(F.col("html")))).alias("text"))
    df = df.withColumn("flat", F.replace("text", F.lit("\n"), F.lit(" ")))
    price = _first(
        F.regexp_extract("text", r"(?iuU)(?:^|\n)\s*Pris\s*(?:\([^)]*\))?\s*\n+\s*([\d\s]+)\s*kr", 1),
        F.regexp_extract("flat", r"(?iuU)Pris\s*(?:\([^)]*\))?\s*([\d\s]+?)\s*kr", 1),
    )
    mileage = _first(
        F.regexp_extract("text", r"(?iuU)(?:^|\n)\s*Mil\s*\n+\s*(\d[\d\s]*)\s*(?:\n|$)", 1),
        F.regexp_extract("text", r"(?iuU)Mil\s+([\d\s]+?)\s+1:a\s+regdatum", 1),
    )
    owners = blank_to_null(F.regexp_extract("flat", r"(?iuU)Antal\s+ägare\s+(\d+)", 1))
    keep = [c for c in pages.columns if c != "html"]
    found = F.struct(price.alias("price"), mileage.alias("mileage"))
    df = df.select("*", F.explode(F.array(found)).alias("found")).filter(
        "found.price is not null and found.mileage is not null"
    )
    return df.select(
        *keep,
        owners.try_cast("int").alias("owners"),
        F.col("text").rlike(r"(?iu)auktionsobjekt").alias("auction"),
        regno(F.col("html"), F.col("flat")).alias("reg_no"),
        body_type(F.col("flat")).alias("body"),
        F.col("flat").rlike(rf"(?iuU)\b{quote_pattern(body_word)}\b").alias("mentions_body"),
        digits(F.col("found.price")).alias("price"),
        digits(F.col("found.mileage")).alias("mileage"),
    )


def detail_join(candidates: DataFrame, pages: DataFrame, body_word: str = "touring") -> DataFrame:
    """Candidates with the facts of their page; each distinct url is read once.

    Copies of a page are dropped before the patterns run; candidates whose
    page cannot be read disappear.
    """
    wanted = pages.select("url", "page_id").join(candidates.select("url").distinct(), "url", "left_semi")
    first = wanted.groupBy("url").agg(F.min("page_id").alias("first_id"))
    # The page id is compared by its order: as a key it would move the pages by both and then once more by their url.
    is_first = (F.col("page_id") <= F.col("first_id")) & (F.col("page_id") >= F.col("first_id"))
    once = pages.join(first, "url").filter(is_first).select("url", "html").dropDuplicates(["url"])
    facts = detail_facts(once, body_word)
    return candidates.join(facts, "url")


def body_matches(body: Column, mentions: Column, rule: WatchRule) -> Column:
    """The rule's body word is on the page; rules without one accept all."""
    return F.lit(True) if not rule.body else (body.eqNullSafe(rule.body) | mentions)


def slug_listings(found: DataFrame, pages: DataFrame, rule: WatchRule, source: str) -> DataFrame:
    """Slug candidates with the facts of their detail pages, as listings.

    Candidates that need a look at the body must show the rule's body word.
    """
    known = found.filter("variant is not null")
    facts = detail_join(known, pages, rule.body or "touring")
    fits = ~F.col("needs_body_check") | body_matches(F.col("body"), F.col("mentions_body"), rule)
    return facts.filter(fits).select(
        "page_id", "pos", F.lit(source).alias("source"), "listing_id", "url", "reg_no", F.lit(rule.make).alias("make"),
        F.lit(rule.model_slug).alias("model_slug"), F.lit(rule.model_slug).alias("model"), "variant", "model_year", "mileage",
        F.col("price").cast("double").alias("price"), F.lit("Automat").alias("gearbox"), F.lit(False).alias("damaged"),
        F.col("slug_text").alias("trim"), "owners", "auction", "body",
    )


def complete(rows: DataFrame, params: RequirementParams, text: str = "trim") -> DataFrame:
    """Listings of a source with their flags from ``text``, as far as they meet the base requirements."""
    return meets_requirements(fill_from_text(rows, F.col(text)), params)


def coverage(facts: DataFrame, column: str = "reg_no") -> DataFrame:
    """Share of rows with a value in ``column``, 0 for an empty table."""
    share = F.count_if(F.col(column).isNotNull()) / F.nullif(F.count("*"), F.lit(0)) * 100
    return facts.agg(
        F.count("*").alias("n"), F.count_if(F.col(column).isNotNull()).alias("n_found"),
        F.coalesce(share, F.lit(0.0)).alias("percent"),
    )


# --- registration numbers ---------------------------------------------------------



def _key_pattern() -> str:
    """Attribute names that contain one of the keys, with or without signs between its words."""
    return "(?:" + "|".join(sorted(REG_KEYS + REG_KEY_WORDS, key=len, reverse=True)).replace("_", "[_-]?") + ")"


def regno(html: Column, flat: Column) -> Column:
    """A registration number tied to a label or key; null when there is none.

    In order: within ``REG_NEAR`` characters after any label in the visible
    text, within ``REG_FAR`` of any, in an attribute named for it, in a JSON
    block (keys compared by letters and digits only), in the raw page.
    """
    # Every label and attribute key has these letters; the patterns, which are dear, run only where they stand.
    named = lambda text: text.rlike("(?i)reg")
    windows = lambda text, n: F.regexp_extract_all(
        text, F.lit(rf"(?isuU){REG_LABEL}(?=[\s:;=\-–—]*(.{{0,{n}}}))"), F.lit(1)
    )
    first_valid = lambda found: F.get(
        F.filter(F.transform(found, find_regno), lambda v: v.isNotNull()), F.lit(0)
    )
    attributes = F.regexp_extract_all(
        html, F.lit(rf"""(?isu)\s[\w-]*{_key_pattern()}[\w-]*\s*=\s*["']([^"']*)["']"""), F.lit(1)
    )
    scripts = F.regexp_extract_all(
        html, F.lit(r"""(?is)<script\b[^>]*\btype\s*=\s*["'][^"']*json[^"']*["'][^>]*>(.*?)</script>"""), F.lit(1)
    )
    pairs = r"""(?s)"([^"]*)"\s*:\s*(?:"([^"]*)"|(-?[\w.+]+))"""
    part = lambda s, i: F.regexp_extract_all(s, F.lit(pairs), F.lit(i))
    plain_key = lambda k: F.regexp_replace(F.lower(k), "[^a-z0-9]", "")
    values = F.flatten(F.transform(scripts, lambda s: F.transform(
        F.filter(F.arrays_zip(part(s, 1), part(s, 2)), lambda p: plain_key(p["0"]).isin(*REG_KEYS)), lambda p: p["1"]
    )))
    raw = F.regexp_replace(strip_tags(html, " "), r"(?U)\s+", " ")
    return F.coalesce(
        F.when(named(flat), F.coalesce(first_valid(windows(flat, REG_NEAR)), first_valid(windows(flat, REG_FAR)))),
        F.when(named(html), first_valid(attributes)),
        first_valid(values),
        F.when(named(html), first_valid(windows(raw, REG_FAR))),
    )
