"""Line dedup by site-relative frequency.

Pages are grouped by host.  For every line the pages of the host that contain it are divided by all pages of the host; lines
above a boilerplate ratio are dropped from the host's pages.

A page counts a line once.  Lines are compared without spaces, tabs and carriage returns at their ends; blank lines stay.
Counting is one aggregation by (host, line digest) with map-side sums, so a hot host or line does not gather in a task.  A host
cannot have more such lines than its mean number of lines a page divided by the ratio, whatever its size; so they fit an array
per host, and the table of hosts is joined back (Spark broadcasts it only below its own size threshold).

Null texts stay null and have no lines; an empty text is one blank line; a null host is a host; repeated rows are pages of
their own unless pages are counted by distinct text; further columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelode.llm.common import materialize

RATIO = 0.1
MIN_PAGES = 3


def host_of(url: Column) -> Column:
    """Host of a url, lower case."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(F.btrim(line, F.lit(" \t\r")).cast("binary")))


def _blank(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r")) == ""


def boilerplate(pages: DataFrame, site: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, by_text: bool = False) -> DataFrame:
    """(site, lines): digests of the lines that stand on over ``ratio`` of the site's pages, and on ``min_pages`` at least.

    ``by_text``: pages of a site with equal texts are one page, so a group of copies cannot make its own lines frequent.
    """
    rows = pages.select(F.to_json(F.struct(site.alias("s"))).alias("site"), F.col(f"`{text}`").alias("text"))
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col("text")), lambda x: ~_blank(x)), _digest))
    rows = rows.select("site", "text", distinct.alias("lines"))
    if by_text:
        digest = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")
        rows = materialize(rows.select("site", digest, "lines").groupBy("site", "digest").agg(F.first("lines").alias("lines")), "site-pages")
    totals = rows.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    counts = (
        rows.select("site", F.explode("lines").alias("line"))
        .groupBy("site", "line").agg(F.count(F.lit(1)).alias("n"))
        .filter(F.col("n") >= min_pages)
    )
    frequent = counts.join(totals, "site").filter(F.col("n") > ratio * F.col("pages"))
    return materialize(frequent.groupBy("site").agg(F.collect_list("line").alias("lines")), "site-lines")


def drop_lines(pages: DataFrame, site: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, by_text: bool = False) -> DataFrame:
    """``pages`` with ``text`` cut, plus ``__n_lines`` and ``__n_dropped``."""
    bad = boilerplate(pages, site, text, ratio, min_pages, by_text).withColumnRenamed("site", "__site").withColumnRenamed("lines", "__bad")
    body = F.col(f"`{text}`")
    lines = _lines(body)
    kept = F.filter(lines, lambda x: _blank(x) | ~F.array_contains("__bad", _digest(x)))
    joined = pages.withColumn("__site", F.to_json(F.struct(site.alias("s")))).join(bad, "__site", "left")
    cut = joined.withColumn("__kept", F.when(F.col("__bad").isNotNull(), kept))
    return (
        cut.withColumn("__n_lines", F.coalesce(F.size(lines), F.lit(0)).cast("long"))
        .withColumn("__n_dropped", F.coalesce(F.size(lines) - F.size("__kept"), F.lit(0)).cast("long"))
        .withColumn(text, F.when(F.col("__n_dropped") > 0, F.array_join("__kept", "\n")).otherwise(body))
        .drop("__site", "__bad", "__kept")
    )


def lines_query(documents: DataFrame) -> DataFrame:
    """The source of a document is its site."""
    cut = drop_lines(documents.select("doc_id", "source", "text"), F.col("source"))
    return cut.select(
        "doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("text_sha256")
    )


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """Pipeline stage: every document, its text without the boilerplate lines of its source; copies are not removed yet, so they count once."""
    cut = drop_lines(docs, F.col("source"), by_text=True)
    return cut.withColumn("n_chars", F.when(F.col("__n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


LINES_SQL = f"""
WITH pieces AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL
), trimmed AS (
  SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS body FROM pieces
), totals AS (
  SELECT source, count(*) AS pages FROM documents GROUP BY source
), bad AS (
  SELECT c.source, c.body FROM (
    SELECT source, body, count(DISTINCT doc_id) AS n FROM trimmed WHERE body <> '' GROUP BY source, body
  ) c JOIN totals t ON c.source IS NOT DISTINCT FROM t.source
  WHERE c.n >= {MIN_PAGES} AND c.n > {RATIO}::DOUBLE * t.pages
), marked AS (
  SELECT t.*, b.body IS NOT NULL AS dropped FROM trimmed t
  LEFT JOIN bad b ON t.source IS NOT DISTINCT FROM b.source AND t.body = b.body
)
SELECT d.doc_id, coalesce(m.n_lines, 0) AS n_lines, coalesce(m.n_dropped, 0) AS n_dropped,
  CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(m.kept, '')) END AS text_sha256
FROM documents d LEFT JOIN (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
    string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped) AS kept
  FROM marked GROUP BY doc_id
) m ON d.doc_id = m.doc_id
"""
