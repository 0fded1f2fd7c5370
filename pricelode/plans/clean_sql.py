"""SQL for the queries of :mod:`pricelode.plans.clean_queries`."""

from pricelode.plans import sql_parts as P

_LIST = f"WITH {P.LISTINGS}"
_PREP = f"WITH {P.PREPARED}"
_LINES = """WITH lines AS (SELECT *, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
  concat_ws('-', l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS id, year(l_shipdate) AS year,
  CAST(l_quantity * 240 AS INTEGER) AS km, CAST(floor(l_extendedprice) AS BIGINT) AS kr FROM lineitem JOIN part ON l_partkey = p_partkey),
firsts AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY l_orderkey, id ORDER BY l_linenumber) = 1)"""
# The first card of a link counts; a link without a price has no readable card.
_CARDS = _LINES + """, cards AS (SELECT *, 'https://w.example/objekt/' || id AS url,
  CASE WHEN l_suppkey % 11 = 0 THEN 'SÅLD Bil AB' ELSE 'Bil & Co' END AS dealer,
  CASE l_linenumber % 3 WHEN 0 THEN 'T6 AWD' WHEN 1 THEN 'T8 AWD' ELSE 'B4' END AS model FROM firsts WHERE l_suppkey % 7 <> 0)"""
_SLUGS = _LINES + """, s AS (SELECT *, CASE l_linenumber % 5 WHEN 0 THEN '530e xdrive touring' WHEN 1 THEN '530e xdrive'
    WHEN 2 THEN '530e x drive m sport' WHEN 3 THEN '530e touring' ELSE '520d' END AS slug_text,
  CASE l_linenumber % 5 WHEN 0 THEN '530-e-xdrive-touring' WHEN 1 THEN '530e-xdrive' WHEN 2 THEN '530-e-x-drive-m-sport'
    WHEN 3 THEN '530e-touring' ELSE '520d' END AS raw, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, id) AS pos FROM lines),
slugs AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY pos) = 1)"""
_BODY = """CASE l_suppkey % 6 WHEN 0 THEN 'Touring' WHEN 1 THEN 'Cross Country' WHEN 2 THEN 'Kombi' WHEN 3 THEN 'Sedan' WHEN 4 THEN 'SUV' END"""
_PAGE_ID = "concat_ws('-', l_orderkey, l_linenumber, id)"
_REG = "CASE WHEN l_partkey % 6 < 4 THEN 'ABC' || lpad(CAST(cents % 1000 AS VARCHAR), 3, '0') END"
_TXT = "lower(text)"

ORACLES = {
    "requirement_violations": f"""{_LIST} SELECT listing_id, concat_ws('; ',
        CASE WHEN model NOT IN ('economy', 'small') OR CAST(substr(variant, 7) AS INTEGER) > 20 THEN 'ogiltig variant' END,
        CASE WHEN NOT model_year BETWEEN lo AND hi THEN 'årsmodell ' || model_year || ' utanför tillåtet intervall ' || lo || '-' || hi END,
        CASE WHEN mileage > 9600 THEN 'miltal ' || mileage || ' över MAX_MIL 9600' END,
        CASE WHEN gearbox <> 'Automat' THEN 'växellåda ''' || gearbox || ''' är inte Automat' END,
        CASE WHEN damaged THEN 'markerad som skadad' END) AS violations
        FROM (SELECT *, CASE model WHEN 'economy' THEN 1996 WHEN 'small' THEN 1997 ELSE 1995 END AS lo,
          CASE model WHEN 'economy' THEN 2000 WHEN 'small' THEN 2001 ELSE 1999 END AS hi FROM listings)""",
    "requirement_filter": f"""{_LIST} SELECT listing_id FROM listings WHERE CAST(substr(variant, 7) AS INTEGER) <= 20 AND mileage <= 9600
        AND gearbox = 'Automat' AND NOT damaged AND ((model = 'economy' AND model_year BETWEEN 1996 AND 2000)
          OR (model = 'small' AND model_year BETWEEN 1997 AND 2001))""",
    "flags_from_text": f"""{_LIST} SELECT listing_id, owners % 6 = 0 AS rental,
        CASE WHEN k4 % 2 = 0 THEN owners % 6 = 1 ELSE certified END AS certified,
        CASE WHEN k4 % 2 = 0 THEN owners % 6 = 2 ELSE big_battery END AS big_battery,
        CASE WHEN k4 % 2 = 0 THEN owners % 6 = 3 ELSE tow_hook END AS tow_hook,
        CASE WHEN k4 % 2 = 0 THEN owners % 6 = 4 ELSE heater END AS heater FROM listings""",
    "truth_values": """SELECT conv_id, turn, (conv_id + turn) % 7 IN (0, 3, 6) AS from_text, turn % 2 <> 0 AS from_number FROM conversations""",
    "page_scan": "SELECT page_id, url, CAST(length(html) AS INTEGER) AS n_chars FROM pages",
    "page_links": """WITH f AS (SELECT page_id, regexp_extract_all(html, 'href="/[^"]+') AS l FROM pages),
        u AS (SELECT page_id, unnest(l) AS link, unnest(range(1, len(l) + 1)) AS i FROM f),
        d AS (SELECT page_id, link, min(i) AS i FROM u GROUP BY page_id, link)
        SELECT page_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY i) - 1 AS INTEGER) AS pos, 'https://base.example ' || link AS url FROM d""",
    "labelled_cards": f"""{_CARDS} SELECT l_orderkey AS page_id, url, 'Växjö' AS place, dealer, model || ' ' || p_name AS title, 'Hybrid' AS fuel,
        CAST(km AS BIGINT) AS mileage, CAST(year AS VARCHAR) AS year, CASE WHEN l_suppkey % 3 = 0 THEN 'Manuell ' ELSE 'Automatisk' END AS gearbox, kr AS price FROM cards""",
    "card_listings": f"""{_CARDS} SELECT l_orderkey AS page_id, url, model AS variant, CAST(year AS INTEGER) AS model_year, CAST(km AS BIGINT) AS mileage,
        CAST(kr AS DOUBLE) AS price, CASE WHEN l_suppkey % 3 = 0 THEN 'Manuell' ELSE 'Automat' END AS gearbox, model || ' ' || p_name AS trim,
        'Växjö' AS place, dealer FROM cards WHERE l_suppkey % 11 <> 0 AND model <> 'B4'""",
    "link_statistics": f"""{_LINES} SELECT l_orderkey AS page_id, count(*) AS n_links, count(*) FILTER (l_suppkey % 7 <> 0) AS n_cards,
        count(*) FILTER (l_suppkey % 7 = 0) AS n_unparsed FROM firsts GROUP BY 1""",
    "unparsed_links": f"{_LINES} SELECT l_orderkey AS page_id, 'https://w.example/objekt/' || id AS url FROM firsts WHERE l_suppkey % 7 = 0",
    "slug_parse": f"""{_SLUGS} SELECT l_orderkey AS page_id, CASE WHEN l_suppkey % 2 = 0 THEN 'https://b.example' ELSE 'https://y.example' END
          || '/bil/BMW-' || raw || '-' || year || '-kombi-' || l_partkey AS url, CAST(l_partkey AS VARCHAR) AS listing_id, slug_text,
        CAST(year AS INTEGER) AS model_year, '530e xDrive Touring' AS variant, l_linenumber % 5 IN (1, 2) AS needs_body_check
        FROM slugs WHERE slug_text <> '520d'""",
    "slug_listings": f"""{_SLUGS}, named AS (SELECT *, CASE WHEN l_suppkey % 2 = 0 THEN 'https://b.example' ELSE 'https://y.example' END
          || '/bil/BMW-' || raw || '-' || year || '-kombi-' || l_partkey AS url FROM s),
        sheet AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY url ORDER BY {_PAGE_ID}) = 1),
        hits AS (SELECT * FROM named QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_partkey ORDER BY pos) = 1)
        SELECT h.l_orderkey AS page_id, CAST(h.l_partkey AS VARCHAR) AS listing_id, h.url, '530e xDrive Touring' AS variant,
          CAST(h.year AS INTEGER) AS model_year, CAST(sheet.km AS BIGINT) AS mileage, CAST(sheet.kr AS DOUBLE) AS price,
          CAST(CASE WHEN sheet.l_partkey % 3 > 0 THEN sheet.l_partkey % 3 END AS INTEGER) AS owners, sheet.l_suppkey % 5 = 0 AS auction,
          {_BODY.replace("l_suppkey", "sheet.l_suppkey")} AS body, FALSE AS tow_hook, h.slug_text AS trim
        FROM hits h JOIN sheet USING (url) WHERE h.slug_text <> '520d' AND sheet.l_linenumber % 4 < 3
          AND (h.l_linenumber % 5 NOT IN (1, 2) OR sheet.l_suppkey % 6 = 0) AND h.year BETWEEN 1996 AND 2000 AND sheet.km <= 9600""",
    "card_source": f"""{_CARDS} SELECT l_orderkey AS page_id, url, model AS variant, CAST(year AS INTEGER) AS model_year, CAST(km AS BIGINT) AS mileage,
        CAST(kr AS DOUBLE) AS price, FALSE AS tow_hook, FALSE AS heater, FALSE AS certified, FALSE AS rental
        FROM cards WHERE l_suppkey % 11 <> 0 AND model <> 'B4' AND year BETWEEN 1996 AND 2000 AND km <= 9600 AND l_suppkey % 3 <> 0""",
    "rejected_slugs": f"""{_SLUGS} SELECT l_orderkey AS page_id, count(*) AS n_ids, count(*) FILTER (slug_text <> '520d') AS n_kept,
        repeat('520d|', CAST(least(5, count(*) FILTER (slug_text = '520d')) - 1 AS INTEGER)) || CASE WHEN count(*) FILTER (slug_text = '520d') > 0 THEN '520d' ELSE '' END AS sample
        FROM slugs GROUP BY 1""",
    "detail_facts": f"""{_LINES} SELECT {_PAGE_ID} AS page_id, kr AS price, CAST(km AS BIGINT) AS mileage,
        CAST(CASE WHEN l_partkey % 3 > 0 THEN l_partkey % 3 END AS INTEGER) AS owners, l_suppkey % 5 = 0 AS auction, {_BODY} AS body
        FROM lines WHERE l_linenumber % 4 < 3""",
    "detail_join": f"""{_LINES}, sheet AS (SELECT * FROM lines QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY {_PAGE_ID}) = 1)
        SELECT concat_ws('-', l.l_orderkey, l.l_linenumber, l.id) AS candidate, s.kr AS price, CAST(s.km AS BIGINT) AS mileage
        FROM lines l JOIN sheet s USING (l_partkey) WHERE s.l_linenumber % 4 < 3""",
    "regno_extraction": f"{_LINES} SELECT {_PAGE_ID} AS page_id, {_REG} AS reg_no FROM lines",
    "regno_validation": """SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 AND length(CAST(o_orderkey % 2000 AS VARCHAR)) = 2 THEN 'AÅÖ' || (o_orderkey % 2000) || 'B'
        WHEN o_orderkey % 3 <> 0 AND length(CAST(o_orderkey % 2000 AS VARCHAR)) = 3 THEN 'AÅÖ' || (o_orderkey % 2000) END AS reg_no FROM orders""",
    "body_type": f"{_LINES} SELECT {_PAGE_ID} AS page_id, {_BODY} AS body FROM lines",
    "body_requirement": f"{_LINES} SELECT {_PAGE_ID} AS page_id, l_suppkey % 6 = 0 AS accepted FROM lines WHERE l_linenumber % 4 < 3",
    "model_tokens": "SELECT p_partkey, 'BMW 530e ' || p_name || ' 330e 1530 e' AS joined FROM part",
    "digits": f"{_LIST} SELECT listing_id, TRY_CAST(regexp_replace(listing_id, '[^0-9]', '', 'g') AS BIGINT) AS n0, 0::BIGINT AS none FROM listings",
    "sold_filter": "SELECT doc_id, doc_id % 3 = 0 OR regexp_matches(lower(text), 'sål[dt]') AS sold FROM documents",
    "gearbox": f"{_LIST} SELECT listing_id, CASE WHEN gearbox = 'Automat' THEN 'Automat' ELSE 'Manuellsk' END AS gearbox FROM listings",
    "field_coverage": f"""{_LINES} SELECT count(*) AS n, count({_REG}) AS n_found, count({_REG}) / count(*) * 100 AS percent FROM lines WHERE l_linenumber % 4 < 3""",
    "template_cards": f"""{_LINES} SELECT {_PAGE_ID} AS page_id, '/a/' || id AS url, CAST(kr AS DOUBLE) AS price,
        CASE WHEN l_linenumber % 2 = 0 THEN 'T6 AWD' ELSE 'T8 AWD' END AS variant, TRUE AS tow_hook, FALSE AS rental FROM lines WHERE l_suppkey % 4 <> 0""",
    "json_listings": f"""{_LINES} SELECT {_PAGE_ID} AS record_id, 'https://j.example/' || id AS url, CAST(kr AS DOUBLE) AS price,
        CASE WHEN l_linenumber % 2 = 0 THEN 'T6 AWD' END AS variant, l_suppkey % 6 = 0 AS damaged, l_suppkey % 6 = 0 AS imported,
        l_suppkey % 6 <> 0 AS tow_hook, FALSE AS rental FROM lines WHERE l_suppkey % 4 <> 0 AND l_suppkey % 9 <> 0""",
    "source_union": f"""{_LIST} SELECT listing_id, source, CAST(CASE source WHEN 's2' THEN 0 WHEN 's0' THEN 2 ELSE 3 END AS INTEGER) AS source_rank,
        CASE WHEN source <> 's1' THEN owners END AS owners FROM listings WHERE source <> 's3'""",
    "listing_log": f"""{_PREP} SELECT 'annons' AS kind, listing_id AS listing_key, model, variant, model_year, mileage, price, trim, tow_hook, heater, url FROM prepared""",
    "valuation_log": f"""WITH {P.VALUED} SELECT 'marknadsvarde' AS kind, listing_id AS listing_key, price AS asking_price, market_value, diff,
        CAST(n AS INTEGER) AS n_comparables, strength AS basis_strength FROM valued""",
    "log_scan": """SELECT 'annons' AS kind, CAST(event_id AS VARCHAR) AS listing_key, value AS price, CAST(floor(epoch(ts)) AS BIGINT) AS epoch
        FROM events WHERE event_id % 10 NOT IN (3, 5, 7)""",
    "variant_of_text": r"""SELECT doc_id, CASE WHEN the AND regexp_matches(t, '(^|[^\pL\pN_])and($|[^\pL\pN_])') THEN 'both' WHEN the THEN 'article'
        WHEN regexp_matches(t, '(^|[^\pL\pN_])und($|[^\pL\pN_])') THEN 'und' END AS variant
        FROM (SELECT doc_id, lower(text) AS t, regexp_matches(lower(text), '(^|[^\pL\pN_])the($|[^\pL\pN_])') AS the FROM documents)""",
}
ORACLES["digits"] = ORACLES["digits"].replace(" AS n0,", " AS number,").replace(
    "TRY_CAST(", "coalesce(TRY_CAST(").replace(" AS BIGINT) AS number", " AS BIGINT), 0) AS number")
