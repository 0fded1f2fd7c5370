"""SQL for the queries of :mod:`pricelode.plans.matching_queries`."""

from pricelode.plans import sql_parts as P

_LIST = f"WITH {P.LISTINGS}"
_COMPLETE = """(CASE WHEN reg_no IS NOT NULL THEN 1 ELSE 0 END + CASE WHEN vin IS NOT NULL THEN 1 ELSE 0 END + 1 + tow_hook::INTEGER + heater::INTEGER
  + certified::INTEGER + big_battery::INTEGER + 1 + CASE WHEN first_registration IS NOT NULL THEN 1 ELSE 0 END + 1
  + CASE WHEN mileage <> 0 THEN 1 ELSE 0 END + 1 + 1 + 1 + 1)"""
_ATTRS = "model, variant, model_year, mileage, price, reg_no, vin, first_registration, trim, tow_hook, heater, certified, big_battery, owners"
_PROF = f"""{P.LISTINGS}, prof AS (SELECT {_ATTRS}, min(seq) AS seq, count(*) AS n, arg_min(k1, seq) AS k1, arg_min(k2, seq) AS k2,
  arg_min(k3, seq) AS k3, arg_min(k4, seq) AS k4, arg_min(k5, seq) AS k5, row_number() OVER (ORDER BY min(seq)) AS no FROM listings GROUP BY {_ATTRS})"""
# The earlier profile first.  Rows meet by equality only; a difference of numbers is no join condition.
_FIRST = "b.no - a.no > 0"
_KEYS = ", ".join(f"a.k{i} AS a_k{i}" for i in range(1, 6)) + ", " + ", ".join(f"b.k{i} AS b_k{i}" for i in range(1, 6))
_OUT = ", ".join(f"a_k{i}" for i in range(1, 6)) + ", " + ", ".join(f"b_k{i}" for i in range(1, 6))

_LINKS = """SELECT replace(value, '-', '') AS value, {keys} FROM (SELECT *, {col} AS value FROM prof WHERE {col} IS NOT NULL) b
  JOIN (SELECT *, {col} AS v FROM prof WHERE {col} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY {col} ORDER BY seq) = 1) a ON a.v = b.value AND a.seq <> b.seq"""

_IDENTICAL = """(a.model = b.model AND a.variant = b.variant AND a.model_year = b.model_year AND abs(a.mileage - b.mileage) <= 1
  AND abs(a.price - b.price) <= 1 AND coalesce(a.first_registration = b.first_registration, TRUE)
  AND coalesce(a.reg_no = b.reg_no, TRUE) AND coalesce(a.vin = b.vin, TRUE))"""
# Listings that lack a year, variant, mileage or price here and there, and agreement where unknown values agree with all.
_GAPS = ("model_year", 11), ("variant", 13), ("mileage", 17), ("price", 19)
_UNKNOWN = _PROF.replace("FROM listings GROUP BY", "FROM gaps GROUP BY").replace(
    ", prof AS", ", gaps AS (SELECT * REPLACE (" + ", ".join(f"CASE WHEN k1 % {m} <> 3 THEN {c} END AS {c}" for c, m in _GAPS) + ") FROM listings), prof AS")
_AGREE = """(coalesce(a.model_year = b.model_year, TRUE) AND coalesce(a.variant = b.variant, TRUE) AND coalesce(abs(a.mileage - b.mileage) <= 1, TRUE)
  AND coalesce(abs(a.price - b.price) <= 1, TRUE) AND coalesce(a.first_registration = b.first_registration, TRUE)
  AND coalesce(a.reg_no = b.reg_no, TRUE) AND coalesce(a.vin = b.vin, TRUE))"""
# Similarity of 'brand x' and 'brand y' by matching blocks: the common head plus a shared digit.
_SIM = """CASE WHEN a.variant = b.variant THEN 1.0 ELSE 2.0 * (6 + CASE WHEN contains(substr(b.variant, 7), substr(a.variant, 7, 1))
    OR (length(a.variant) = 8 AND contains(substr(b.variant, 7), substr(a.variant, 8, 1))) THEN 1 ELSE 0 END)
  / (length(a.variant) + length(b.variant)) END"""
_EQ = " + ".join(f"(a.{c} = b.{c})::INTEGER" for c in ("trim", "tow_hook", "heater", "certified", "big_battery", "owners"))
_EXTRA = " + ".join(f"(a.{c} = b.{c})::INTEGER" for c in ("owners", "tow_hook", "heater", "big_battery", "certified"))
_MIL = "CASE WHEN gap <= 50 THEN 1.0 WHEN gap <= 100 THEN 0.95 WHEN gap > 300 THEN 0.0 ELSE 0.95 - (gap - 100) / 200.0 * 0.95 END"
_PRICE = "CASE WHEN pgap <= 1000 THEN 1.0 WHEN pgap > 5000 THEN 0.0 ELSE 1.0 - (pgap - 1000) / 4000.0 * 0.5 END"
_BLOCKS = f"""{_PROF}, blocks AS (SELECT {_KEYS}, a.model_year = b.model_year AS same_year, CAST(abs(a.mileage - b.mileage) AS DOUBLE) AS gap,
    abs(a.price - b.price) AS pgap, {_SIM} AS sim, {_EQ} + 1 AS same, 7 AS known, {_EXTRA} AS extra, a.reg_no = b.reg_no AS reg, a.vin = b.vin AS vin,
    {_IDENTICAL} AS ident FROM prof a JOIN prof b ON a.model = b.model AND a.first_registration = b.first_registration
    AND a.model_year = b.model_year WHERE {_FIRST} AND abs(a.mileage - b.mileage) <= 300),
points AS (SELECT *, CAST(least(100, 15 + 20 + CASE WHEN sim >= 0.95 THEN 25 WHEN sim >= 0.90 THEN 23 WHEN sim >= 0.80 THEN 18 WHEN sim >= 0.70 THEN 10
    WHEN sim >= 0.60 THEN 5 ELSE 0 END + round_even({_MIL} * 25, 0) + round_even({_PRICE} * 3, 0) + round_even(same / known * 7, 0)
    + round_even(extra / 5.0 * 5, 0)) AS INTEGER) AS points FROM blocks),
decided AS (SELECT *, CASE WHEN reg OR vin OR ident THEN 100 ELSE points END AS score,
    CASE WHEN reg THEN 'regnr' WHEN vin THEN 'vin' ELSE 'fingerprint' END AS match_type,
    CASE WHEN reg THEN 'regnr' WHEN vin THEN 'vin' WHEN ident THEN 'identisk_annons' ELSE 'fingerprint' END AS reason,
    coalesce(reg, FALSE) OR coalesce(vin, FALSE) OR ident OR points >= 82 AS matches FROM points)"""

# The sequential grouping, one row a step in every component at once.  ``heads`` holds each group's opener, representative and
# its completeness; a row joins the first group whose representative it matches.
_GROUPED = f"""{_BLOCKS}, keyed AS (SELECT *, {_COMPLETE} AS complete FROM listings),
ids AS (SELECT *, row_number() OVER (ORDER BY seq) AS pid FROM prof),
same AS (SELECT a.seq AS x, b.seq AS y FROM prof a JOIN prof b ON a.seq < b.seq AND a.model = b.model
  AND a.variant = b.variant AND a.model_year = b.model_year AND {_IDENTICAL}),
linked AS (
  SELECT x, y FROM same
  UNION SELECT a.seq, b.seq FROM prof a JOIN prof b ON a.reg_no = b.reg_no AND a.seq < b.seq
  UNION SELECT a.seq, b.seq FROM prof a JOIN prof b ON a.vin = b.vin AND a.seq < b.seq
  UNION SELECT row(a_k1, a_k2, a_k3, a_k4, a_k5), row(b_k1, b_k2, b_k3, b_k4, b_k5) FROM decided WHERE matches),
both_ways AS (
  SELECT a.pid AS x, b.pid AS y FROM linked l JOIN ids a ON a.seq = l.x JOIN ids b ON b.seq = l.y
  UNION SELECT b.pid, a.pid FROM linked l JOIN ids a ON a.seq = l.x JOIN ids b ON b.seq = l.y
  UNION SELECT pid, pid FROM ids WHERE n > 1),
adjacent AS (SELECT x AS pid, list_distinct(list(y) || [x]) AS near FROM both_ways GROUP BY x),
reach AS (SELECT DISTINCT x AS start, x AS node FROM both_ways UNION SELECT r.start, e.y FROM reach r JOIN both_ways e ON e.x = r.node),
comps AS (SELECT start AS pid, min(node) AS comp FROM reach GROUP BY start),
seen AS (
  SELECT c.comp, i.pid, l.seq, l.listing_id, l.complete, a.near, row_number() OVER (PARTITION BY c.comp ORDER BY l.seq) AS rn
  FROM keyed l JOIN ids i ON {" AND ".join(f"l.{c} IS NOT DISTINCT FROM i.{c}" for c in _ATTRS.split(", "))}
  JOIN comps c ON c.pid = i.pid JOIN adjacent a ON a.pid = i.pid),
fold AS (
  SELECT comp, rn, seq, listing_id, seq AS opened, [{{'opened': seq, 'rep': pid, 'complete': complete}}] AS heads FROM seen WHERE rn = 1
  UNION ALL
  SELECT s.comp, s.rn, s.seq, s.listing_id, coalesce(f.heads[spot].opened, s.seq),
    CASE WHEN spot IS NULL THEN list_append(f.heads, {{'opened': s.seq, 'rep': s.pid, 'complete': s.complete}})
      WHEN s.complete > f.heads[spot].complete THEN list_transform(f.heads, lambda h: CASE WHEN h.opened = f.heads[spot].opened
        THEN {{'opened': h.opened, 'rep': s.pid, 'complete': s.complete}} ELSE h END)
      ELSE f.heads END
  FROM (SELECT f.*, s.seq AS new_seq, list_position(list_transform(f.heads, lambda h: list_contains(s.near, h.rep)), TRUE) AS spot
        FROM fold f JOIN seen s ON s.comp = f.comp AND s.rn = f.rn + 1) f JOIN seen s ON s.comp = f.comp AND s.rn = f.rn + 1),
grouped AS (SELECT k.listing_id, k.seq, k.complete, coalesce(f.opened, k.seq) AS opened FROM keyed k LEFT JOIN fold f ON f.seq = k.seq)"""

# Every row with its group, the group's final representative and the row's own match against it.
_MEMBERS = f"""{_GROUPED},
placed AS (SELECT k.*, coalesce(f.opened, k.seq) AS opened, i.pid,
    'https://' || k.source || '.example/ad/' || k.listing_id AS own_url
  FROM keyed k LEFT JOIN fold f ON f.seq = k.seq JOIN ids i ON {" AND ".join(f"k.{c} IS NOT DISTINCT FROM i.{c}" for c in _ATTRS.split(", "))}),
ranked AS (SELECT *, count(*) OVER (PARTITION BY opened) AS group_size,
    row_number() OVER (PARTITION BY opened ORDER BY complete DESC, seq) = 1 AS is_rep FROM placed),
reps AS (SELECT opened, pid AS rep_pid, listing_id AS rep_id, seq AS rep_seq FROM ranked WHERE is_rep),
scores AS (SELECT a.pid AS x, b.pid AS y, d.score, d.match_type, d.reason FROM decided d
    JOIN ids a ON a.seq = row(a_k1, a_k2, a_k3, a_k4, a_k5) JOIN ids b ON b.seq = row(b_k1, b_k2, b_k3, b_k4, b_k5)),
known AS (SELECT x, y, score, match_type, reason FROM scores UNION SELECT y, x, score, match_type, reason FROM scores),
judged AS (SELECT r.*, p.rep_id, p.rep_pid, b.model AS rep_model, b.model_year AS rep_year,
    coalesce(a.reg_no = b.reg_no, FALSE) AS by_reg, coalesce(a.vin = b.vin, FALSE) AS by_vin, r.pid = p.rep_pid OR {_IDENTICAL} AS by_values,
    k.score AS points
  FROM ranked r JOIN reps p USING (opened) JOIN ids a ON a.pid = r.pid JOIN ids b ON b.pid = p.rep_pid
    LEFT JOIN known k ON k.x = r.pid AND k.y = p.rep_pid),
members AS (SELECT *, NOT is_rep AS has_match,
    CASE WHEN is_rep THEN NULL WHEN by_reg OR by_vin OR by_values THEN 100 ELSE coalesce(points, 0) END AS score,
    CASE WHEN is_rep THEN NULL WHEN by_reg THEN 'regnr' WHEN by_vin THEN 'vin' ELSE 'fingerprint' END AS match_type,
    CASE WHEN is_rep THEN NULL WHEN by_reg THEN 'regnr' WHEN by_vin THEN 'vin' WHEN by_values THEN 'identisk_annons'
      WHEN points IS NULL AND model <> rep_model THEN 'olika_modell' WHEN points IS NULL AND model_year <> rep_year THEN 'olika_arsmodell' ELSE 'fingerprint' END AS reason
  FROM judged),
merged AS (SELECT opened, any_value(rep_id) AS listing_id, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources,
    array_to_string(list_sort(list_distinct(list(source))), ' + ') AS overlap, string_agg(own_url, ' ' ORDER BY seq) AS urls,
    count(*) AS n_duplicates, CAST(count(DISTINCT source) AS INTEGER) AS n_duplicate_sources, string_agg(listing_id, ',' ORDER BY seq) AS duplicate_ids,
    arg_min({{'score': score, 'match_type': match_type, 'reason': reason}}, row(-score, seq)) FILTER (score > 0) AS best
  FROM members GROUP BY opened)"""

ORACLES = {
    # Longest common piece first (earliest on ties), then the same to its left and right.
    "text_similarity": """WITH RECURSIVE names AS (SELECT DISTINCT p_name FROM part),
        words AS (SELECT p_name, unnest(string_split(p_name, ' ')) AS w FROM names),
        pairs AS (SELECT DISTINCT x.p_name AS a, y.p_name AS b FROM words x JOIN words y ON x.w = y.w AND x.p_name < y.p_name),
        parts AS (SELECT a, b, a AS x, b AS y, 0 AS same FROM pairs
          UNION ALL
          SELECT a, b, CASE side WHEN 0 THEN x[:c.i - 1] ELSE x[c.i + c.k:] END, CASE side WHEN 0 THEN y[:c.j - 1] ELSE y[c.j + c.k:] END,
            CASE side WHEN 0 THEN c.k ELSE 0 END
          FROM (SELECT a, b, x, y, list_sort(list_filter(flatten(list_transform(range(1, length(x) + 1), lambda i: list_transform(range(1, length(x) - i + 2),
              lambda k: {'rank': -k, 'i': i, 'k': k, 'j': strpos(y, substr(x, i, k))}))), lambda c: c.j > 0))[1] AS c FROM parts WHERE x <> '' AND y <> '') t, (VALUES (0), (1)) s(side)
          WHERE c IS NOT NULL)
        SELECT a, b, round(2.0 * sum(same) / (length(a) + length(b)), 6) AS similarity FROM parts GROUP BY a, b""",
    "merged_listings": f"""WITH RECURSIVE {_MEMBERS} SELECT listing_id, sources, urls, n_duplicates, n_duplicate_sources,
        CASE WHEN n_duplicates = 1 THEN 100 ELSE coalesce(best.score, 0) END AS fingerprint_score,
        CASE WHEN n_duplicates = 1 THEN 'unik' ELSE coalesce(best.match_type, 'fingerprint') END AS match_type,
        CASE WHEN n_duplicates = 1 THEN 'ingen_dubblett' ELSE coalesce(best.reason, 'fingerprint') END AS match_reason, duplicate_ids FROM merged""",
    "match_details": f"""WITH RECURSIVE {_MEMBERS} SELECT rep_id AS listing_id, source, listing_id AS duplicate_id, score, match_type, reason
        FROM members WHERE has_match""",
    "duplicate_summary": f"""WITH RECURSIVE {_MEMBERS}, t AS (SELECT count(*) AS before, count(*) FILTER (is_rep) AS after,
          count(*) FILTER (match_type = 'regnr') AS by_regnr, count(*) FILTER (match_type = 'vin') AS by_vin,
          count(*) FILTER (match_type = 'fingerprint') AS by_fingerprint,
          count(*) FILTER (match_type = 'fingerprint' AND score BETWEEN 95 AND 100) AS score_95_100,
          count(*) FILTER (match_type = 'fingerprint' AND score BETWEEN 90 AND 94) AS score_90_94,
          count(*) FILTER (match_type = 'fingerprint' AND score BETWEEN 85 AND 89) AS score_85_89,
          count(*) FILTER (match_type = 'fingerprint' AND score BETWEEN 82 AND 84) AS score_82_84 FROM members)
        SELECT *, before - after AS duplicates, round_even((before - after) / before * 100, 1) AS duplicate_percent FROM t""",
    "source_overlap": f"""WITH RECURSIVE {_MEMBERS} SELECT overlap, count(*) AS n FROM merged WHERE n_duplicate_sources >= 2 GROUP BY overlap""",
    "review_queue": f"""WITH RECURSIVE {_MEMBERS}, about AS (SELECT *, concat_ws(' | ', source, model, variant, model_year, mileage || ' mil',
          CAST(price AS BIGINT) || ' kr') AS text FROM members)
        SELECT b.listing_id AS rep_listing_id, a.listing_id, a.score, 'score=' || a.score || ' | ' || b.text || ' <-> ' || a.text AS line
        FROM about a JOIN about b ON a.opened = b.opened AND b.is_rep
        WHERE a.match_type = 'fingerprint' AND a.score < 90 AND a.reason <> 'identisk_annons'""",
    "duplicate_groups": f"""WITH RECURSIVE {_GROUPED}
        SELECT listing_id, concat_ws('-', opened[1], opened[2], opened[3], opened[4], opened[5]) AS group_id,
          count(*) OVER (PARTITION BY opened) AS group_size,
          row_number() OVER (PARTITION BY opened ORDER BY complete DESC, seq) = 1 AS is_rep FROM grouped""",
    "completeness": f"{_LIST} SELECT listing_id, {_COMPLETE} AS completeness FROM listings",
    "profile_copies": f"WITH {_PROF} SELECT n, count(*) AS n_profiles FROM prof GROUP BY n",
    "regno_links": f"WITH {_PROF} " + _LINKS.format(keys=_KEYS, col="reg_no"),
    "vin_links": f"WITH {_PROF} " + _LINKS.format(keys=_KEYS, col="vin"),
    "identical_pairs": f"""WITH {_PROF} SELECT {_KEYS} FROM prof a JOIN prof b ON a.model = b.model AND a.variant = b.variant AND a.model_year = b.model_year
        WHERE {_FIRST} AND {_IDENTICAL} ORDER BY ALL""",
    # Profiles that know year and variant meet on both; a profile that lacks one meets all of its model.
    "identical_pairs_unknown": f"""WITH {_UNKNOWN}, met AS (
        SELECT a.no AS x, b.no AS y FROM prof a JOIN prof b ON a.model = b.model AND a.variant = b.variant AND a.model_year = b.model_year
          WHERE {_FIRST} AND {_AGREE}
        UNION SELECT least(a.no, b.no), greatest(a.no, b.no) FROM (SELECT * FROM prof WHERE variant IS NULL OR model_year IS NULL) a
          JOIN prof b ON a.model = b.model WHERE a.no <> b.no AND {_AGREE})
        SELECT {_KEYS} FROM met JOIN prof a ON a.no = x JOIN prof b ON b.no = y ORDER BY ALL""",
    "score_blocks": f"""WITH {_BLOCKS} SELECT {_OUT}, same_year, CAST(round_even({_MIL} * 25, 0) AS INTEGER) AS mileage_points,
        CAST(round_even({_PRICE} * 3, 0) AS INTEGER) AS price_points FROM points ORDER BY ALL""",
    "equipment_agreement": f"WITH {_BLOCKS} SELECT {_OUT}, CAST(same AS INTEGER) AS same, known FROM blocks ORDER BY ALL",
    "fingerprint_scores": f"WITH {_BLOCKS} SELECT {_OUT}, score, match_type, reason, matches FROM decided ORDER BY ALL",
    "match_edges": f"""WITH {_BLOCKS}, same AS (SELECT {_KEYS}, a.reg_no = b.reg_no AS reg, a.vin = b.vin AS vin FROM prof a JOIN prof b ON a.seq < b.seq
          AND a.model = b.model AND a.variant = b.variant AND a.model_year = b.model_year AND {_IDENTICAL})
        SELECT {_OUT}, TRUE AS forward, 100 AS score, CASE WHEN reg THEN 'regnr' WHEN vin THEN 'vin' ELSE 'identisk_annons' END AS reason FROM same
        UNION SELECT {_OUT}, TRUE, score, reason FROM decided WHERE matches""",
    "identical_components": f"""WITH RECURSIVE {_PROF}, pairs AS (SELECT a.seq AS x, b.seq AS y FROM prof a JOIN prof b ON a.seq < b.seq AND a.model = b.model
          AND a.variant = b.variant AND a.model_year = b.model_year AND {_IDENTICAL}),
        both_ways AS (SELECT x, y FROM pairs UNION SELECT y, x FROM pairs),
        reach AS (SELECT DISTINCT x AS start, x AS node FROM both_ways UNION SELECT r.start, e.y FROM reach r JOIN both_ways e ON e.x = r.node),
        heads AS (SELECT start, min(node) AS head FROM reach GROUP BY start)
        SELECT p.k1, p.k2, p.k3, p.k4, p.k5, h.k1 AS head_k1, h.k2 AS head_k2, h.k3 AS head_k3, h.k4 AS head_k4, h.k5 AS head_k5
        FROM heads JOIN prof p ON p.seq = start JOIN prof h ON h.seq = head""",
    "mileage_price_similarity": f"""{_LIST} SELECT listing_id, round({_MIL}, 6) AS mileage_similarity, round({_PRICE}, 6) AS price_similarity
        FROM (SELECT listing_id, CAST(mileage % 400 AS DOUBLE) AS gap, price % 7000 AS pgap FROM listings)""",
    "norm_text": r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(replace(strip_accents(lower(text)), '&', ' och ')
          || CASE WHEN doc_id % 3 = 0 THEN ' fin 1 2 ab 1 iv' ELSE '' END,
        '[^\pL\pN_\s]+|[/_|(),;:+\-]+', ' ', 'g'), '\s+', ' ', 'g'))) AS digest FROM documents""",
    "norm_id": "SELECT page_id, upper(regexp_replace(url, '[^A-Za-z0-9]', '', 'g')) AS norm_id FROM pages",
    "norm_variant": """SELECT p_partkey, 'xdrive och ' || p_name || ' 4motion plugin e' || replace(lower(p_brand), '#', ' ') AS norm_variant FROM part""",
    "lenient_numbers": """SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 1000 + p_partkey % 1000 + 0.5::DOUBLE END AS number,
        CAST(CASE WHEN p_partkey % 7 <> 0 THEN round_even(p_size * 1000 + p_partkey % 1000 + 0.5::DOUBLE, 0) END AS BIGINT) AS whole,
        CAST(p_partkey AS DOUBLE) * 1e7 + 0.25 AS from_number, CAST(NULL AS DOUBLE) AS from_flag FROM part""",
}
