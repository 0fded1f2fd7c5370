"""SQL for the queries of :mod:`pricelode.plans.valuation_queries`."""

from pricelode.plans import sql_parts as P

_COMPS = f"WITH {P.PREPARED}{P.COMPS}"
_VALUED = f"WITH {P.VALUED}"
_STAGED = f"WITH {P.SCORED}"
_LIST = f"WITH {P.LISTINGS}"
_PREP = f"WITH {P.PREPARED}"
_AGE = f"({P.AGE})"
_EXPECTED = f"({P.AGE} * 1800.0)"
_N = P.thousands

_CANDIDATE_STATUS = "CASE stage WHEN 'low_score' THEN 'STOPP: score < 60' WHEN 'sent' THEN 'SKICKAS' END"

ORACLES = {
    "market_basis": f"""{_PREP} SELECT listing_id, concat_ws('|', model, variant, model_year) AS category, price, mileage,
        listing_id AS ident, url AS url_key, equipment FROM basis""",
    "market_basis_counts": f"""{_PREP} SELECT CASE WHEN leasing THEN 'leasing' WHEN NOT price BETWEEN 100000 AND 2000000 THEN 'price'
        WHEN mileage < 1000 THEN 'mileage' ELSE 'ok' END AS reason, count(*) AS n FROM prepared GROUP BY 1""",
    "leasing_flag": f"{_PREP} SELECT listing_id, leasing FROM prepared",
    "plausible_cash_price": f"{_LIST} SELECT listing_id, price BETWEEN 150000 AND 400000 AS plausible FROM listings",
    "minimum_mileage": f"{_LIST} SELECT listing_id, CASE WHEN mileage < 1000 THEN 'mileage' ELSE 'ok' END AS reason FROM listings",
    "listing_identity": f"""{_PREP} SELECT k1, k2, k3, k4, k5, CASE WHEN owners = 2 THEN url ELSE listing_id END AS ident FROM prepared""",
    "url_resolver": f"{_PREP} SELECT listing_id, url AS clean_url FROM prepared",
    "trim_amount": f"{_LIST} SELECT listing_id, {P.TRIM_CASE} AS amount FROM listings",
    "option_amount": f"{_LIST} SELECT listing_id, {P.OPTION_SUM} AS amount FROM listings",
    "equipment_value": f"{_LIST} SELECT listing_id, {P.EQUIPMENT} AS amount FROM listings",
    "comparables": f"""{_COMPS} SELECT listing_id, CAST(count(cid) AS INTEGER) AS n, coalesce(string_agg(cid, ',' ORDER BY rn), '') AS comp_ids
        FROM prepared LEFT JOIN comps ON tid = listing_id GROUP BY listing_id""",
    "self_exclusion": f"""{_PREP}, t AS (SELECT *, CASE WHEN k2 <> 1 THEN listing_id END AS ident FROM prepared),
        b AS (SELECT *, CASE WHEN k2 <> 1 THEN listing_id END AS ident FROM basis),
        pairs AS (SELECT t.listing_id AS tid, b.listing_id AS cid, b.seq AS cseq, abs(b.mileage - t.mileage) AS gap
          FROM t JOIN b ON t.model = b.model AND t.variant = b.variant AND t.model_year = b.model_year AND abs(b.mileage - t.mileage) <= 3000
          WHERE NOT coalesce(t.ident = b.ident, FALSE)
            AND NOT ((t.ident IS NULL OR b.ident IS NULL) AND t.price = b.price AND t.mileage = b.mileage)),
        tiered AS (SELECT *, count(*) FILTER (gap <= 1500) OVER (PARTITION BY tid) AS tight FROM pairs),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY gap, cseq) AS rn FROM tiered WHERE tight < 3 OR gap <= 1500)
        SELECT k1, k2, k3, k4, k5, CAST(count(cid) AS INTEGER) AS n, coalesce(string_agg(cid, ',' ORDER BY rn), '') AS comp_ids
        FROM t LEFT JOIN (SELECT * FROM ranked WHERE rn <= 15) ON tid = listing_id GROUP BY listing_id, k1, k2, k3, k4, k5""",
    "adjusted_median_price": f"{_VALUED} SELECT listing_id, CAST(n AS INTEGER) AS n_comparables, market_price FROM valued",
    "basis_strength": f"""{_VALUED} SELECT strength AS basis_strength, count(*) AS n, CAST(min(v.n) AS INTEGER) AS least,
        CAST(max(v.n) AS INTEGER) AS most FROM valued v GROUP BY 1""",
    "comparable_details": f"""{_VALUED} SELECT listing_id, CAST(n AS INTEGER) AS n_comparables, strength AS basis_strength,
        dmed AS adjusted_median, coalesce(details, '') AS details FROM valued""",
    "base_price_lookup": f"{_VALUED} SELECT listing_id, base_price FROM valued",
    "mileage_expectation": f"""{_LIST} SELECT listing_id, CAST(round_even({_AGE} * 100, 0) / 100 AS DOUBLE) AS age_years,
        CAST(round_even({_EXPECTED}, 0) AS BIGINT) AS expected_mileage,
        CAST(round_even(mileage - {_EXPECTED}, 0) AS BIGINT) AS mileage_deviation,
        CAST(round_even((mileage - {_EXPECTED}) * -12.0, 0) AS BIGINT) AS mileage_effect FROM listings""",
    "age_in_years": f"{_LIST} SELECT listing_id, CAST(round_even({_AGE} * 10000, 0) / 10000 AS DOUBLE) AS age FROM listings",
    "market_value": f"{_VALUED} SELECT listing_id, market_value FROM valued",
    "bargain_classes": f"""{_VALUED} SELECT listing_id, market_value, diff, round(ratio, 6) AS bargain_ratio, level,
        CAST(n AS INTEGER) AS n_comparables, strength AS basis_strength, n >= 3 AS empirical FROM valued""",
    "price_points": f"{_STAGED} SELECT price_points, count(*) AS n FROM (SELECT price_points FROM scored) GROUP BY 1",
    "mileage_points": f"{_LIST} SELECT listing_id, {P.MILEAGE_POINTS} AS points FROM listings",
    "equipment_points": f"{_LIST} SELECT listing_id, {P.EQUIPMENT_POINTS} AS points FROM listings",
    "trust_points": f"{_LIST} SELECT listing_id, {P.TRUST_POINTS} AS points FROM listings",
    "total_score": f"""{_STAGED} SELECT listing_id, price_points, mileage_points, equipment_points, trust_points,
        auction_deduction, score, score_level FROM staged""",
    "score_levels": f"{_STAGED} SELECT score_level, count(*) AS n FROM (SELECT score_level FROM staged) GROUP BY 1",
    "display_title": f"{_STAGED} SELECT listing_id, title AS display_title FROM staged",
    "candidate_funnel": f"{_STAGED} SELECT listing_id, stage FROM staged",
    "funnel_statistics": f"""{_STAGED} SELECT count(*) AS total, count(*) FILTER (stage = 'leasing') AS leasing_stopped,
        count(*) FILTER (stage = 'mileage') AS mileage_stopped,
        count(*) FILTER (stage IN ('under_diff', 'low_score', 'sent')) AS valuation_ok,
        count(*) FILTER (stage IN ('low_score', 'sent')) AS over_diff, count(*) FILTER (stage = 'sent') AS score_ok,
        0::BIGINT AS already_alerted, count(*) FILTER (stage = 'sent') AS sent,
        60 AS min_score, 15000 AS min_diff, 1000 AS min_mileage FROM staged""",
    "candidate_records": f"""{_STAGED} SELECT listing_id, score, price_points, mileage_points, equipment_points, trust_points, diff,
        market_value, price, mileage, model_year, title, trim, {_CANDIDATE_STATUS} AS status, url,
        CAST(round_even({_AGE} * 100, 0) / 100 AS DOUBLE) AS age_years,
        CAST(round_even({_EXPECTED}, 0) AS BIGINT) AS expected_mileage,
        CAST(round_even(mileage - {_EXPECTED}, 0) AS BIGINT) AS mileage_deviation,
        CAST(round_even((mileage - {_EXPECTED}) * -12.0, 0) AS BIGINT) AS mileage_effect
        FROM staged WHERE stage IN ('low_score', 'sent')""",
    "top_candidates": f"""{_STAGED} SELECT CAST(row_number() OVER (ORDER BY score DESC, diff DESC, seq) AS INTEGER) AS rank, listing_id, score, diff,
        lpad(CAST(row_number() OVER (ORDER BY score DESC, diff DESC, seq) AS VARCHAR), 2, '0') || '. ' || lpad(CAST(score AS VARCHAR), 3, ' ') || '/100 | ' || model_year || ' | ' || {_N('mileage')} || ' mil | ' || {_N('price')}
          || ' kr | diff +' || {_N('diff')} || ' | ' || title || ' | ' || replace(trim, ' ', '  ') || ' | ' || {_CANDIDATE_STATUS} AS line,
        'Pris: ' || price_points || '/60 | Miltal: ' || mileage_points || '/20 | Utrustning: ' || equipment_points
          || '/5 | Trygghet: ' || trust_points || '/15' AS points, CAST(NULL AS VARCHAR) AS history
        FROM staged WHERE stage IN ('low_score', 'sent') ORDER BY score DESC, diff DESC, seq LIMIT 20""",
    "alert_messages": f"""{_STAGED}, words AS (SELECT *, 'X2' || array_to_string(list_transform(string_split(trim, ' '),
          lambda w: upper(w[1]) || w[2:]), '-') || ' 4Motion' AS big_trim FROM staged WHERE stage = 'sent')
        SELECT listing_id, score_level || ': ' || title || ' ' || model_year || ' - ' || {_N('diff')} || ' kr under marknad' AS subject,
        concat_ws(chr(10), score_level || ' – ' || title,
          model_year || ' · ' || {_N('mileage')} || ' mil · ' || {_N('price')} || ' kr',
          'Marknadsvärde: ~' || {_N('market_value')} || ' kr', 'Ca ' || {_N('diff')} || ' kr under marknad',
          CASE WHEN auction THEN '⚠️ AUKTIONSPRIS - INTE ett fast köp-nu-pris, du kan behöva buda över beloppet för att vinna' END,
          concat_ws(' · ', CASE WHEN tow_hook THEN 'Drag' END, CASE WHEN heater THEN 'värmare' END, big_trim),
          'Import: Nej', 'Hyrbil/tjänstebil: Nej', 'Ägare: ' || owners, 'Ny annons', '', 'Fyndscore: ' || score || '/100') AS message
        FROM words""",
}
