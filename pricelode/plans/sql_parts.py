"""SQL building blocks shared by the oracle statements (DuckDB dialect)."""

LISTINGS = """
listings AS (
  SELECT 's' || (l_suppkey % 4) AS source,
    concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS listing_id,
    'acme' AS make, lower(p_type) AS model, p_brand AS variant, CAST(year(l_shipdate) AS INTEGER) AS model_year,
    CAST(l_quantity * 240 AS BIGINT) AS mileage,
    CAST(floor(l_extendedprice / 1000) * 4000 + 100000 AS DOUBLE) AS price,
    CASE WHEN l_suppkey % 10 = 3 THEN 'Manuell' ELSE 'Automat' END AS gearbox,
    l_orderkey % 50 = 7 AS damaged, l_orderkey % 30 = 11 AS auction,
    p_name AS trim, CAST(l_linenumber AS INTEGER) AS owners,
    l_returnflag = 'R' AS tow_hook, l_linestatus = 'F' AS heater, l_discount >= 0.05 AS certified, l_tax >= 0.04 AS big_battery,
    CASE WHEN l_linenumber % 3 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS first_registration,
    CASE l_orderkey % 40 WHEN 0 THEN 'Privatleasing 4 995 kr/mån' WHEN 1 THEN 'Tidigare leasingbil med en ägare'
      WHEN 2 THEN 'fd leasingbil, nu privatleasing' END AS description,
    CASE WHEN l_linenumber = 7 THEN 'R' || chr(CAST(65 + l_orderkey % 26 AS INTEGER))
      || chr(CAST(65 + (l_orderkey // 26) % 26 AS INTEGER)) || lpad(CAST(l_orderkey // 676 AS VARCHAR), 3, '0') END AS reg_no,
    CASE WHEN l_linenumber = 6 THEN 'VIN' || l_orderkey END AS vin,
    l_orderkey AS k1, CAST(l_linenumber AS BIGINT) AS k2, l_partkey AS k3, l_suppkey AS k4,
    CAST(round(l_extendedprice * 100) AS BIGINT) AS k5,
    row(l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey)
"""

TRIM_CASE = """CASE WHEN lower(trim) LIKE '%hot ring%' THEN 30000 WHEN lower(trim) LIKE '%hot%' THEN 25000
  WHEN lower(trim) LIKE '%blue%' THEN 15000 WHEN lower(trim) LIKE '%large%' THEN 5000
  WHEN lower(trim) LIKE '%old%' THEN -15000 ELSE 0 END"""
OPTION_SUM = """(CASE WHEN tow_hook THEN 8000 ELSE 0 END + CASE WHEN heater THEN 4000 ELSE 0 END
  + CASE WHEN certified THEN 6000 ELSE 0 END + CASE WHEN big_battery THEN 12000 ELSE 0 END)"""
EQUIPMENT = f"greatest(-40000, least(40000, {TRIM_CASE} + {OPTION_SUM}))"
LEASING = "(description IS NOT NULL AND description NOT LIKE 'Tidigare%')"

PREPARED = LISTINGS + f""",
prepared AS (SELECT *, CAST({EQUIPMENT} AS DOUBLE) AS equipment, {LEASING} AS leasing,
   'https://' || source || '.example/ad/' || listing_id AS url FROM listings),
basis AS (SELECT * FROM prepared WHERE NOT leasing AND price BETWEEN 100000 AND 2000000 AND mileage >= 1000)
"""

# ``same`` tells whether basis row b is target t itself.
COMPS = """,
pairs AS (
  SELECT t.listing_id AS tid, t.mileage AS tm, t.equipment AS te, b.listing_id AS cid, b.price AS cp, b.mileage AS cm,
    b.equipment AS ce, b.seq AS cseq, abs(b.mileage - t.mileage) AS gap
  FROM prepared t JOIN basis b ON t.model = b.model AND t.variant = b.variant AND t.model_year = b.model_year
    AND abs(b.mileage - t.mileage) <= 3000 AND t.listing_id <> b.listing_id),
tiered AS (SELECT *, count(*) FILTER (gap <= 1500) OVER (PARTITION BY tid) AS tight FROM pairs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY tid ORDER BY gap, cseq) AS rn FROM tiered
  WHERE tight < 3 OR gap <= 1500),
comps AS (SELECT *, cp + (cm - tm) * 12.0 + greatest(-40000, least(40000, te - ce)) AS adjusted FROM ranked WHERE rn <= 15)
"""

BASE_PRICES = """,
base_prices(bm, bv, by_, bp) AS (VALUES ('economy','Brand#1',1998,300000.0::DOUBLE), ('economy','Brand#1',2000,320001.0),
  ('small','Brand#2',1999,280000.0), ('promo','Brand#3',2001,350000.0), ('standard','Brand#4',1997,250000.0),
  ('medium','Brand#5',1996,240000.0), ('large','Brand#6',1995,230000.0), ('economy','Brand#7',1995,230000.0)),
base_medians AS (SELECT bm, bv, floor(median(bp)) AS bmed FROM base_prices GROUP BY bm, bv)
"""

AGE = "greatest(0.0, (2001 - model_year) + (12 - 6) / 12.0)"

VALUED = PREPARED + COMPS + BASE_PRICES + f""",
agg AS (SELECT tid, count(*) AS n, median(adjusted) AS med, median(round_even(adjusted, 0)) AS dmed,
   string_agg(cid, ',' ORDER BY rn) AS comp_ids,
   string_agg(concat_ws(':', cid, CAST(cp AS BIGINT), cm, cm - tm, CAST((cm - tm) * 12 AS BIGINT), CAST(ce AS BIGINT),
     CAST(te AS BIGINT), CAST(greatest(-40000, least(40000, te - ce)) AS BIGINT), CAST(adjusted AS BIGINT)), ' ' ORDER BY rn) AS details
   FROM comps GROUP BY tid),
v0 AS (SELECT p.*, coalesce(n, 0) AS n, comp_ids, details, CAST(round_even(dmed, 0) AS BIGINT) AS dmed,
   CASE WHEN n >= 3 THEN round_even(med / 1000, 0) * 1000 END AS market_price,
   coalesce(bp, bmed) AS base_price, {AGE} AS age
  FROM prepared p LEFT JOIN agg ON tid = listing_id LEFT JOIN base_prices ON model = bm AND variant = bv AND model_year = by_
   LEFT JOIN base_medians m ON model = m.bm AND variant = m.bv),
v1 AS (SELECT *, coalesce(market_price, round_even((base_price - (mileage - age * 1800.0) * 12.0 + equipment) / 1000, 0) * 1000, 0.0) AS market_value FROM v0),
v2 AS (SELECT *, market_value - price AS diff,
   CASE WHEN market_value > 0 THEN (market_value - price) / market_value * 100 ELSE 0.0 END AS ratio,
   CASE WHEN n >= 8 THEN 'STARKT' WHEN n >= 5 THEN 'GODKÄNT' WHEN n >= 3 THEN 'SVAGT' ELSE 'OTILLRÄCKLIGT' END AS strength FROM v1),
valued AS (SELECT *, CASE WHEN n >= 5 AND diff >= 35000 AND ratio >= 8 THEN 'EXTREMT_FYND'
   WHEN n >= 3 AND diff >= 20000 AND ratio >= 5 THEN 'FYND' END AS level FROM v2)
"""

PRICE_POINTS = "CASE " + " ".join(
    f"WHEN diff >= {t} THEN {p}" for t, p in (
        (60000, 60), (55000, 56), (50000, 52), (45000, 48), (40000, 44), (35000, 40), (30000, 36), (27500, 33),
        (25000, 30), (22500, 27), (20000, 24), (17500, 21), (15000, 18), (12500, 15), (10000, 12), (7500, 9),
        (5000, 6), (2500, 3),
    )
) + " ELSE 0 END"
MILEAGE_POINTS = "CASE " + " ".join(
    f"WHEN mileage < {t} THEN {p}" for t, p in (
        (5000, 20), (6000, 19), (7000, 17), (8000, 15), (9000, 13), (10000, 11), (11000, 9), (12000, 7),
        (13000, 5), (14000, 3),
    )
) + " ELSE 0 END"
TRIM_POINTS = """CASE WHEN trim LIKE '%hot%' THEN 5 WHEN trim LIKE '%blue%' THEN 4 WHEN trim LIKE '%large%' THEN 3
  WHEN trim LIKE '%small%' THEN 2 WHEN trim LIKE '%old%' THEN 1 ELSE 0 END"""
EQUIPMENT_POINTS = f"least(5, {TRIM_POINTS} + tow_hook::INTEGER + heater::INTEGER)"
TRUST_POINTS = "CASE WHEN certified THEN 5 ELSE 0 END + CASE owners WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END + 6"
LEVEL_TEXT = """CASE WHEN score >= 90 THEN '🚨 EXTREMT FYND' WHEN score >= 80 THEN '🔥 RIKTIGT FYND'
  WHEN score >= 70 THEN '🟢 MYCKET INTRESSANT' WHEN score >= 60 THEN '🟡 INTRESSANT' ELSE '⚪ BEVAKA' END"""

SCORED = VALUED + f""",
s0 AS (SELECT *, {PRICE_POINTS} AS price_points, {MILEAGE_POINTS} AS mileage_points, {EQUIPMENT_POINTS} AS equipment_points,
   {TRUST_POINTS} AS trust_points, CASE WHEN auction THEN 10 ELSE 0 END AS auction_deduction FROM valued),
scored AS (SELECT *, greatest(0, least(100, price_points + mileage_points + equipment_points + trust_points - auction_deduction)) AS score FROM s0),
staged AS (SELECT *, {LEVEL_TEXT} AS score_level,
   CASE WHEN leasing THEN 'leasing' WHEN mileage < 1000 THEN 'mileage' WHEN level IS NULL THEN 'no_level'
    WHEN diff < 15000 THEN 'under_diff' WHEN score < 60 THEN 'low_score' ELSE 'sent' END AS stage,
   CASE WHEN model IN ('economy', 'small') THEN 'Acme ' || CASE model WHEN 'economy' THEN 'Economy' ELSE 'Small' END || ' ' || variant
     ELSE upper(model) || ' ' || variant END AS title FROM scored)
"""


def thousands(expr: str) -> str:
    """Number text with a space between thousands."""
    return f"replace(format('{{:,}}', CAST({expr} AS BIGINT)), ',', ' ')"
