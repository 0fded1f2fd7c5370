"""SQL for the queries of :mod:`pricelode.plans.history_queries`."""

from pricelode.plans import sql_parts as P

_LIST = f"WITH {P.LISTINGS}"
_CUT = "TIMESTAMP '2000-01-01'"

_OBS = """obs AS (SELECT CAST(l_partkey AS VARCHAR) AS listing_key, l_shipdate AS ts, floor(l_extendedprice) AS price,
  CASE WHEN l_linenumber % 3 = 0 THEN 'marknadsvarde' ELSE 'annons' END AS kind,
  row(l_shipdate, l_orderkey, l_linenumber, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT)) AS ord FROM lineitem)"""

_METRICS = _OBS + f""", m AS (SELECT listing_key, count(*) FILTER (kind = 'annons') AS n_observations,
  coalesce(greatest(0, CAST(floor((epoch({_CUT}) - epoch(min(ts) FILTER (kind = 'annons'))) / 86400) AS BIGINT)), 0) AS days_observed,
  arg_min(price, ord) FILTER (kind = 'annons') AS first_price, arg_max(price, ord) FILTER (kind = 'annons') AS last_price,
  arg_max(price, ord) FILTER (kind <> 'annons') AS last_market_value,
  CASE WHEN count(*) FILTER (kind <> 'annons') >= 2 THEN
    arg_max(price, ord) FILTER (kind <> 'annons') - arg_min(price, ord) FILTER (kind <> 'annons') END AS market_value_change,
  count(*) FILTER (kind <> 'annons') AS n_valuations
  FROM obs WHERE ts < {_CUT} GROUP BY listing_key),
metrics AS (SELECT *, coalesce(last_price - first_price, 0.0) AS price_change, greatest(0.0, coalesce(first_price - last_price, 0.0)) AS price_fall FROM m)"""

_EVENT_DAILY = """daily AS (SELECT lower(event_type) || '||None' AS category, CAST(ts + INTERVAL 1 HOUR AS DATE) AS day,
  median(value) AS median_price, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1, 2)"""

_CATEGORY_DAILY = """daily AS (SELECT lower(p_type) || '|' || lower(p_brand) || '|' || year(l_shipdate) AS category,
  CAST(l_shipdate AS DATE) AS day, median(floor(l_extendedprice / 1000) * 4000 + 100000) AS median_price, count(*) AS n
  FROM lineitem JOIN part ON l_partkey = p_partkey {where} GROUP BY 1, 2)"""

_TREND = """, clipped AS (SELECT * FROM daily QUALIFY date_diff('day', day, max(day) OVER (PARTITION BY category)) <= 13),
moved AS (SELECT *, lag(day) OVER w AS from_day, lag(median_price) OVER w AS from_price FROM clipped WINDOW w AS (PARTITION BY category ORDER BY day)),
dir AS (SELECT *, CASE WHEN from_price <= 0 THEN 0.0 ELSE (median_price - from_price) / from_price * 100.0 END AS pct FROM moved),
dirs AS (SELECT *, CASE WHEN from_day IS NULL THEN NULL WHEN pct >= 1.0 THEN 'upp' WHEN pct <= -1.0 THEN 'ned' ELSE 'oforandrad' END AS d FROM dir),
lasts AS (SELECT *, first_value(d) OVER (PARTITION BY category ORDER BY day DESC) AS now FROM dirs),
runs AS (SELECT *, sum(CASE WHEN d IS DISTINCT FROM now THEN 1 ELSE 0 END) OVER (PARTITION BY category ORDER BY day DESC) = 0
   AND d IN ('upp', 'ned') AS run FROM lasts),
g AS (SELECT category, count(*) AS n_days, max(now) AS now, count(*) FILTER (run) AS k,
   arg_min(from_price, day) FILTER (run) AS p0, arg_max(median_price, day) FILTER (run) AS p1,
   min(from_day) FILTER (run) AS d0, max(day) FILTER (run) AS d1,
   string_agg(strftime(day, '%Y-%m-%d') || ':' || CAST(round_even(median_price * 2, 0) AS BIGINT) || ':' || n, ' ' ORDER BY day) AS series
   FROM runs GROUP BY category),
trends AS (SELECT category, CASE WHEN n_days < 2 THEN 'otillrackligt_underlag' WHEN k > 0 THEN now ELSE 'stabil' END AS trend,
   CAST(k AS BIGINT) AS strength, CASE WHEN k > 0 THEN CASE WHEN p0 <= 0 THEN 0.0 ELSE (p1 - p0) / p0 * 100.0 END ELSE 0.0 END AS change_percent,
   CASE WHEN k > 0 THEN p1 - p0 ELSE 0.0 END AS change, strftime(d0, '%Y-%m-%d') AS start_day, strftime(d1, '%Y-%m-%d') AS end_day,
   n_days, series FROM g)"""

_CAT = _CATEGORY_DAILY.format(where="")

_PART_LISTINGS = P.LISTINGS + """, pl AS (SELECT seq, k1, k2, k3, k4, k5, model, variant, model_year, mileage, price,
   CASE WHEN k2 <> 5 THEN CAST(k3 AS VARCHAR) END AS lid FROM listings)"""
_KEY = """coalesce('annons:' || lid, 'kal:' || model || ':' || variant || ':' || {year} || ':' || mileage)"""
_STATE = _PART_LISTINGS + f""", old AS (SELECT *, {_KEY.format(year='model_year')} AS state_key FROM pl WHERE model_year < 2000),
stored AS (SELECT state_key, DATE '2001-01-01' AS first_seen, arg_min(price, seq) AS first_price, arg_max(price, seq) AS last_price,
   DATE '2001-02-01' AS last_seen, arg_min(k1, seq) % 4 < 2 AS notified,
   CASE WHEN arg_min(k1, seq) % 4 = 0 THEN arg_max(price, seq) END AS notified_price FROM old GROUP BY state_key)"""
_RUN = _STATE + f""", run AS (SELECT *, {_KEY.format(year='(model_year - 3)')} AS state_key,
   'kal:' || model || ':' || variant || ':' || (model_year - 3) || ':' || mileage AS old_key FROM pl WHERE model_year >= 2000),
keys AS (SELECT state_key, min(seq) AS fseq, arg_min(old_key, seq) AS old_key, arg_min(price, seq) AS fprice, max(seq) AS lseq,
   arg_max(price, seq) AS lprice FROM run GROUP BY state_key),
resolved AS (SELECT k.*, CASE WHEN s1.state_key IS NOT NULL OR k.state_key = k.old_key THEN k.state_key
    WHEN s2.state_key IS NOT NULL OR c.fseq < k.fseq THEN k.old_key ELSE k.state_key END AS record_key
  FROM keys k LEFT JOIN stored s1 ON s1.state_key = k.state_key LEFT JOIN stored s2 ON s2.state_key = k.old_key
  LEFT JOIN keys c ON c.state_key = k.old_key AND c.state_key = c.old_key),
rec0 AS (SELECT record_key, arg_max(lprice, lseq) AS last_price, max(CASE WHEN state_key = record_key THEN fseq END) AS origin_seq,
   max(CASE WHEN state_key = record_key THEN fprice END) AS origin_price,
   max(CASE WHEN state_key <> record_key THEN record_key END) AS shared FROM resolved GROUP BY record_key),
records AS (SELECT record_key, s.state_key IS NOT NULL AS known, coalesce(s.first_seen, DATE '2001-12-01') AS first_seen,
   CASE WHEN s.state_key IS NOT NULL THEN s.first_price ELSE origin_price END AS first_price,
   CASE WHEN s.state_key IS NULL THEN origin_seq END AS origin_seq, r.last_price, DATE '2001-12-01' AS last_seen,
   coalesce(s.notified, FALSE) AS notified, s.notified_price, shared AS migrated_from
   FROM rec0 r LEFT JOIN stored s ON s.state_key = record_key),
by_key AS (SELECT state_key, records.* FROM resolved JOIN records USING (record_key)),
changed AS (SELECT * FROM by_key UNION ALL SELECT record_key AS state_key, records.* FROM records WHERE record_key NOT IN (SELECT state_key FROM resolved)),
next_state AS (SELECT state_key, record_key, first_seen, first_price, last_price, last_seen, notified, notified_price, migrated_from FROM changed
   UNION ALL SELECT state_key, state_key, first_seen, first_price, last_price, last_seen, notified, notified_price, NULL FROM stored
   WHERE state_key NOT IN (SELECT state_key FROM changed)),
enriched AS (SELECT run.*, b.record_key, coalesce(run.seq = b.origin_seq, FALSE) AS origin,
   CASE WHEN coalesce(run.seq = b.origin_seq, FALSE) THEN 0 ELSE date_diff('day', b.first_seen, DATE '2001-12-01') END AS days_listed,
   CASE WHEN coalesce(run.seq = b.origin_seq, FALSE) THEN 0.0 ELSE b.first_price - run.price END AS price_drop
   FROM run JOIN by_key b USING (state_key))"""
# The alert fold row by row: each record's rows in order, carrying the price of the last alert.
_FOLD = _RUN.replace(" pl AS", " pl AS", 1) + """,
numbered AS (SELECT e.seq, e.record_key, e.price, row_number() OVER (PARTITION BY e.record_key ORDER BY e.seq) AS rn FROM enriched e),
memory AS (SELECT record_key, max(notified) AS notified, max(notified_price) AS bar FROM next_state GROUP BY record_key),
fold AS (
  SELECT n.record_key, n.rn, n.seq, NOT m.notified OR coalesce(n.price <= m.bar - 15000, FALSE) AS alert,
    CASE WHEN NOT m.notified OR coalesce(n.price <= m.bar - 15000, FALSE) THEN n.price ELSE m.bar END AS bar
  FROM numbered n JOIN memory m USING (record_key) WHERE n.rn = 1
  UNION ALL
  SELECT n.record_key, n.rn, n.seq, coalesce(n.price <= f.bar - 15000, FALSE), CASE WHEN coalesce(n.price <= f.bar - 15000, FALSE) THEN n.price ELSE f.bar END
  FROM fold f JOIN numbered n ON n.record_key = f.record_key AND n.rn = f.rn + 1)"""


def _recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql


ORACLES = {
    "history_index": f"WITH {_OBS} SELECT listing_key, count(*) AS n FROM obs WHERE ts < {_CUT} GROUP BY 1",
    "history_metrics": f"""WITH {_METRICS} SELECT listing_key, n_observations, days_observed, first_price, last_price, price_change,
        price_fall, last_market_value, market_value_change, n_valuations FROM metrics""",
    "history_enrichment": f"""WITH {P.LISTINGS}, {_METRICS} SELECT listing_id, coalesce(n_observations, 0) AS hist_n_observations,
        coalesce(days_observed, 0) AS hist_days_observed, first_price AS hist_first_price, last_price AS hist_last_price,
        coalesce(price_change, 0.0) AS hist_price_change, coalesce(price_fall, 0.0) AS hist_price_fall,
        last_market_value AS hist_last_market_value, market_value_change AS hist_market_value_change,
        coalesce(n_valuations, 0) AS hist_n_valuations FROM listings LEFT JOIN metrics ON listing_key = CAST(k3 AS VARCHAR)""",
    "observation_key": f"""WITH {P.PREPARED} SELECT listing_id, coalesce('reg:' || reg_no, CASE WHEN owners % 3 = 1 THEN listing_id END,
        CASE WHEN owners % 3 = 2 THEN url END, 'kal:' || model || ':' || variant || ':' || model_year || ':' || mileage || ':' || CAST(price AS BIGINT))
        AS listing_key FROM prepared""",
    "time_parser": """SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(floor(epoch(ts)) AS BIGINT) - 7200
        WHEN 1 THEN CAST(floor(epoch(ts)) AS BIGINT) WHEN 2 THEN CAST(floor(epoch(ts)) AS BIGINT) - 3600 END AS epoch FROM events""",
    "trend_key": """SELECT lower(p_type) || '|' || lower(p_brand) || '|' || year(l_shipdate) AS category, count(*) AS n
        FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1""",
    "daily_median_events": f"""WITH {_EVENT_DAILY} SELECT category, strftime(day, '%Y-%m-%d') AS day, round(median_price, 6) AS median_price, n FROM daily""",
    "daily_median_categories": f"WITH {_CAT} SELECT category, strftime(day, '%Y-%m-%d') AS day, median_price, n FROM daily",
    "trend_window": f"""WITH {_EVENT_DAILY}{_TREND} SELECT category, strftime(day, '%Y-%m-%d') AS day, round(median_price, 6) AS median_price, n FROM clipped""",
    "trend_steps": f"""WITH {_EVENT_DAILY}, moved AS (SELECT *, lag(day) OVER w AS f, lag(median_price) OVER w AS fp FROM daily WINDOW w AS (PARTITION BY category ORDER BY day)),
        p AS (SELECT *, CASE WHEN fp <= 0 THEN 0.0 ELSE (median_price - fp) / fp * 100.0 END AS pct FROM moved WHERE f IS NOT NULL)
        SELECT category, strftime(f, '%Y-%m-%d') AS from_day, strftime(day, '%Y-%m-%d') AS day, round(pct, 6) AS step_percent,
        CASE WHEN pct >= 1.0 THEN 'upp' WHEN pct <= -1.0 THEN 'ned' ELSE 'oforandrad' END AS direction FROM p""",
    "trend_current_run": f"""WITH {_EVENT_DAILY}{_TREND} SELECT category, trend, strength, round(change_percent, 6) AS change_percent,
        round(change, 6) AS change, start_day, end_day, n_days FROM trends""",
    "trend_table": f"""WITH {_CAT}{_TREND} SELECT category, trend, strength, round(change_percent, 6) AS change_percent,
        round(change, 6) AS change, start_day, end_day, n_days, series, 14 AS window_days FROM trends""",
    "trend_counts": f"WITH {_CAT}{_TREND} SELECT trend, count(*) AS n_categories FROM trends GROUP BY 1",
    "trend_report": f"""WITH {_CAT}{_TREND} SELECT category, replace(category, '|', ' | ') || ' | ' ||
        CASE trend WHEN 'upp' THEN 'UPP' WHEN 'ned' THEN 'NED' WHEN 'stabil' THEN 'STABIL' ELSE 'OTILLRACKLIGT_UNDERLAG' END
        || ' | dagar=' || n_days || ' | steg=' || strength || ' | förändring=' || {P.thousands('round_even(change, 0)')} || ' kr ('
        || printf('%+.2f', change_percent) || ' %)' AS line FROM trends""",
    "observation_kinds": f"WITH {_OBS} SELECT kind, count(*) AS n FROM obs GROUP BY 1",
    "listing_trend": f"""WITH {P.LISTINGS}, {_CATEGORY_DAILY.format(where="")}{_TREND}
        SELECT listing_id, coalesce(trend, 'otillrackligt_underlag') AS market_trend, coalesce(strength, 0) AS market_strength,
        round(coalesce(change_percent, 0.0), 6) AS change_percent, round(coalesce(change, 0.0), 6) AS change,
        start_day AS market_start_day, end_day AS market_end_day, coalesce(n_days, 0) AS market_n_days, 14 AS market_window_days
        FROM listings LEFT JOIN trends ON category = model || '|' || lower(variant) || '|' || (model_year + CASE WHEN variant < 'Brand#2' THEN 0 ELSE 50 END)""",
    "state_key": f"WITH {_PART_LISTINGS} SELECT k1, k2, k3, k4, k5, {_KEY.format(year='model_year')} AS state_key FROM pl",
    "state_key_migration": f"WITH {_RUN} SELECT state_key, record_key FROM resolved",
    "state_upsert": f"""WITH {_RUN} SELECT state_key, strftime(first_seen, '%Y-%m-%d') AS first_seen, first_price, last_price,
        strftime(last_seen, '%Y-%m-%d') AS last_seen, notified, notified_price, migrated_from FROM next_state""",
    "state_enrichment": f"""WITH {_RUN} SELECT k1, k2, k3, k4, k5, CAST(days_listed AS INTEGER) AS days_listed, price_drop,
        NOT origin AND price_drop >= 15000 AND days_listed >= 14 AS drop_relevant FROM enriched""",
    "already_alerted": f"""WITH {_RUN} SELECT k1, k2, k3, k4, k5, n.notified AND (n.notified_price IS NULL OR e.price > n.notified_price - 15000) AS suppressed
        FROM enriched e JOIN next_state n USING (state_key)""",
    "alert_decisions": f"{_recursive(_FOLD)} SELECT k1, k2, k3, k4, k5, f.alert FROM enriched e JOIN fold f USING (record_key, seq)",
    "mark_alerted": f"""{_recursive(_FOLD)}, bars AS (SELECT record_key, max(alert) AS any_sent, arg_max(bar, rn) AS bar FROM fold GROUP BY record_key)
        SELECT state_key, notified OR coalesce(any_sent, FALSE) AS notified,
        CASE WHEN any_sent THEN bar ELSE notified_price END AS notified_price FROM next_state LEFT JOIN bars USING (record_key)""",
    "state_load_migration": f"""WITH {_STATE} SELECT state_key, notified, coalesce(notified_price, CASE WHEN notified THEN last_price END) AS notified_price FROM stored""",
    "state_snapshot": f"""WITH {_STATE} SELECT state_key, strftime(first_seen, '%Y-%m-%d') AS first_seen, first_price, last_price,
        strftime(last_seen, '%Y-%m-%d') AS last_seen, notified, coalesce(notified_price, CASE WHEN notified THEN last_price END) AS notified_price FROM stored""",
}
