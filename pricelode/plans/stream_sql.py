"""SQL for the queries of :mod:`pricelode.plans.stream_queries`."""

from pricelode.plans import sql_parts as P

_PL = f"""{P.LISTINGS}, pl AS (SELECT seq, model, variant, model_year, mileage, price, CASE WHEN k2 <> 5 THEN CAST(k3 AS VARCHAR) END AS lid FROM listings)"""

# Two batches, each a fold over its rows in input order; the second one goes on from the state of the first.
_TWO = f"""{_PL}, k AS (SELECT *, coalesce('annons:' || lid, old_key) AS state_key, CASE WHEN model_year < 1999 THEN 0 ELSE 1 END AS batch
    FROM (SELECT *, 'kal:' || model || ':' || variant || ':' || model_year || ':' || mileage AS old_key FROM pl)),
  keys AS (SELECT batch, state_key, min(seq) AS fseq, arg_min(old_key, seq) AS old_key, arg_min(price, seq) AS fp, max(seq) AS lseq, arg_max(price, seq) AS lp
    FROM k GROUP BY batch, state_key),
  creators AS (SELECT * FROM keys WHERE state_key = old_key),
  rec0 AS (SELECT a.*, CASE WHEN a.state_key <> a.old_key AND c.fseq < a.fseq THEN a.old_key ELSE a.state_key END AS rec
    FROM keys a LEFT JOIN creators c ON c.batch = 0 AND c.state_key = a.old_key WHERE a.batch = 0),
  rows0 AS (SELECT rec, price, row_number() OVER (PARTITION BY rec ORDER BY seq) AS rn FROM k JOIN (SELECT state_key, rec FROM rec0) USING (state_key) WHERE batch = 0),
  fold0 AS (SELECT rec, rn, price AS bar FROM rows0 WHERE rn = 1
    UNION ALL SELECT n.rec, n.rn, CASE WHEN n.price <= bar - 15000 THEN n.price ELSE bar END FROM fold0 f JOIN rows0 n ON n.rec = f.rec AND n.rn = f.rn + 1),
  s0 AS (SELECT r.state_key, g.first_price, g.last_price, b.bar FROM rec0 r
    JOIN (SELECT rec, max(CASE WHEN state_key = rec THEN fp END) AS first_price, arg_max(lp, lseq) AS last_price FROM rec0 GROUP BY rec) g USING (rec)
    JOIN (SELECT rec, arg_max(bar, rn) AS bar FROM fold0 GROUP BY rec) b USING (rec)),
  rec1 AS (SELECT a.*, CASE WHEN s.state_key IS NOT NULL THEN a.state_key
      WHEN a.state_key <> a.old_key AND (o.state_key IS NOT NULL OR coalesce(c.fseq < a.fseq, FALSE)) THEN a.old_key ELSE a.state_key END AS rec
    FROM keys a LEFT JOIN s0 s ON s.state_key = a.state_key LEFT JOIN s0 o ON o.state_key = a.old_key
      LEFT JOIN creators c ON c.batch = 1 AND c.state_key = a.old_key WHERE a.batch = 1),
  rows1 AS (SELECT rec, price, row_number() OVER (PARTITION BY rec ORDER BY seq) AS rn FROM k JOIN (SELECT state_key, rec FROM rec1) USING (state_key) WHERE batch = 1),
  fold1 AS (SELECT n.rec, n.rn, CASE WHEN s.bar IS NULL OR n.price <= s.bar - 15000 THEN n.price ELSE s.bar END AS bar
      FROM rows1 n LEFT JOIN s0 s ON s.state_key = n.rec WHERE n.rn = 1
    UNION ALL SELECT n.rec, n.rn, CASE WHEN n.price <= bar - 15000 THEN n.price ELSE bar END FROM fold1 f JOIN rows1 n ON n.rec = f.rec AND n.rn = f.rn + 1),
  g1 AS (SELECT r.rec, CASE WHEN s.state_key IS NOT NULL THEN s.first_price ELSE r.origin END AS first_price, r.last_price, b.bar
    FROM (SELECT rec, max(CASE WHEN state_key = rec THEN fp END) AS origin, arg_max(lp, lseq) AS last_price FROM rec1 GROUP BY rec) r
      JOIN (SELECT rec, arg_max(bar, rn) AS bar FROM fold1 GROUP BY rec) b USING (rec) LEFT JOIN s0 s ON s.state_key = r.rec),
  changed AS (SELECT state_key, first_price, last_price, bar FROM rec1 JOIN g1 USING (rec)
    UNION ALL SELECT rec, first_price, last_price, bar FROM g1 WHERE rec NOT IN (SELECT state_key FROM rec1))"""

ORACLES = {
    "stream_intake": f"""WITH RECURSIVE {_TWO} SELECT state_key, first_price, last_price, TRUE AS notified, bar AS notified_price
        FROM (SELECT * FROM changed UNION ALL SELECT * FROM s0 WHERE state_key NOT IN (SELECT state_key FROM changed))""",
    # One batch with all files: per id the rows in input order, each compared with the last alert.
    "stream_keyed_alerts": f"""WITH RECURSIVE {_PL}, n AS (SELECT 'annons:' || lid AS state_key, price, row_number() OVER (PARTITION BY lid ORDER BY seq) AS rn
          FROM pl WHERE lid IS NOT NULL),
        fold AS (SELECT state_key, rn, price AS bar, 1 AS alerts FROM n WHERE rn = 1
          UNION ALL SELECT n.state_key, n.rn, CASE WHEN n.price <= bar - 15000 THEN n.price ELSE bar END, alerts + CASE WHEN n.price <= bar - 15000 THEN 1 ELSE 0 END
          FROM fold f JOIN n ON n.state_key = f.state_key AND n.rn = f.rn + 1)
        SELECT n.state_key, count(*) AS n_seen, arg_min(price, n.rn) AS first_price, arg_max(price, n.rn) AS last_price,
          CAST(arg_max(alerts, n.rn) AS BIGINT) AS n_alerts, arg_max(bar, n.rn) AS alert_price
        FROM n JOIN fold f ON n.state_key = f.state_key AND n.rn = f.rn GROUP BY 1""",
    "state_from_empty": f"""WITH {_PL}, k AS (SELECT *, coalesce('annons:' || lid, old_key) AS state_key FROM
          (SELECT *, 'kal:' || model || ':' || variant || ':' || model_year || ':' || mileage AS old_key FROM pl)),
        keys AS (SELECT state_key, min(seq) AS fseq, arg_min(old_key, seq) AS old_key, arg_min(price, seq) AS fp, max(seq) AS lseq, arg_max(price, seq) AS lp FROM k GROUP BY 1),
        r AS (SELECT k.*, CASE WHEN k.state_key <> k.old_key AND c.fseq < k.fseq THEN k.old_key ELSE k.state_key END AS rec
          FROM keys k LEFT JOIN keys c ON c.state_key = k.old_key AND c.state_key = c.old_key),
        g AS (SELECT rec, max(CASE WHEN state_key = rec THEN fp END) AS first_price, arg_max(lp, lseq) AS last_price FROM r GROUP BY rec)
        SELECT state_key, first_price, last_price FROM r JOIN g USING (rec)""",
}
