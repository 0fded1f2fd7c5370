"""Run registered queries next to their SQL and compare the results.

    python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import hashlib
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _cell(value):
    if value is None:
        return "~"
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(round(value, 6) + 0.0)
    if isinstance(value, bool):
        return str(value)
    return str(value)


def digest(columns: list[str], rows) -> tuple[int, str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted("\x1f".join(_cell(r[i]) for i in order) for r in rows)
    return len(lines), hashlib.sha1("\n".join(lines).encode()).hexdigest()


def compare(spark, con, name, query, sql, sf_dir):
    t = time.time()
    df = query(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    took = time.time() - t
    if sql is None:
        return True, f"{len(rows)} rows (no SQL)", took
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    other = rel.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} vs {sorted(names)}", took
    types = {}
    for i, n in enumerate(names):
        types[n] = {type(r[i]).__name__ for r in other[:2000] if r[i] is not None}
    for i, n in enumerate(df.columns):
        mine = {type(r[i]).__name__ for r in rows[:2000] if r[i] is not None}
        if mine and types[n] and mine != types[n]:
            return False, f"type of {n}: {mine} vs {types[n]}", took
    a, b = digest(df.columns, rows), digest(names, other)
    if a == b:
        return True, f"{a[0]} rows", took
    order_a = sorted(range(len(df.columns)), key=lambda i: df.columns[i])
    order_b = sorted(range(len(names)), key=lambda i: names[i])
    sa = {"|".join(_cell(r[i]) for i in order_a) for r in rows}
    sb = {"|".join(_cell(r[i]) for i in order_b) for r in other}
    return False, (
        f"rows {a[0]} vs {b[0]}\n   columns {sorted(names)}\n   spark only {len(sa - sb)}: {sorted(sa - sb)[:3]}"
        f"\n   sql only   {len(sb - sa)}: {sorted(sb - sa)[:3]}"
    ), took


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from pricelode.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    only = argv[1:]
    spark, con = local_session(8), duck(sf_dir)
    queries, sql, bad = entry.queries(), entry.oracle_sql(), 0
    for name, query in queries.items():
        if only and not any(name == o or (o.endswith("*") and name.startswith(o[:-1])) for o in only):
            continue
        try:
            ok, text, took = compare(spark, con, name, query, sql.get(name), sf_dir)
        except Exception as e:  # noqa: BLE001 - report and go on
            ok, text, took = False, f"{type(e).__name__}: {str(e)[:1500]}", 0.0
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {took:6.2f}s {name}: {text}", flush=True)
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    raise SystemExit(main(sys.argv[1:]))
