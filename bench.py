"""Headline queries on $BENCH_SF_DIR with $BENCH_CPUS cores; prints one JSON line.

Each query is run to completion into a no-op sink (every row and column is
computed), after one warm-up of the session on the smallest query.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pricelode.plans.registry import queries  # noqa: E402
from pricelode.session import local_session  # noqa: E402

HEADLINE = (
    "bargain_classes", "total_score", "candidate_funnel", "market_basis_counts", "requirement_filter",
    "history_metrics", "trend_table", "daily_median_categories", "state_upsert", "alert_decisions",
    "fingerprint_scores", "labelled_cards", "detail_facts", "variant_of_text", "duplicate_groups", "merged_listings",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "pricelode-bench")
    known = queries()
    known["observation_kinds"](spark, sf_dir).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        known[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
