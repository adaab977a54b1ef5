"""Headline-query benchmark.

Runs the headline queries on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1)
with ``local[$BENCH_CPUS]`` and prints one JSON line:
{"metric": "total_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...}

Each query is executed in full with the ``noop`` sink (no collect).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "c1_project_totals",
    "c3_language_breakdown",
    "c5_codebase_signature",
    "d3_pack_chunks",
    "e1_rule_findings",
    "e5_findings",
    "e10_dedup",
    "e11_rank",
    "e14_review_record",
    "f2_pending_chunks",
    "g1_normalize_catalog",
    "g3_rank_models",
    "h6_scan_secrets",
    "j1_changed_files",
    "s1_rate_per_minute",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from revlens.plans.queries import QUERIES
    from revlens.plans.review_plan import offline_review
    from revlens.plans.session import local_session

    spark = local_session(cpus=cpus, app="revlens-bench", partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # JVM / code-generation / Python worker warm-up (not timed)
    spark.read.parquet(f"{sf_dir}/region.parquet").write.format("noop").mode("overwrite").save()
    QUERIES["a3_corpus_from_table"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    QUERIES["h1_sanitize"](spark, sf_dir).write.format("noop").mode("overwrite").save()   # Python workers

    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t, 3)
    t = time.time()
    offline_review(spark, sf_dir).reviews.write.format("noop").mode("overwrite").save()
    times["flagship_offline_review"] = round(time.time() - t, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
