"""Headline timings: one JSON line. ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "q01_company_ranking", "q02_monthly_trend", "q03_resolution", "q04_size_adjusted", "q05_top_issues",
    "q06_state_profile", "v_company_summary", "v_complaints_enriched", "v_monthly_trend", "v_state_summary",
    "clean_facts", "business_dedupe", "name_map", "entity_match", "company_enriched", "company_features",
    "risk_profile", "chi_square_company", "chi_residuals", "spearman_matrix", "sensitivity",
    "spike_attribution", "group_percentiles", "clean_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from plaintide.bindings.queries import QUERIES
    from plaintide.session import build_session, clear_scratch

    spark = build_session(
        "bench",
        master=f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    chosen = sys.argv[1:] or HEADLINE
    # One untimed query starts the JVM's compiler and the file caches.
    QUERIES["q02_monthly_trend"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in chosen:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_headline_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    clear_scratch(spark)
    spark.stop()


if __name__ == "__main__":
    main()
