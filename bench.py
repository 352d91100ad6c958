"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from vintara.plans import catalog, stored  # noqa: E402
from vintara.session import local_session  # noqa: E402

HEADLINE = (
    "p12_panel", "p13_panel_report", "v2_v5_cohort_curves", "l1_l2_severity", "z5_realised_npv",
    "n3_n4_loan_npv", "k10_population_scores", "j4_j6_portfolio_npv", "d2_cutoff_curve",
    "a4_a5_ablation", "h1_hazard_fit",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "vintara-bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    registered, seconds = catalog.queries(), {}
    # The shared stored tables are timed on their own, not inside the first query.
    for name, write in (("store_months", stored.months_of), ("store_panel", stored.panel_of)):
        begin = time.perf_counter()
        write(spark, folder)
        seconds[name] = round(time.perf_counter() - begin, 3)
    for name in HEADLINE:
        begin = time.perf_counter()
        registered[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - begin, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
