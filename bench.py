"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. Every query is run to its last row
(``noop`` sink); planning and the writes of its intermediate tables are inside its time.
Shared inputs (the site, month and draw tables, a fit) are charged to the query that first
needs them, so they are listed first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sitesight.plans.registry import QUERIES  # noqa: E402
from sitesight.plans.shared_tables import draws_fact, site_fact, site_month  # noqa: E402
from sitesight.session import local_session  # noqa: E402

HEADLINE = [
    "pooled_rate_rollup", "shrunk_rates", "failures_share_rank", "prioritisation_share", "prioritisation_impact",
    "cumulative_impact", "what_if_worst_decile", "management_report", "monthly_rates", "improved_municipalities",
    "hdi_95", "hdi_spread", "hdi_municipality", "quantile_summary", "full_summary", "draws_needed", "prob_greater",
    "rank_histogram", "posterior_fixed_precision", "posterior_three_level", "posterior_by_year",
    "posterior_sites_full", "prioritisation_posterior", "posterior_draws", "dic", "success_factors",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "sitesight-bench")
    only = sys.argv[1:]
    warm_up = lambda s, d: s.range(1000).selectExpr("id % 7 AS k").groupBy("k").count()
    shared = {"session_warm_up": warm_up, "build_site_table": site_fact, "build_month_table": site_month, "build_draws_table": draws_fact}
    work = {**shared, **{name: QUERIES[name] for name in HEADLINE if not only or name in only}}
    times: dict[str, float] = {}
    for name, query in work.items():
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:32s} {times[name]:8.3f}", file=sys.stderr, flush=True)
    spark.stop()
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
