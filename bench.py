"""Benchmark the headline analyses.

Runs each headline query of the catalog on ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` and prints ONE JSON line:
{"metric": ..., "value": total seconds, "unit": "sec", "queries": {...}, "sf": ...}.
All queries first run once to warm the JVM, then ``$BENCH_RUNS`` (default 3)
interleaved timed rounds follow; the median per query is reported.  A run
builds the DataFrame (derivation from the driver tables included) and
executes the whole plan into Spark's no-op sink, so nothing is collected to
the driver.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cspulse import plans  # noqa: E402
from cspulse.catalog import AS_OF, queries, tables  # noqa: E402
from cspulse.operators.windows import weekly_window_metrics  # noqa: E402
from cspulse.plans import churn, portfolio_report  # noqa: E402
from cspulse.session import build_session, release  # noqa: E402
from cspulse.sources import (load_activity, load_customers, write_activity,  # noqa: E402
                             write_customers)
from cspulse.sources.blocks import stored_window_metrics, write_blocks  # noqa: E402
from cspulse.state import CohortVisits, RunningTotals  # noqa: E402

HEADLINE = ["customer_health", "churn_risk", "expansion_opportunities", "usage_trends",
            "cohort_retention", "cohort_retention_curve", "churn_risk_rollup",
            "trend_portfolio_rollup", "cohort_exec_summary", "weekly_window_metrics"]
# Health, churn and expansion from one shared scan (compare with the sum of the three).
PORTFOLIO = "portfolio_health_churn_expansion"
# The same analyses on stored, date-partitioned tables.
STORED = {
    "customer_health_stored": lambda c, a: plans.customer_health(c, a, AS_OF),
    "churn_risk_stored": lambda c, a: plans.churn_risk(c, a, AS_OF),
    "expansion_opportunities_stored": lambda c, a: plans.expansion_opportunities(c, a, AS_OF),
    "usage_trends_stored": lambda c, a: plans.usage_trends(c, a, AS_OF),
    "cohort_retention_stored": lambda c, a: plans.cohort_retention(c, a, AS_OF),
    "cohort_retention_curve_stored": lambda c, a: plans.cohort_retention_curve(c, a),
    "weekly_window_metrics_stored": lambda c, a: weekly_window_metrics(a, AS_OF),
}


# What a dashboard that runs every week pays: results from state that was stored before.
STATE = {
    "cohort_retention_curve_state": lambda s: s["visits"].curve(),
    "churn_risk_totals": lambda s: churn.churn_report(s["customers"], s["totals"].churn_period_metrics(AS_OF)),
    "weekly_window_metrics_blocks": lambda s: stored_window_metrics(s["spark"], s["blocks"], AS_OF),
}


def stored_state(spark, customers, activity, root: str) -> dict:
    """The state tables below ``root``, filled from the stored tables."""
    visits, totals = CohortVisits(spark, f"{root}/visits"), RunningTotals(spark, f"{root}/totals")
    visits.rebuild(customers, activity)
    totals.extend(activity)
    name = write_blocks(activity, "bench_blocks", buckets=8, path=f"{root}/blocks")
    return {"spark": spark, "customers": customers, "visits": visits, "totals": totals, "blocks": name}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = [k for k in os.environ.get("BENCH_QUERIES", "").split(",") if k]
    spark = build_session(f"local[{cpus}]", app_name="cspulse-bench",
                          shuffle_partitions=cpus,
                          extra={"spark.driver.memory": os.environ.get("BENCH_MEM", "8g")})
    catalog = queries()
    keys = only or [*HEADLINE, PORTFOLIO, *STORED, *STATE]
    stored = state = None
    if any(key in STORED or key in STATE for key in keys):
        root = tempfile.mkdtemp(prefix="cspulse-bench-")
        customers, activity = tables(spark, sf_dir)
        write_customers(customers, f"{root}/customers")
        write_activity(activity, f"{root}/activity")
        stored = load_customers(spark, f"{root}/customers"), load_activity(spark, f"{root}/activity")
        if any(key in STATE for key in keys):
            state = stored_state(spark, *stored, root)

    def run(key: str) -> float:
        t0 = time.perf_counter()
        if key == PORTFOLIO:
            customers, activity = tables(spark, sf_dir)
            reports = portfolio_report(customers, activity, AS_OF, include_trends=False,
                                       include_cohorts=False)
            metrics = reports.pop("customer_metrics")
            for df in reports.values():
                df.write.format("noop").mode("overwrite").save()
            release(metrics)
        elif key in STORED:
            STORED[key](*stored).write.format("noop").mode("overwrite").save()
        elif key in STATE:
            STATE[key](state).write.format("noop").mode("overwrite").save()
        else:
            catalog[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for key in keys:
        run(key)
    samples: dict[str, list[float]] = {key: [] for key in keys}
    for _ in range(runs):
        for key in keys:
            samples[key].append(run(key))
    timings = {key: round(statistics.median(v), 4) for key, v in samples.items()}
    match = re.search(r"sf([0-9.]+)", sf_dir)
    total = sum(v for k, v in timings.items() if k in HEADLINE)
    print(json.dumps({"metric": "headline_query_median_total", "value": round(total, 4),
                      "unit": "sec", "queries": timings,
                      "sf": float(match.group(1)) if match else sf_dir, "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
