"""Print the physical operator trees of the headline analyses on stored tables.

Usage: python tools/plans.py SF_DIR OUT_DIR > docs/PLANS.md

Derives both tables from the driver Parquet files in SF_DIR, stores them in
OUT_DIR (a fresh folder) and prints the operator tree of ``explain("formatted")`` plus the scan
details (pruned partitions, pushed filters, read schema) for each analysis.
Broadcast joins are disabled for the printout so the trees show the plan a
large dimension table gets.
"""

from __future__ import annotations

import contextlib
import datetime as dt
import io
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from cspulse.operators.windows import weekly_window_metrics  # noqa: E402
from cspulse.plans import (churn_risk, churn_risk_rollup, cohort_exec_summary,  # noqa: E402
                           cohort_retention, cohort_retention_curve, customer_health,
                           customer_metrics, expansion_opportunities, percentile_metrics,
                           trend_portfolio_rollup, usage_trends)
from cspulse.session import build_session  # noqa: E402
from cspulse.sources import (fixture_tables, load_activity, load_customers,  # noqa: E402
                             write_activity, write_customers)

AS_OF = dt.date(2024, 7, 29)
ANALYSES = {
    "customer_health": lambda c, a: customer_health(c, a, AS_OF),
    "churn_risk": lambda c, a: churn_risk(c, a, AS_OF),
    "expansion_opportunities": lambda c, a: expansion_opportunities(c, a, AS_OF),
    "usage_trends": lambda c, a: usage_trends(c, a, AS_OF),
    "cohort_retention": lambda c, a: cohort_retention(c, a, AS_OF),
    "cohort_retention_curve": lambda c, a: cohort_retention_curve(c, a),
    "weekly_window_metrics": lambda c, a: weekly_window_metrics(a, AS_OF),
    "customer_metrics (shared by the portfolio report)": lambda c, a: customer_metrics(a, AS_OF),
    "churn_risk_rollup": lambda c, a: churn_risk_rollup(churn_risk(c, a, AS_OF, limit=None)),
    "trend_portfolio_rollup":
        lambda c, a: trend_portfolio_rollup(usage_trends(c, a, AS_OF, limit=None)),
    "cohort_exec_summary":
        lambda c, a: cohort_exec_summary(cohort_retention(c, a, AS_OF, limit=None)),
    "percentile_metrics": percentile_metrics,
}


def tree(df) -> str:
    buffer = io.StringIO()
    with contextlib.redirect_stdout(buffer):
        df.explain("formatted")
    head, _, details = buffer.getvalue().partition("\n\n\n")
    scans = [re.sub(r"#\d+", "", line).strip() for line in details.splitlines()
             if line.startswith(("PartitionFilters", "PushedFilters", "ReadSchema"))]
    head = re.sub(r" \(\d+\)", "", head)
    return head.rstrip() + "\n\n" + "\n".join(f"    {s}" for s in scans)


def main(sf_dir: str, out_dir: str) -> None:
    spark = build_session("local[4]", shuffle_partitions=4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    cust, act = fixture_tables(spark, sf_dir)
    write_customers(cust, f"{out_dir}/customers")
    write_activity(act, f"{out_dir}/activity")
    c, a = load_customers(spark, f"{out_dir}/customers"), load_activity(spark, f"{out_dir}/activity")
    print("# Physical plans of the headline analyses\n")
    print("Generated by `tools/plans.py` (sf0.01 fixtures, broadcast joins disabled so the"
          " trees show the plan a large customer table gets).\n")
    for name, build in ANALYSES.items():
        print(f"## {name}\n\n```\n{tree(build(c, a))}\n```\n")
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1], sys.argv[2])
