"""Command line: run one analysis (or rollup) over stored tables.

    python -m cspulse run churn_risk --customers PATH --activity PATH [--as-of 2024-07-29]
    python -m cspulse run churn_risk_rollup ... --out s3://bucket/reports/churn
    python -m cspulse derive --sf-dir /root/testdata/sf0.1 --out /shared/cspulse

``run`` prints the result, every row of it, or with ``--out`` writes it as
Parquet from the executors: aside, then published as the next version of the
table there, so that readers never see half a result; the folder of the version
is printed, and the one before is kept for its readers.  The customer lists are the top 100 and the cohort
table the latest 24 unless ``--all`` is given; rollups, segments and follow-ups
always cover every customer and cohort.  ``derive`` builds both tables from
the benchmark driver tables and stores them (date-partitioned fact table).
Session settings come from spark-submit / the cluster; nothing is overridden.
"""

from __future__ import annotations

import argparse
import datetime as dt

from . import plans
from .session import build_session
from .sources import (VersionedTable, fixture_tables, load_activity, load_customers, publish, write_activity,
                      write_customers)

LISTS = {
    "customer_health": plans.customer_health,
    "churn_risk": plans.churn_risk,
    "expansion_opportunities": plans.expansion_opportunities,
    "usage_trends": plans.usage_trends,
}
ROLLUPS = {
    "churn_risk_rollup": (plans.churn_risk, plans.churn_risk_rollup),
    "expansion_pipeline_rollup": (plans.expansion_opportunities, plans.expansion_pipeline_rollup),
    "trend_portfolio_rollup": (plans.usage_trends, plans.trend_portfolio_rollup),
}
COHORT_FOLLOW_UPS = {
    "best_cohorts": plans.best_cohorts,
    "worst_cohorts": plans.worst_cohorts,
    "cohort_exec_summary": plans.cohort_exec_summary,
}
NAMES = sorted([*LISTS, *ROLLUPS, *COHORT_FOLLOW_UPS, "cohort_retention",
                "cohort_retention_curve", "customer_segments"])


def build(name: str, customers, activity, as_of: dt.date, limit: int | None):
    """The analysis; ``limit`` cuts the lists only: rollups and follow-ups cover everyone."""
    if name in LISTS:
        return LISTS[name](customers, activity, as_of, limit)
    if name in ROLLUPS:
        analysis, rollup = ROLLUPS[name]
        return rollup(analysis(customers, activity, as_of, None))
    if name == "customer_segments":
        return plans.customer_segments(customers, activity, as_of)
    if name == "cohort_retention":
        return plans.cohort_retention(customers, activity, as_of, limit=plans.cohort_limit(limit))
    if name == "cohort_retention_curve":
        return plans.cohort_retention_curve(customers, activity)
    return COHORT_FOLLOW_UPS[name](plans.cohort_retention(customers, activity, as_of, limit=None))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="python -m cspulse")
    sub = parser.add_subparsers(dest="command", required=True)
    run = sub.add_parser("run", help="run one analysis")
    run.add_argument("analysis", choices=NAMES)
    run.add_argument("--customers", required=True)
    run.add_argument("--activity", required=True)
    run.add_argument("--as-of", type=dt.date.fromisoformat, default=None,
                     help="reference date, YYYY-MM-DD (default: today, like CURRENT_DATE)")
    run.add_argument("--all", action="store_true", help="whole portfolio instead of the top list")
    run.add_argument("--out", help="write the result as Parquet here instead of showing it")
    derive = sub.add_parser("derive", help="derive and store both tables from driver tables")
    derive.add_argument("--sf-dir", required=True)
    derive.add_argument("--out", required=True)
    args = parser.parse_args(argv)

    spark = build_session()
    if args.command == "derive":
        customers, activity = fixture_tables(spark, args.sf_dir)
        write_customers(customers, f"{args.out}/customers")
        write_activity(activity, f"{args.out}/customer_activity")
        return
    customers = load_customers(spark, args.customers)
    activity = load_activity(spark, args.activity)
    as_of = args.as_of or dt.date.today()
    result = build(args.analysis, customers, activity, as_of, None if args.all else 100)
    if args.out:
        version = publish(result, args.out)
        table = VersionedTable(spark, args.out, result.schema)
        table.expire(keep=2)
        print(f"{args.out.rstrip('/')}/{table.manifest(version)['parts']['']}")
    else:  # every row, a partition at a time
        print("\t".join(result.columns))
        for row in result.toLocalIterator():
            print("\t".join("" if v is None else str(v) for v in row))


if __name__ == "__main__":
    main()
