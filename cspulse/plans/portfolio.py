"""Run the per-customer analyses of a portfolio off one scan of the fact table.

Health, churn and expansion each read 30 to 60 days of ``customer_activity``
and reduce it per customer.  ``customer_metrics`` computes all of their
period measures in one pass over the last 60 days (conditional aggregates
per band, partial + final aggregation, one shuffle by customer), and
``portfolio_report`` writes that one-row-per-customer table once to the
shared checkpoint folder and derives every report from it: the fact table is
scanned and shuffled once instead of three times, and the reports no longer
depend on the fact table's lineage.  Results are identical to the
stand-alone analyses (``tests/test_properties.py``).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions.sql import col
from ..operators.periods import (CURRENT_NAMES, PRIOR_NAMES, RECENT_NAMES, KEY, before,
                                 measure_aggs, since, trailing_window)
from ..session import materialize
from .churn import churn_report
from .cohorts import cohort_limit, cohort_retention
from .expansion import expansion_report
from .health import health_report
from .trends import usage_trends

RECENT_DAYS, PRIOR_DAYS, WEEKS = 30, 60, 4


def customer_metrics(activity: DataFrame, as_of: dt.date) -> DataFrame:
    """One row per customer with every band the health, churn and expansion analyses use."""
    recent = since(as_of, RECENT_DAYS)                                   # open upper bound
    current = f"{since(as_of, 7 * WEEKS)} AND {before(as_of, 0)}"
    prior = f"{since(as_of, 14 * WEEKS)} AND {before(as_of, 7 * WEEKS)}"
    prior_month = before(as_of, RECENT_DAYS)
    return (trailing_window(activity, as_of, PRIOR_DAYS).groupBy(KEY)
            .agg(*measure_aggs(RECENT_NAMES, recent),
                 *measure_aggs(CURRENT_NAMES, current),
                 *measure_aggs(PRIOR_NAMES, prior),
                 *measure_aggs({"usage": "prior_usage"}, prior_month)))


def portfolio_report(customers: DataFrame, activity: DataFrame, as_of: dt.date,
                     limit: int | None = 100, include_trends: bool = True,
                     include_cohorts: bool = True) -> dict[str, DataFrame]:
    """The five reports; ``limit=None`` gives every customer, unsorted, and every cohort.

    Writes the per-customer table when called.  ``release(reports["customer_metrics"])``
    deletes it once the reports are done with.
    """
    metrics = materialize(customer_metrics(activity, as_of), "customer-metrics")
    recent = metrics.filter("weeks_with_activity > 0")
    reports = {
        "customer_metrics": metrics,
        "customer_health": health_report(customers, recent.select(KEY, *RECENT_NAMES.values()),
                                         limit),
        "churn_risk": churn_report(
            customers, metrics.filter("current_weeks_active > 0")
            .select(KEY, *CURRENT_NAMES.values(), *PRIOR_NAMES.values()), limit),
        "expansion_opportunities": expansion_report(
            customers, recent.select(KEY, "avg_logins", "avg_usage_score", "total_tickets",
                                     "avg_nps", col("weeks_with_activity", "weeks_active"),
                                     col("avg_usage_score", "recent_usage"), "prior_usage"),
            as_of, limit),
    }
    if include_trends:
        reports["usage_trends"] = usage_trends(customers, activity, as_of, limit)
    if include_cohorts:
        reports["cohort_retention"] = cohort_retention(customers, activity, as_of,
                                                       limit=cohort_limit(limit))
    return reports
