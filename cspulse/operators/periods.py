"""Date-bounded filters and per-customer period aggregates.

All bounds are date literals computed from ``as_of``, so they reach the
Parquet scan as pushed filters (or partition pruning when the fact table is
partitioned by ``activity_date``).  Aggregates are algebraic (sum and
count), so Spark runs them as partial + final hash aggregation: a customer
holding a large share of the rows is reduced map-side before the shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame

from ..functions.numeric import avg_exact
from ..functions.sql import col, lit

DATE = "activity_date"
KEY = "customer_id"


def days_before(as_of: dt.date, days: int) -> dt.date:
    return as_of - dt.timedelta(days=days)


def since(as_of: dt.date, days: int) -> str:
    return f"{DATE} >= {lit(days_before(as_of, days))}"


def before(as_of: dt.date, days: int) -> str:
    return f"{DATE} < {lit(days_before(as_of, days))}"


# --------------------------------------------------------------------- filters


def trailing_window(act: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """``activity_date >= as_of - days``; no upper bound (later rows included)."""
    return act.filter(since(as_of, days))


def half_open_period(act: DataFrame, as_of: dt.date, start_days: int, end_days: int) -> DataFrame:
    """``as_of - start_days <= activity_date < as_of - end_days``."""
    return act.filter(f"{since(as_of, start_days)} AND {before(as_of, end_days)}")


def status_in(df: DataFrame, statuses=("Active", "At Risk")) -> DataFrame:
    return df.filter(f"status IN ({', '.join(lit(s) for s in statuses)})")


# ------------------------------------------------------------------ aggregates

_MEASURES = {"usage": "feature_usage_score", "logins": "logins_count",
             "tickets": "support_tickets_opened", "nps": "nps_score"}


def _only(cond: str | None, column: str) -> str:
    return column if cond is None else f"CASE WHEN {cond} THEN {column} END"


def measure_aggs(names: dict[str, str], cond: str | None = None) -> list[Column]:
    """Per-customer measures over the rows where ``cond`` holds.

    ``names`` maps a measure (usage, logins, tickets, nps, rows) to its output
    column, in output order.
    """
    out = []
    for measure, name in names.items():
        if measure == "rows":
            out.append(col(f"COUNT({_only(cond, '1')})", name))
        elif measure == "tickets":
            out.append(col(f"SUM({_only(cond, _MEASURES[measure])})", name))
        else:
            out.append(col(avg_exact(_only(cond, _MEASURES[measure])), name))
    return out


RECENT_NAMES = {"usage": "avg_usage_score", "logins": "avg_logins", "tickets": "total_tickets",
                "nps": "avg_nps", "rows": "weeks_with_activity"}
CURRENT_NAMES = {"logins": "current_avg_logins", "usage": "current_avg_usage",
                 "tickets": "current_tickets", "nps": "current_avg_nps",
                 "rows": "current_weeks_active"}
PRIOR_NAMES = {"logins": "prior_avg_logins", "usage": "prior_avg_usage",
               "tickets": "prior_tickets", "nps": "prior_avg_nps"}
EXPANSION_RECENT_NAMES = {"logins": "avg_logins", "usage": "avg_usage_score",
                          "tickets": "total_tickets", "nps": "avg_nps", "rows": "weeks_active"}


def recent_activity(act: DataFrame, as_of: dt.date, days: int = 30,
                    names: dict[str, str] = RECENT_NAMES) -> DataFrame:
    """Per-customer 30-day measures (health and expansion inputs)."""
    return trailing_window(act, as_of, days).groupBy(KEY).agg(*measure_aggs(names))


def current_metrics(act: DataFrame, as_of: dt.date, weeks: int = 4) -> DataFrame:
    """Last ``weeks`` weeks before ``as_of`` (``as_of`` itself excluded)."""
    return (half_open_period(act, as_of, 7 * weeks, 0)
            .groupBy(KEY).agg(*measure_aggs(CURRENT_NAMES)))


def prior_metrics(act: DataFrame, as_of: dt.date, weeks: int = 4) -> DataFrame:
    """The ``weeks`` weeks before the current period."""
    return (half_open_period(act, as_of, 14 * weeks, 7 * weeks)
            .groupBy(KEY).agg(*measure_aggs(PRIOR_NAMES)))


def period_over_period(act: DataFrame, as_of: dt.date, weeks: int = 4) -> DataFrame:
    """Literal form: current period LEFT JOIN prior period on customer.

    Two scans and a join; ``churn_period_metrics`` computes the same rows in
    one scan and one aggregation.
    """
    return current_metrics(act, as_of, weeks).join(prior_metrics(act, as_of, weeks), KEY, "left")


def churn_period_metrics(act: DataFrame, as_of: dt.date, weeks: int = 4) -> DataFrame:
    """Current and prior period measures in one pass.

    One scan of the last ``2*weeks`` weeks and conditional aggregates; keeping
    customers with at least one current row reproduces the left join from
    the current period (a customer silent in the current period is absent).
    """
    cur, prior = since(as_of, 7 * weeks), before(as_of, 7 * weeks)
    return (half_open_period(act, as_of, 14 * weeks, 0)
            .groupBy(KEY)
            .agg(*measure_aggs(CURRENT_NAMES, cur), *measure_aggs(PRIOR_NAMES, prior))
            .filter("current_weeks_active > 0"))


def usage_trend_60d(act: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Recent (>= as_of-30d) vs prior ([as_of-60d, as_of-30d)) usage and logins."""
    recent, prior = since(as_of, days), before(as_of, days)
    return (trailing_window(act, as_of, 2 * days).groupBy(KEY)
            .agg(*measure_aggs({"logins": "recent_logins"}, recent),
                 *measure_aggs({"logins": "prior_logins"}, prior),
                 *measure_aggs({"usage": "recent_usage"}, recent),
                 *measure_aggs({"usage": "prior_usage"}, prior)))


def expansion_period_metrics(act: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """30-day measures and the 60-day usage trend in one pass.

    The recent band keeps the reference's open upper bound.  Customers need
    at least one recent row (the inner side of the reference's join); the
    trend side always matches because its rows include the recent ones.
    """
    recent, prior = since(as_of, days), before(as_of, days)
    return (trailing_window(act, as_of, 2 * days).groupBy(KEY)
            .agg(*measure_aggs(EXPANSION_RECENT_NAMES, recent),
                 *measure_aggs({"usage": "recent_usage"}, recent),
                 *measure_aggs({"usage": "prior_usage"}, prior))
            .filter("weeks_active > 0"))


def activity_partials(act: DataFrame, as_of: dt.date, days: int = 30) -> DataFrame:
    """Per-customer sums and counts over the trailing window.

    Lets a row-weighted average over a *group of customers* (a cohort) be
    computed from one small row per customer: the fact table is reduced
    before it is joined, so a heavy customer never travels as raw rows.
    """
    aggs = []
    for name, column in (("logins", "logins_count"), ("usage", "feature_usage_score"),
                         ("nps", "nps_score")):
        aggs += [col(f"SUM({column})", f"{name}_sum"), col(f"COUNT({column})", f"{name}_n")]
    aggs.append(col("SUM(support_tickets_opened)", "tickets_sum"))
    return trailing_window(act, as_of, days).groupBy(KEY).agg(*aggs)
