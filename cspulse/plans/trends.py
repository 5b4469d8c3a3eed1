"""Usage trends: week-over-week and 4-row rolling comparisons per customer.

Plan: one scan of 12 weeks -> row_number per customer limited to 8 rows
(partial WindowGroupLimit before the shuffle) -> conditional aggregate on the
same partitioning (no second exchange) -> trend rules -> join -> top-k.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import pct_change, round_num
from ..functions.sql import named
from ..operators.enrich import enrich, top_k
from ..operators.windows import recent_trends


def trend_analysis(trends: DataFrame) -> DataFrame:
    return trends.selectExpr(
        "customer_id",
        "current_logins", "prev_logins",
        named(pct_change("current_logins", "prev_logins"), "wow_login_change_pct"),
        "current_usage", "prev_usage",
        named(pct_change("current_usage", "prev_usage"), "wow_usage_change_pct"),
        "current_4wk_avg_logins", "baseline_4wk_logins",
        named(pct_change("current_4wk_avg_logins", "baseline_4wk_logins"),
              "four_week_login_trend_pct"),
        "current_4wk_avg_usage", "baseline_4wk_usage",
        named(pct_change("current_4wk_avg_usage", "baseline_4wk_usage"),
              "four_week_usage_trend_pct"),
        "active_weeks_count")


def trend_scores(analysis: DataFrame) -> DataFrame:
    scored = analysis.selectExpr(
        "*",
        named(rules.trend_points("four_week_usage_trend_pct", rules.USAGE_TREND_POINTS),
              "usage_trend_score"),
        named(rules.trend_points("four_week_login_trend_pct", rules.LOGIN_TREND_POINTS),
              "login_trend_score"),
        named(rules.at_least("active_weeks_count", rules.CONSISTENCY_POINTS),
              "consistency_score"))
    # computed once, reused by the category, the action and the sort
    return scored.selectExpr(
        "*", "usage_trend_score + login_trend_score + consistency_score AS overall_trend_score")


def usage_trends(customers: DataFrame, activity: DataFrame, as_of: dt.date,
                 limit: int | None = 100, weeks: int = 12,
                 statuses=("Active", "At Risk")) -> DataFrame:
    """Usage trends; the ``limit`` sharpest declines in order, ``None``: everyone, unsorted."""
    scores = trend_scores(trend_analysis(recent_trends(activity, as_of, weeks)))
    total = "overall_trend_score"
    out = enrich(scores, customers,
                 ["company_name", "plan_type", "mrr", "account_owner", "status"],
                 statuses=list(statuses)).selectExpr(
        "customer_id", "company_name", "plan_type", "mrr", "account_owner", "status",
        total,
        named(rules.at_least(total, rules.TREND_CATEGORIES), "trend_category"),
        named(round_num("current_usage", 1), "current_week_usage"),
        named(round_num("current_logins", 1), "current_week_logins"),
        "wow_usage_change_pct AS wow_usage_change",
        "wow_login_change_pct AS wow_login_change",
        "ROUND(current_4wk_avg_usage, 1) AS four_week_avg_usage",
        "four_week_usage_trend_pct AS usage_trend_4wk",
        "ROUND(current_4wk_avg_logins, 1) AS four_week_avg_logins",
        "four_week_login_trend_pct AS login_trend_4wk",
        "active_weeks_count AS active_weeks_last_8",
        named(rules.at_least("active_weeks_count", rules.CONSISTENCY_LABELS),
              "engagement_consistency"),
        named(rules.at_least(total, rules.TREND_ACTIONS), "recommended_action"))
    return top_k(out, [F.col(total).asc(), F.col("mrr").desc_nulls_first(),
                       F.col("customer_id").asc()], limit)
