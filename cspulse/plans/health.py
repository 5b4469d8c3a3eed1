"""Customer health scoring (weighted usage / support / engagement score).

Plan: one scan of the trailing 30 days -> per-customer partial+final
aggregate -> rule expressions -> join with Active customers -> top-k.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import round_num
from ..functions.sql import named
from ..operators.enrich import enrich, top_k
from ..operators.periods import recent_activity

RAW = ["avg_usage_score", "avg_logins", "total_tickets", "avg_nps"]


def health_dimensions(recent: DataFrame) -> DataFrame:
    """Unrounded usage, support and engagement health per customer."""
    return recent.selectExpr(
        "customer_id",
        "COALESCE(avg_usage_score, 0) AS usage_health",
        named(rules.support_health("total_tickets"), "support_health"),
        named(rules.engagement_health("avg_logins", "avg_nps"), "engagement_health"),
        *RAW)


def health_scores(dims: DataFrame, weights: dict = rules.HEALTH_WEIGHTS) -> DataFrame:
    """Rounded dimensions and the weighted overall score (from unrounded inputs)."""
    return dims.selectExpr(
        "customer_id",
        "ROUND(usage_health, 1) AS usage_health_score",
        named(round_num("support_health", 1), "support_health_score"),
        named(round_num("engagement_health", 1), "engagement_health_score"),
        named(rules.weighted_health("usage_health", "support_health", "engagement_health",
                                    weights), "overall_health_score"),
        *RAW)


def grade_and_action(score: str = "overall_health_score") -> list[str]:
    return [named(rules.at_least(score, rules.HEALTH_GRADES), "health_grade"),
            named(rules.at_least(score, rules.HEALTH_ACTIONS), "recommended_action")]


def customer_health(customers: DataFrame, activity: DataFrame, as_of: dt.date,
                    limit: int | None = 100, days: int = 30,
                    weights: dict = rules.HEALTH_WEIGHTS) -> DataFrame:
    """Health scores; the ``limit`` lowest in order, ``None``: everyone, unsorted."""
    return health_report(customers, recent_activity(activity, as_of, days), limit, weights)


def health_report(customers: DataFrame, recent: DataFrame, limit: int | None = 100,
                  weights: dict = rules.HEALTH_WEIGHTS) -> DataFrame:
    """Health analysis from per-customer 30-day measures (``recent_activity`` shape)."""
    scores = health_scores(health_dimensions(recent), weights)
    out = enrich(scores, customers, ["company_name", "plan_type", "mrr", "account_owner"],
                 statuses=["Active"]).selectExpr(
        "customer_id", "company_name", "plan_type", "mrr", "account_owner",
        "overall_health_score", "usage_health_score", "support_health_score",
        "engagement_health_score", *grade_and_action(),
        "ROUND(avg_usage_score, 1) AS avg_feature_usage",
        "ROUND(avg_logins, 1) AS avg_weekly_logins",
        "total_tickets AS tickets_last_30d",
        "ROUND(avg_nps, 1) AS avg_nps_score")
    return top_k(out, [F.col("overall_health_score").asc(), F.col("mrr").desc_nulls_first(),
                       F.col("customer_id").asc()], limit)
