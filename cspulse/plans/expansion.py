"""Expansion readiness: plan ceiling, adoption, growth, satisfaction, mastery.

Plan: one scan of 60 days -> one conditional aggregate per customer (30-day
measures and the 60-day trend) -> join with Active customers -> signals ->
top-k.  The reference joins ``customers`` twice on its primary key (once for
the signals, once for the output); the attributes are carried through one
join instead.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import age_month_part
from ..functions.numeric import pct_change
from ..functions.sql import lit, named
from ..operators.enrich import enrich, top_k
from ..operators.periods import expansion_period_metrics

SIGNALS = ["plan_ceiling_signal", "adoption_signal", "growth_signal", "satisfaction_signal",
           "mastery_signal"]
FLAGS = ["ceiling_flag", "adoption_flag", "growth_flag", "satisfaction_flag", "mastery_flag"]
CARRIED = ["avg_logins", "avg_usage_score", "total_tickets", "avg_nps", "recent_usage",
           "prior_usage", "plan_type", "mrr", "company_name", "account_owner", "signup_date"]


def expansion_signals(customers: DataFrame, activity: DataFrame, as_of: dt.date,
                      days: int = 30) -> DataFrame:
    return signals_from_metrics(customers, expansion_period_metrics(activity, as_of, days))


def signals_from_metrics(customers: DataFrame, metrics: DataFrame) -> DataFrame:
    """Expansion signals from per-customer measures (``expansion_period_metrics`` shape)."""
    joined = enrich(metrics, customers,
                    ["plan_type", "mrr", "company_name", "account_owner", "signup_date"],
                    statuses=["Active"])
    return joined.selectExpr(
        "customer_id",
        named(rules.plan_ceiling_signal("plan_type", "avg_usage_score"), "plan_ceiling_signal"),
        named(rules.at_least("avg_usage_score", rules.ADOPTION), "adoption_signal"),
        named(rules.growth_signal("recent_usage", "prior_usage"), "growth_signal"),
        named(rules.at_least("avg_nps", rules.SATISFACTION), "satisfaction_signal"),
        named(rules.mastery_signal("total_tickets", "avg_usage_score"), "mastery_signal"),
        *CARRIED)


def expansion_scores(signals: DataFrame) -> DataFrame:
    return signals.selectExpr("customer_id", named(" + ".join(SIGNALS), "expansion_score"),
                              *SIGNALS, *CARRIED)


def expansion_opportunities(customers: DataFrame, activity: DataFrame, as_of: dt.date,
                            limit: int | None = 100, days: int = 30,
                            min_score: int = 20, exclude_plan: str = "Enterprise") -> DataFrame:
    """Expansion readiness; the ``limit`` highest scores in order, ``None``: everyone, unsorted."""
    return expansion_report(customers, expansion_period_metrics(activity, as_of, days), as_of,
                            limit, min_score, exclude_plan)


def expansion_report(customers: DataFrame, metrics: DataFrame, as_of: dt.date,
                     limit: int | None = 100, min_score: int = 20,
                     exclude_plan: str = "Enterprise") -> DataFrame:
    """Expansion analysis from per-customer measures (``expansion_period_metrics`` shape)."""
    scores = expansion_scores(signals_from_metrics(customers, metrics))
    score = "expansion_score"
    out = scores.filter(f"{score} >= {min_score} AND plan_type != {lit(exclude_plan)}").selectExpr(
        "customer_id", "company_name", "plan_type AS current_plan", "mrr AS current_mrr",
        "account_owner", "signup_date",
        named(age_month_part(lit(as_of), "signup_date"), "months_as_customer"),
        score,
        named(rules.at_least(score, rules.EXPANSION_READINESS), "expansion_readiness"),
        named(rules.expansion_opportunity("plan_type", "plan_ceiling_signal", "adoption_signal",
                                          "growth_signal"), "expansion_opportunity"),
        named(rules.estimated_expansion_mrr("plan_type", "mrr"), "estimated_expansion_mrr"),
        *[named(rules.flag(s, text), name)
          for s, text, name in zip(SIGNALS, rules.EXPANSION_FLAGS, FLAGS)],
        "ROUND(avg_usage_score, 1) AS avg_usage_score",
        "ROUND(avg_logins, 1) AS avg_weekly_logins",
        "total_tickets AS tickets_last_30d",
        "ROUND(avg_nps, 1) AS nps_score",
        named(pct_change("recent_usage", "prior_usage", guard="notnull"), "usage_growth_pct"),
        named(rules.at_least(score, rules.TALKING_POINTS), "sales_talking_points"))
    return top_k(out, [F.col(score).desc(), F.col("current_mrr").desc_nulls_first(),
                       F.col("customer_id").asc()], limit)
