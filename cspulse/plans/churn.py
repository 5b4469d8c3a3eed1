"""Churn risk: five signals comparing the last 4 weeks with the 4 before.

Plan: one scan of 8 weeks -> one conditional aggregate per customer (both
periods) -> signals -> capped score -> join with non-churned customers ->
top-k.  The reference's two scans plus left join are kept as
``period_over_period`` for comparison.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.sql import col, lit, named
from ..operators.enrich import enrich, top_k
from ..operators.periods import churn_period_metrics

SIGNALS = ["usage_decline_risk", "support_burden_risk", "nps_decline_risk",
           "login_decline_risk", "inactivity_risk"]
FLAGS = ["usage_flag", "support_flag", "nps_flag", "login_flag", "activity_flag"]
METRICS = ["current_avg_usage", "prior_avg_usage", "current_avg_logins", "prior_avg_logins",
           "current_tickets", "current_avg_nps"]


def risk_signals(periods: DataFrame) -> DataFrame:
    return periods.selectExpr(
        "customer_id",
        named(rules.usage_decline_risk("current_avg_usage", "prior_avg_usage"),
              "usage_decline_risk"),
        named(rules.support_burden_risk("current_tickets"), "support_burden_risk"),
        named(rules.nps_decline_risk("current_avg_nps", "prior_avg_nps"), "nps_decline_risk"),
        named(rules.login_decline_risk("current_avg_logins", "prior_avg_logins"),
              "login_decline_risk"),
        named(rules.inactivity_risk("current_weeks_active"), "inactivity_risk"),
        *METRICS)


def risk_scores(signals: DataFrame, cap: int = rules.CHURN_CAP) -> DataFrame:
    return signals.selectExpr(
        "customer_id", named(rules.capped_sum(SIGNALS, cap), "churn_risk_score"),
        *SIGNALS, *METRICS)


def churn_risk(customers: DataFrame, activity: DataFrame, as_of: dt.date,
               limit: int | None = 100, weeks: int = 4,
               statuses=("Active", "At Risk"), include_silent: bool = False) -> DataFrame:
    """Churn risk of customers active in the current period.

    As in the reference, a customer with no row in the current period is
    absent.  ``include_silent=True`` keeps such customers (of the given
    statuses) with zero current weeks, so their inactivity signal fires.
    The ``limit`` highest risks in order; ``None``: everyone, unsorted.
    """
    periods = churn_period_metrics(activity, as_of, weeks)
    if include_silent:
        keys = customers.filter(f"status IN ({', '.join(lit(s) for s in statuses)})") \
            .select("customer_id")
        periods = (keys.join(periods, "customer_id", "left")
                   .withColumn("current_weeks_active",
                               col("COALESCE(current_weeks_active, 0)")))
    return churn_report(customers, periods, limit, statuses)


def churn_report(customers: DataFrame, periods: DataFrame, limit: int | None = 100,
                 statuses=("Active", "At Risk")) -> DataFrame:
    """Churn analysis from per-customer current/prior measures (customers with a current row)."""
    scores = risk_scores(risk_signals(periods))
    score = "churn_risk_score"
    joined = enrich(scores.filter(f"{score} > 0"), customers,
                    ["company_name", "plan_type", "mrr", "account_owner", "signup_date"],
                    statuses=list(statuses))
    out = joined.selectExpr(
        "customer_id", "company_name", "plan_type", "mrr", "account_owner", "signup_date",
        score,
        named(rules.at_least(score, rules.RISK_CATEGORIES), "risk_category"),
        *[named(rules.flag(s, text), name)
          for s, text, name in zip(SIGNALS, rules.CHURN_FLAGS, FLAGS)],
        "mrr AS monthly_revenue_at_risk",
        "mrr * 12 AS annual_revenue_at_risk",
        "ROUND(current_avg_usage, 1) AS current_usage",
        "ROUND(prior_avg_usage, 1) AS prior_usage",
        "ROUND(current_avg_logins, 1) AS current_logins",
        "ROUND(prior_avg_logins, 1) AS prior_logins",
        "current_tickets AS tickets_last_4wks",
        "ROUND(current_avg_nps, 1) AS current_nps",
        named(rules.at_least(score, rules.CHURN_ACTIONS), "recommended_action"))
    return top_k(out, [F.col(score).desc(), F.col("mrr").desc_nulls_first(),
                       F.col("customer_id").asc()], limit)
