"""Portfolio rollups over a finished analysis DataFrame.

Each function takes the analysis result (the reference's ``[this query]``)
and groups it by its label column; the few result rows come back in the
reference's order.  Pass the analysis with ``limit=None`` for the whole
portfolio; a limited analysis summarises its list only.
Label columns have a handful of values, so these are partial+final
aggregates whose shuffle carries a few rows per task.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.numeric import avg_exact
from ..functions.sql import col, named
from ..operators.consistency import engagement_consistency
from ..operators.enrich import sort_small, top_k
from .trends import usage_trends


def churn_risk_rollup(churn: DataFrame) -> DataFrame:
    return (churn.groupBy("risk_category")
            .agg(col("COUNT(1)", "customer_count"),
                 col("SUM(monthly_revenue_at_risk)", "total_mrr_at_risk"),
                 col(avg_exact("churn_risk_score"), "avg_risk_score"))
            .transform(sort_small, [F.col("avg_risk_score").desc_nulls_first()]))


def expansion_pipeline_rollup(expansion: DataFrame) -> DataFrame:
    return (expansion.groupBy("expansion_readiness")
            .agg(col("COUNT(1)", "opportunity_count"),
                 col("SUM(estimated_expansion_mrr)", "total_pipeline_mrr"),
                 col(avg_exact("expansion_score"), "avg_readiness_score"))
            .transform(sort_small, [F.col("avg_readiness_score").desc_nulls_first()]))


def trend_portfolio_rollup(trends: DataFrame) -> DataFrame:
    return (trends.groupBy("trend_category")
            .agg(col("COUNT(1)", "customer_count"),
                 col(f"ROUND({avg_exact('overall_trend_score')}, 1)", "avg_trend_score"),
                 col("SUM(mrr)", "total_mrr"),
                 col(f"ROUND({avg_exact('usage_trend_4wk')}, 1)", "avg_usage_trend_pct"))
            .transform(sort_small, [F.col("avg_trend_score").desc_nulls_first()]))


def cohort_compare_by(cohorts: DataFrame, dim: str) -> DataFrame:
    """Average retention per segment over a (cohort_month, dim) cohort table."""
    return (cohorts.groupBy(dim)
            .agg(col(avg_exact("customer_retention_rate"), "avg_retention"),
                 col(avg_exact("revenue_retention_rate"), "avg_revenue_retention"),
                 col("COUNT(1)", "cohort_count")))


_COHORT_PICK = ["cohort_month", "revenue_retention_rate", "customer_retention_rate",
                "upgrade_rate", "avg_usage_score"]


def best_cohorts(cohorts: DataFrame, n: int = 5) -> DataFrame:
    return top_k(cohorts.select(*_COHORT_PICK),
                 [F.col("revenue_retention_rate").desc_nulls_first(),
                  F.col("cohort_month").desc()], n)


def worst_cohorts(cohorts: DataFrame, n: int = 5) -> DataFrame:
    return top_k(cohorts.select(*_COHORT_PICK),
                 [F.col("revenue_retention_rate").asc_nulls_last(),
                  F.col("cohort_month").desc()], n)


def cohort_exec_summary(cohorts: DataFrame, min_age: int = 6) -> DataFrame:
    """Board-level metrics over mature cohorts (``cohort_age_months >= min_age``)."""
    return (cohorts.filter(f"cohort_age_months >= {min_age}")
            .agg(col(avg_exact("customer_retention_rate"), "avg_customer_retention"),
                 col(avg_exact("revenue_retention_rate"), "avg_revenue_retention"),
                 col("SUM(current_mrr)", "total_mrr"),
                 col("MAX(revenue_retention_rate)", "best_cohort_retention"),
                 col("MIN(revenue_retention_rate)", "worst_cohort_retention"),
                 col(avg_exact("upgrade_rate"), "avg_upgrade_rate"),
                 col("SUM(starter_to_pro_upgrades + pro_to_enterprise_upgrades)",
                     "total_upgrades_last_period")))


# Segment ladder for the trend analysis.  The reference names five segments and
# describes them in prose without numbers; the cut-offs are ours.  Engagement is
# inconsistent where weekly usage spreads far around its mean (a standard
# deviation of 0.6 of it: spread 0.36), three weeks or more are missing between
# the first and the last of the latest eight rows, or fewer than five rows exist.
# "High consistency" is the analysis' own top band (7 of 8 weeks) without that;
# "high usage" is its adoption bar (70).  A steady customer below that bar with
# no clear trend fits none of the five and has no segment.
SEGMENTS = {"high_usage": 70, "consistent_weeks": 7, "inconsistent_below": 5,
            "inconsistent_spread": "0.36", "inconsistent_missing": 3}


def segment_customers(trends: DataFrame, consistency: DataFrame, table: dict = SEGMENTS) -> DataFrame:
    """The named segment, if any, of every row of a trend analysis.

    ``consistency``: ``operators.consistency.engagement_consistency`` of the same rows.
    """
    weeks = "active_weeks_last_8"
    uneven = (f"(COALESCE(usage_spread, 0) >= {table['inconsistent_spread']} OR "
              f"COALESCE(missing_weeks, 0) >= {table['inconsistent_missing']} OR "
              f"{weeks} < {table['inconsistent_below']})")
    segment = rules.ladder([
        (f"trend_category = 'Sharp Decline' AND {uneven}", "ABANDONING"),
        ("trend_category IN ('Declining', 'Sharp Decline')", "DECLINING"),
        (f"trend_category IN ('Strong Growth', 'Improving') AND {weeks} >= {table['consistent_weeks']}"
         f" AND NOT {uneven}", "ACCELERATING"),
        (uneven, "VOLATILE"),
        (f"four_week_avg_usage >= {table['high_usage']}", "STABLE POWER USERS"),
    ])
    return trends.join(consistency, "customer_id", "left").selectExpr(
        "customer_id", "company_name", "mrr", "overall_trend_score", "trend_category",
        "engagement_consistency", "four_week_avg_usage", weeks, "usage_spread", "missing_weeks",
        named(segment, "segment"))


def customer_segments(customers: DataFrame, activity: DataFrame, as_of: dt.date) -> DataFrame:
    """``segment_customers`` of the whole portfolio."""
    return segment_customers(usage_trends(customers, activity, as_of, limit=None),
                             engagement_consistency(activity, as_of))


def percentile_metrics(customers: DataFrame, activity: DataFrame,
                       percents: Sequence[int] = (25, 50, 75, 90)) -> DataFrame:
    """Exact percentiles of the usage score per plan (``p<n>_usage``), and the rows counted.

    A percentile is the smallest score that so many percent of the plan's rows
    do not exceed.  Scores run from 0 to 100, so (plan, score) counts hold all:
    no list of values is collected and no plan's rows meet in one task.
    """
    scores = (activity.filter("feature_usage_score IS NOT NULL")
              .groupBy("customer_id", "feature_usage_score").agg(col("COUNT(1)", "_n")))
    counts = (scores.join(customers.select("customer_id", "plan_type"), "customer_id")
              .groupBy("plan_type", "feature_usage_score").agg(col("SUM(_n)", "_n")))
    along = "PARTITION BY plan_type ORDER BY feature_usage_score"
    ranked = counts.selectExpr("plan_type", "feature_usage_score", "_n",
                               f"SUM(_n) OVER ({along}) AS _upto",
                               "SUM(_n) OVER (PARTITION BY plan_type) AS _all")
    return ranked.groupBy("plan_type").agg(
        col("SUM(_n)", "activity_rows"),
        *(col(f"MIN(CASE WHEN _upto * 100 >= _all * {p} THEN feature_usage_score END)", f"p{p}_usage")
          for p in percents))
