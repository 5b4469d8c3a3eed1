"""Composite analyses (health, churn, expansion, trends, cohorts) and rollups."""

from .churn import churn_risk, risk_scores, risk_signals
from .cohorts import (cohort_age, cohort_base, cohort_engagement, cohort_limit, cohort_metrics,
                      cohort_retention, cohort_retention_curve, cohort_table)
from .expansion import expansion_opportunities, expansion_scores, expansion_signals
from .health import customer_health, health_dimensions, health_scores
from .portfolio import customer_metrics, portfolio_report
from .ranked import ranked_list
from .rollups import (best_cohorts, churn_risk_rollup, cohort_compare_by, cohort_exec_summary,
                      customer_segments, expansion_pipeline_rollup, percentile_metrics, segment_customers,
                      trend_portfolio_rollup, worst_cohorts)
from .trends import trend_analysis, trend_scores, usage_trends
from .views import register_views

__all__ = [
    "best_cohorts", "churn_risk", "churn_risk_rollup", "cohort_age", "cohort_base",
    "cohort_compare_by", "cohort_engagement", "cohort_exec_summary", "cohort_limit",
    "cohort_metrics", "cohort_retention", "cohort_retention_curve", "cohort_table",
    "customer_health", "customer_metrics", "customer_segments", "expansion_opportunities", "expansion_pipeline_rollup",
    "expansion_scores", "expansion_signals", "health_dimensions", "health_scores",
    "percentile_metrics", "portfolio_report", "ranked_list", "register_views", "risk_scores", "risk_signals",
    "segment_customers", "trend_analysis", "trend_portfolio_rollup", "trend_scores",
    "usage_trends", "worst_cohorts",
]
