"""cspulse: customer-success analytics as Spark DataFrame plans.

Health scoring, churn risk, expansion readiness, usage trends and signup
cohort retention over a ``customers`` dimension and a weekly
``customer_activity`` fact table, plus portfolio rollups.  Every analysis is
a function ``(customers, activity, as_of, ...) -> DataFrame`` built from
Spark SQL expressions, windows, aggregations and joins.
"""

from .plans import (best_cohorts, churn_risk, churn_risk_rollup, cohort_compare_by,
                    cohort_exec_summary, cohort_retention, cohort_retention_curve,
                    cohort_table, customer_health, customer_metrics, customer_segments,
                    expansion_opportunities, expansion_pipeline_rollup, portfolio_report, ranked_list,
                    register_views,
                    percentile_metrics, segment_customers, trend_portfolio_rollup,
                    usage_trends, worst_cohorts)
from .session import build_session, materialize, release
from .sources import (VersionedTable, domain_faults, load_activity, load_baseline, load_customers, publish,
                      read_published, upsert, write_activity, write_customers)
from .state import CohortVisits, RunningTotals

__all__ = [
    "CohortVisits", "RunningTotals", "VersionedTable", "best_cohorts", "build_session", "churn_risk", "churn_risk_rollup", "cohort_compare_by",
    "cohort_exec_summary", "cohort_retention", "cohort_retention_curve", "cohort_table",
    "customer_health", "customer_metrics", "customer_segments", "domain_faults", "expansion_opportunities",
    "expansion_pipeline_rollup", "load_activity", "load_baseline", "load_customers",
    "materialize", "percentile_metrics", "portfolio_report", "publish", "ranked_list", "read_published",
    "register_views", "release",
    "segment_customers", "trend_portfolio_rollup", "upsert", "usage_trends", "worst_cohorts",
    "write_activity", "write_customers",
]
