"""Expose the tables and analyses as Spark SQL temporary views.

Users of a SQL-first workflow write follow-up queries against an analysis
result (the reference's ``[this query]``).  ``register_views`` publishes the
two tables and every analysis under a stable name, so those queries run
unchanged through ``spark.sql``:

    register_views(spark, customers, activity, as_of)
    spark.sql("SELECT risk_category, COUNT(*) AS customer_count "
              "FROM churn_risk GROUP BY risk_category")

Views are lazy plans: nothing runs until a query reads them, and Catalyst
optimises the follow-up query together with the analysis plan.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from .churn import churn_risk
from .cohorts import cohort_limit, cohort_retention, cohort_retention_curve
from .expansion import expansion_opportunities
from .health import customer_health
from .rollups import customer_segments
from .trends import usage_trends


def register_views(spark: SparkSession, customers: DataFrame, activity: DataFrame,
                   as_of: dt.date, limit: int | None = 100, prefix: str = "") -> list[str]:
    """Register ``customers``, ``customer_activity`` and one view per analysis.

    ``limit`` applies to the four customer lists (the reference reports the top
    100) and the latest 24 cohorts; ``None`` publishes every customer and cohort.  Returns the view names.
    """
    views = {
        "customers": customers,
        "customer_activity": activity,
        "customer_health": customer_health(customers, activity, as_of, limit),
        "churn_risk": churn_risk(customers, activity, as_of, limit),
        "expansion_opportunities": expansion_opportunities(customers, activity, as_of, limit),
        "usage_trends": usage_trends(customers, activity, as_of, limit),
        "cohort_retention": cohort_retention(customers, activity, as_of,
                                             limit=cohort_limit(limit)),
        "cohort_retention_curve": cohort_retention_curve(customers, activity),
        "customer_segments": customer_segments(customers, activity, as_of),
    }
    names = []
    for name, df in views.items():
        df.createOrReplaceTempView(prefix + name)
        names.append(prefix + name)
    return names
