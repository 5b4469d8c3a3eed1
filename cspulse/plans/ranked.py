"""The whole customer lists in the reference's order: each row with its place.

``limit=None`` of an analysis returns everyone in no order; these return
everyone with ``place`` 1, 2, ... in the order that the limited lists have,
found by ranges (``operators.ranking``), not by one task.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.ranking import placed
from .churn import churn_risk
from .expansion import expansion_opportunities
from .health import customer_health
from .trends import usage_trends

#: Analysis, score and whether the highest comes first; then mrr, highest first, and the customer.
LISTS = {
    "customer_health": (customer_health, "overall_health_score", False, "mrr"),
    "churn_risk": (churn_risk, "churn_risk_score", True, "mrr"),
    "expansion_opportunities": (expansion_opportunities, "expansion_score", True, "current_mrr"),
    "usage_trends": (usage_trends, "overall_trend_score", False, "mrr"),
}


def ranked_list(name: str, customers: DataFrame, activity: DataFrame, as_of: dt.date, **options) -> DataFrame:
    """Every row of the analysis ``name`` with its ``place`` in the report's order."""
    analysis, score, highest, mrr = LISTS[name]
    order = [F.col(score).desc() if highest else F.col(score).asc(), F.col(mrr).desc_nulls_first(),
             F.col("customer_id").asc()]
    return placed(analysis(customers, activity, as_of, limit=None, **options), order)
