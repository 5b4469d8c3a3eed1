"""MRR assignment by plan (table preparation).

The reference adds ``mrr DECIMAL(10,2)`` after loading and fills it with one
UPDATE per plan: base price plus a random share of the plan's range.  Here
the share is an input expression in [0, 1] so the result is reproducible;
plans outside the table keep a NULL ``mrr``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.rules import Raw, ladder
from ..functions.sql import col, lit

# Fixed values: (base, range) of monthly recurring revenue per plan.
MRR_BANDS = {"Starter": (49, 30), "Professional": (199, 100), "Enterprise": (999, 500)}


def mrr_for_plan(plan: str, variance: str, bands: dict = MRR_BANDS) -> str:
    steps = [(f"{plan} = {lit(name)}",
              Raw(f"{base} + CAST({variance} AS DECIMAL(20,10)) * {width}"))
             for name, (base, width) in bands.items()]
    return f"CAST({ladder(steps)} AS DECIMAL(10,2))"


def assign_mrr(customers: DataFrame, variance: str, bands: dict = MRR_BANDS) -> DataFrame:
    """Return ``customers`` with ``mrr`` set from ``plan_type`` and ``variance`` (SQL)."""
    return customers.withColumn("mrr", col(mrr_for_plan("plan_type", variance, bands)))
