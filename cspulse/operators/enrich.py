"""Joins of per-customer results with the customer dimension, and top-k.

Per-customer results are one row per ``customer_id`` and so is the
dimension, so the join key is unique on both sides: no hot key can appear.
No broadcast hint is forced: the planner broadcasts the dimension only when
its (filtered) size estimate is under ``spark.sql.autoBroadcastJoinThreshold``
and AQE re-checks with the real shuffle sizes at runtime; beyond that the
join stays a sort-merge join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame

from ..functions.sql import lit

KEY = "customer_id"
PROFILE = ["company_name", "plan_type", "mrr", "account_owner", "signup_date", "status",
           "industry"]


def enrich(per_customer: DataFrame, customers: DataFrame, columns: Sequence[str] = PROFILE,
           statuses: Sequence[str] | None = None, how: str = "inner") -> DataFrame:
    """Attach customer attributes; optionally keep only some statuses."""
    dim = customers
    if statuses is not None:
        dim = dim.filter(f"status IN ({', '.join(lit(s) for s in statuses)})")
    return per_customer.join(dim.select(KEY, *columns), KEY, how)


def top_k(df: DataFrame, order: Sequence[Column], n: int | None) -> DataFrame:
    """ORDER BY ... LIMIT n.

    With a limit Spark plans TakeOrderedAndProject: each task keeps its own
    top n and only n rows per task reach the final merge.  ``n=None`` returns
    the whole portfolio *unsorted*: a global sort of every customer would be
    a range shuffle of the full result for presentation only; callers that
    need ordered output sort the (usually aggregated) rows they display.
    """
    if n is None:
        return df
    return df.orderBy(*order).limit(n)


def sort_small(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Order a result whose size is bounded by label cardinality (rollups, curves).

    One partition holds the few rows, so no range-partition sampling job is
    needed; ``repartition(1)`` (unlike ``coalesce(1)``) keeps the upstream
    aggregation parallel.  Never use it on per-customer results.
    """
    return df.repartition(1).sortWithinPartitions(*order)
