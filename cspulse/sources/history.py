"""Customer history: versions with validity dates, and the state of any date.

Snapshots (one row a customer and day on which something was recorded) become
versions [valid_from, valid_to) of the tracked columns, equal neighbours joined
into one.  ``as_of`` finds each customer's version at a date of its own: an
equality join on the customer with the date inside the version, so a customer's
few versions meet its own rows only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TRACKED = ("plan_type", "mrr")


def versions(snapshots: DataFrame, tracked: Sequence[str] = TRACKED, key: str = "customer_id",
             day: str = "snapshot_date", latest: str | None = None) -> DataFrame:
    """(key, tracked..., valid_from, valid_to) of snapshots (key, day, tracked...).

    Of several rows of one customer and day the greatest ``latest`` counts (else
    the greatest row).  Equal neighbours are one version; null values are values
    like others; rows without key or day are left out.  ``valid_to`` is null for
    the version that still holds.  A customer's rows meet as one row a day.
    """
    state = F.struct(*tracked)
    rank = F.struct(F.col(latest), state) if latest else state
    days = snapshots.where(f"{key} IS NOT NULL AND {day} IS NOT NULL").groupBy(key, F.col(day).alias("valid_from")).agg(
        F.max_by(state, rank).alias("s"))
    along = f"PARTITION BY {key} ORDER BY valid_from"
    starts = days.selectExpr("*", f"LAG(s) OVER ({along}) AS before").where("before IS NULL OR NOT (s <=> before)")
    return starts.selectExpr(key, *(f"s.{c} AS {c}" for c in tracked), "valid_from",
                             f"LEAD(valid_from) OVER ({along}) AS valid_to")


def as_of(rows: DataFrame, history: DataFrame, at: str, key: str = "customer_id",
          columns: Sequence[str] = TRACKED, how: str = "left") -> DataFrame:
    """``rows`` with the ``columns`` of the version that holds for their key on the date ``at``.

    Rows of no key, no date or a date before the first version get nulls
    (``how`` "inner": go).  ``at`` is an SQL expression over ``rows``.
    """
    held = history.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in columns),
                          "valid_from", "valid_to")
    asked = rows.withColumn("_at", F.expr(at))
    return asked.join(held, F.expr(f"{key} = _key AND _at >= valid_from AND (valid_to IS NULL OR _at < valid_to)"),
                      how).selectExpr(*(f"`{c}`" for c in rows.columns), *(f"_{c} AS {c}" for c in columns))


def baseline(customers: DataFrame, history: DataFrame, at: str = "signup_date") -> DataFrame:
    """The baseline snapshot (customer_id, starting_plan, starting_mrr) on the date ``at``, by default at signup.

    Customers without a version on that date are left out: the cohort analyses
    take them as unchanged.
    """
    found = as_of(customers.select("customer_id", "signup_date"), history, at, how="inner")
    return found.selectExpr("customer_id", "plan_type AS starting_plan", "mrr AS starting_mrr")
