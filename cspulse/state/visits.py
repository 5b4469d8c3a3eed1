"""Distinct active customers per cohort and month, as state that merges over dates.

One row per (date, cohort month, months since signup, range of 32,768 customer
ids) holds a bitmap of the customers seen; a sketch row per (date, cohort,
months) holds a HyperLogLog sketch of them.  Both merge by union, so the
retention curve is an aggregate of the state, and a new or corrected date
rewrites the state of that date alone: the fact table's other dates are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import age_month_part, age_total_months, month_trunc
from ..functions.sql import col, named
from ..sources.versions import VersionedTable

DATE = "activity_date"
#: HyperLogLog sketches of 2^LOG_K registers: relative standard error 1.04 / sqrt(2^LOG_K), 1.6 per cent.
LOG_K = 12
_GROUP = [T.StructField(DATE, T.DateType()), T.StructField("cohort_month", T.DateType()),
          T.StructField("months_since_signup", T.IntegerType())]
BITMAPS = T.StructType([*_GROUP, T.StructField("bucket", T.LongType()), T.StructField("seen", T.BinaryType())])
SKETCHES = T.StructType([*_GROUP, T.StructField("seen", T.BinaryType())])


class CohortVisits:
    """The state below ``root``: exact bitmaps, or sketches where ``exact`` is false.

    ``total_months`` counts whole months since signup instead of AGE's month
    field.  Signup dates are taken as of the refresh; a changed one needs a
    ``rebuild`` of the dates concerned.
    """

    def __init__(self, spark: SparkSession, root: str, exact: bool = True, total_months: bool = False) -> None:
        self.exact = exact
        self.months = age_total_months if total_months else age_month_part
        self.table = VersionedTable(spark, root, BITMAPS if exact else SKETCHES, DATE)

    def state(self, customers: DataFrame, activity: DataFrame) -> DataFrame:
        """State rows of the dates in ``activity``."""
        seen = activity.select("customer_id", DATE).join(
            customers.select("customer_id", "signup_date"), "customer_id").selectExpr(
            "customer_id", DATE, named(month_trunc("signup_date"), "cohort_month"),
            named(f"CAST({self.months(DATE, 'signup_date')} AS INT)", "months_since_signup"))
        group = [DATE, "cohort_month", "months_since_signup"]
        if self.exact:
            return (seen.withColumn("bucket", F.bitmap_bucket_number("customer_id"))
                    .groupBy(*group, "bucket")
                    .agg(F.bitmap_construct_agg(F.bitmap_bit_position("customer_id")).alias("seen")))
        return seen.groupBy(*group).agg(F.hll_sketch_agg("customer_id", LOG_K).alias("seen"))

    def rebuild(self, customers: DataFrame, activity: DataFrame, drop=(), source: int | None = None) -> int:
        """Replace the state of every date in ``activity``; dates of ``drop`` go."""
        return self.table.replace(self.state(customers, activity), drop=drop,
                                  meta={} if source is None else {"source": source})

    def refresh(self, customers: DataFrame, activity: VersionedTable) -> set[str]:
        """Bring the state up to the latest version of ``activity``; returns the dates that were read."""
        version = activity.current()
        done = self.table.manifest()["meta"].get("source")
        written, dropped = activity.changed(done, version)
        if written or dropped:
            self.rebuild(customers, activity.read(version, values=written), written | dropped, version)
        return written

    def curve(self, version: int | None = None) -> DataFrame:
        """(cohort_month, months_since_signup, active_customers): the retention curve, from the state alone.

        Exact with bitmaps; with sketches each count has a relative standard
        error of 1.04 / sqrt(2^LOG_K).
        """
        state = self.table.read(version)
        group = ["cohort_month", "months_since_signup"]
        if not self.exact:
            return state.groupBy(*group).agg(
                F.hll_sketch_estimate(F.hll_union_agg("seen")).alias("active_customers"))
        merged = state.groupBy(*group, "bucket").agg(F.bitmap_or_agg("seen").alias("seen"))
        return merged.groupBy(*group).agg(col("SUM(bitmap_count(seen))", "active_customers"))
