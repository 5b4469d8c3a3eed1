"""Places in a global order, and exact percentiles, without a single-task window.

Rows are range-partitioned and sorted by the order columns (one shuffle); a
row's place is its place inside its partition plus the rows of the partitions
before it.  Only the partitions' row counts, one number each, are summed up
across partitions.  The order should end in a key, so that ties neither share
a partition bound nor leave the order open.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sql import col, lit
from ..session import materialize

_AT = "_place_at"


def placed(df: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``df`` with ``name``: 1 for the first row of the order, then on (ROW_NUMBER without partitions).

    The sorted rows are written once to the shared checkpoint folder (their
    partitions are the order's), which ``release`` of ``.materialized_path`` on
    the result deletes.
    """
    ranged = (df.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn(_AT, F.monotonically_increasing_id()))
    stored = materialize(ranged, "placed")
    # monotonically_increasing_id: partition number above bit 33, row of the partition below.
    counts = stored.groupBy(F.shiftright(_AT, 33).alias("_part")).agg(F.count("*").alias("_rows")).collect()
    starts, total = [], 0
    for part, rows in sorted(map(tuple, counts)):
        starts.append((part, total))
        total += rows
    offsets = df.sparkSession.createDataFrame(starts, "_part long, _start long")
    out = (stored.withColumn("_part", F.shiftright(_AT, 33)).join(F.broadcast(offsets), "_part")
           .withColumn(name, F.col(_AT).bitwiseAND((1 << 33) - 1) + F.col("_start") + 1)
           .drop("_part", "_start", _AT))
    out.materialized_path = stored.materialized_path
    return out


def exact_percentiles(df: DataFrame, by: str, value: str, percents: Sequence[int] = (25, 50, 75, 90)) -> DataFrame:
    """Exact percentiles ``p<n>`` of any orderable ``value`` per group, and the non-null values counted.

    A percentile is the smallest value that so many percent of the group's
    values do not exceed.  Equal values are counted first; the distinct ones
    are placed in the order (group, value) by ranges, and running counts are
    summed inside each range partition and across partitions, so neither a hot
    group nor a hot value meets in one task.  Null groups are one group; a
    group without values has no row.
    """
    counts = df.where(f"{value} IS NOT NULL").groupBy(F.col(by).alias("_by"), F.col(value).alias("_value")).agg(
        F.count("*").alias("_n"))
    order = [F.col("_by").asc_nulls_first(), F.col("_value").asc()]
    ranged = (counts.repartitionByRange(*order).sortWithinPartitions(*order)
              .withColumn(_AT, F.monotonically_increasing_id()))
    stored = materialize(ranged, "percentiles").withColumn("_part", F.shiftright(_AT, 33))
    # Values of each group in each partition: at most one row more a partition than groups.
    parts = stored.groupBy("_by", "_part").agg(F.sum("_n").alias("_rows"))
    before = parts.selectExpr(
        "_by", "_part", "_rows",
        "COALESCE(SUM(_rows) OVER (PARTITION BY _by ORDER BY _part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        " AS _before", "SUM(_rows) OVER (PARTITION BY _by) AS _all")
    # Only the partition in which a percentile falls is searched for it.
    wanted = before.selectExpr("*", f"explode(array({', '.join(str(p) for p in percents)})) AS _percent").where(
        "_before * 100 < _all * _percent AND (_before + _rows) * 100 >= _all * _percent").selectExpr(
        "_by AS _g", "_part", "_before", "_all", "_percent")
    inside = stored.join(F.broadcast(wanted), (stored._by.eqNullSafe(F.col("_g"))) & (stored._part == wanted._part))
    found = inside.selectExpr(
        "_by", "_percent", "_value", "_all",
        f"_before + SUM(_n) OVER (PARTITION BY _by, _percent ORDER BY {_AT}) AS _upto").where(
        "_upto * 100 >= _all * _percent").groupBy("_by", "_percent", "_all").agg(F.min("_value").alias("_value"))
    return found.groupBy(F.col("_by").alias(by)).agg(
        F.max("_all").alias("values"),
        *(col(f"MAX(CASE WHEN _percent = {lit(p)} THEN _value END)", f"p{p}") for p in percents))
