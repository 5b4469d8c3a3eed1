"""Activity stored for window queries: numbered blocks, bucketed by customer and block.

Each row gets its number among the customer's rows, oldest first, when it is
written; BLOCK_ROWS consecutive numbers are a block, and the rows at a block's
edges that its neighbours' frames reach are stored with the neighbour too.  The
table is bucketed by (customer, block), so the windows of a horizon run on the
stored buckets: no raw row is shuffled, and no task holds more of a customer
than a block, however large the customer is.  Numbers count from the oldest row,
so later rows leave earlier blocks as they are.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, SparkSession

from ..functions.numeric import mean_of
from ..functions.sql import col, named
from ..operators.periods import KEY
from ..operators.windows import BLOCK_ROWS, trend_rows
from ..session import checkpoint_root

_COLUMNS = ["activity_id", "activity_date", "logins_count", "feature_usage_score", "support_tickets_opened",
            "nps_score"]
#: Rows before its own that a frame reaches (LAG one, the rolling mean three), and after (LEAD).
REACH_BACK, REACH_ON = 3, 1


def numbered(activity: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows with ``number`` (1 for a customer's oldest), their block ``home`` and each ``block`` that holds them."""
    per_date = activity.groupBy(KEY, "activity_date").agg(col("COUNT(1)", "_n"))
    earlier = per_date.selectExpr(
        KEY, "activity_date", f"COALESCE(SUM(_n) OVER (PARTITION BY {KEY} ORDER BY activity_date "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _earlier")
    rows = activity.join(earlier, [KEY, "activity_date"]).selectExpr(
        KEY, *_COLUMNS, f"_earlier + row_number() OVER (PARTITION BY {KEY}, activity_date "
        "ORDER BY activity_id) AS number")
    placed = rows.selectExpr("*", f"(number - 1) DIV {block_rows} AS home", f"(number - 1) % {block_rows} AS _place")
    return placed.selectExpr("*", "explode(array_distinct(array_compact(array(home, "
                             f"CASE WHEN _place >= {block_rows - REACH_BACK} THEN home + 1 END, "
                             f"CASE WHEN _place < {REACH_ON} AND home > 0 THEN home - 1 END)))) AS block").drop("_place")


def write_blocks(activity: DataFrame, name: str | None = None, buckets: int = 64,
                 block_rows: int = BLOCK_ROWS, path: str | None = None) -> str:
    """Store ``activity`` as the table ``name`` in ``buckets`` buckets; returns the name.

    ``path``: its folder, by default a new one in the shared checkpoint folder.
    Blocks need at least REACH_BACK rows.
    """
    if block_rows < REACH_BACK:
        raise ValueError(f"blocks of at least {REACH_BACK} rows")
    spark = activity.sparkSession
    name = name or f"activity_blocks_{uuid.uuid4().hex}"
    path = path or f"{checkpoint_root(spark).rstrip('/')}/{name}"
    (numbered(activity, block_rows).repartition(buckets, KEY, "block").write.bucketBy(buckets, KEY, "block")
     .sortBy(KEY, "block", "number").option("path", path).mode("overwrite").saveAsTable(name))
    return name


def stored_window_metrics(spark: SparkSession, name: str, as_of: dt.date, weeks: int = 12) -> DataFrame:
    """As ``windows.weekly_window_metrics``, from the stored blocks."""
    rows = trend_rows(spark.table(name), as_of, weeks)
    # A customer's last number, once for each of its blocks: the only rows that are shuffled.
    ends = (rows.where("home = block").groupBy(KEY).agg(
        col("MAX(number)", "_last"), col("MIN(home)", "_low"), col("MAX(home)", "_high"))
        .selectExpr(KEY, "_last", "explode(sequence(_low, _high)) AS block"))
    along = f"PARTITION BY {KEY}, block ORDER BY number"
    frame = f"{along} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW"

    def rolling(column: str) -> str:
        return mean_of(f"SUM({column}) OVER ({frame})", f"COUNT({column}) OVER ({frame})")

    windows = rows.selectExpr(
        KEY, *_COLUMNS, "number", "home", "block",
        named(f"lag(logins_count, 1) OVER ({along})", "prev_week_logins"),
        named(f"lag(feature_usage_score, 1) OVER ({along})", "prev_week_usage"),
        named(f"lead(logins_count, 1) OVER ({along})", "next_week_logins"),
        named(f"lead(feature_usage_score, 1) OVER ({along})", "next_week_usage"),
        named(rolling("logins_count"), "rolling_4wk_logins"),
        named(rolling("feature_usage_score"), "rolling_4wk_usage")).where("home = block")
    return windows.join(ends, [KEY, "block"]).selectExpr(
        KEY, *_COLUMNS, "prev_week_logins", "prev_week_usage", "next_week_logins", "next_week_usage",
        "rolling_4wk_logins", "rolling_4wk_usage", "_last - number + 1 AS weeks_ago")
