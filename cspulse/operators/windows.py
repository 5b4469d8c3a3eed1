"""Per-customer weekly window metrics and the recent-trend pivot.

Frames are row based: a missing week is skipped, not zero-filled, so
"4-week" means "the last 4 rows".  ``activity_id`` breaks ties between rows
on the same date so row numbers are deterministic.

Two forms are provided:

* ``weekly_window_metrics`` returns every row with LAG, 4-row rolling
  averages and ``weeks_ago``, by one plan whatever a customer's size.  A row's
  number is the count of the customer's rows on later dates (from per-date
  counts, at most one row per customer and calendar date) plus its place
  within its own date.  LAG, LEAD and the 4-row frame then run inside blocks
  of BLOCK_ROWS consecutive row numbers; the few rows at a block's edge that
  its neighbours' frames reach are copied there.  No task holds more of a
  customer than one date or one block.
* ``recent_trends`` needs only the 8 most recent rows of each customer.  It
  filters ``weeks_ago <= 8`` right after the row number, which Spark turns
  into a partial ``WindowGroupLimit`` *before* the shuffle: every map task
  forwards at most 8 rows per customer, so even a customer holding a third of
  all rows reaches the final task as a handful of rows.  Rolling averages at
  ``weeks_ago`` 1 and 5 are then plain conditional aggregates over rows 1-4
  and 5-8.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions.numeric import mean_of
from ..functions.sql import col, named
from .periods import KEY, since

RECENT_ROWS = 8
LATEST_FIRST = f"PARTITION BY {KEY} ORDER BY activity_date DESC, activity_id DESC"


def trend_rows(act: DataFrame, as_of: dt.date, weeks: int = 12) -> DataFrame:
    """Rows inside the trend horizon (applied before any window)."""
    return act.filter(since(as_of, 7 * weeks))


#: Consecutive rows of a customer that one window partition holds.
BLOCK_ROWS = 4096
_ROW_COLUMNS = ["activity_date", "activity_id", "logins_count", "feature_usage_score",
                "support_tickets_opened", "nps_score"]


def numbered_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with ``weeks_ago``: 1 for a customer's latest row, then on."""
    per_date = rows.groupBy(KEY, "activity_date").agg(col("COUNT(1)", "_n"))
    later = per_date.selectExpr(
        KEY, "activity_date",
        f"COALESCE(SUM(_n) OVER (PARTITION BY {KEY} ORDER BY activity_date DESC "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _later")
    return (rows.join(later, [KEY, "activity_date"])
            .selectExpr(KEY, *_ROW_COLUMNS,
                        f"_later + row_number() OVER (PARTITION BY {KEY}, activity_date "
                        "ORDER BY activity_id DESC) AS weeks_ago"))


def weekly_window_metrics(act: DataFrame, as_of: dt.date, weeks: int = 12,
                          block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every row of the horizon with its neighbours, rolling averages and number."""
    # Place p in block h, from 0: the block above needs rows 0-2 for its last frames and
    # row 0 for its LAG, the block below needs the last row for its LEAD.
    spread = (numbered_rows(trend_rows(act, as_of, weeks))
              .selectExpr("*", f"(weeks_ago - 1) DIV {block_rows} AS _home",
                          f"(weeks_ago - 1) % {block_rows} AS _place")
              .selectExpr("*", "explode(array_compact(array(_home, "
                          "CASE WHEN _place < 3 AND _home > 0 THEN _home - 1 END, "
                          f"CASE WHEN _place = {block_rows - 1} THEN _home + 1 END))) AS _block"))
    latest_first = f"PARTITION BY {KEY}, _block ORDER BY weeks_ago"
    frame = f"{latest_first} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING"

    def rolling(column: str) -> str:
        return mean_of(f"SUM({column}) OVER ({frame})", f"COUNT({column}) OVER ({frame})")

    return spread.selectExpr(
        KEY, *_ROW_COLUMNS,
        named(f"lead(logins_count, 1) OVER ({latest_first})", "prev_week_logins"),
        named(f"lead(feature_usage_score, 1) OVER ({latest_first})", "prev_week_usage"),
        named(f"lag(logins_count, 1) OVER ({latest_first})", "next_week_logins"),
        named(f"lag(feature_usage_score, 1) OVER ({latest_first})", "next_week_usage"),
        named(rolling("logins_count"), "rolling_4wk_logins"),
        named(rolling("feature_usage_score"), "rolling_4wk_usage"),
        "weeks_ago", "_home", "_block").filter("_block = _home").drop("_home", "_block")


def recent_rows(act: DataFrame, as_of: dt.date, weeks: int = 12,
                keep: int = RECENT_ROWS) -> DataFrame:
    """The ``keep`` latest rows per customer with their ``weeks_ago`` rank."""
    return (trend_rows(act, as_of, weeks)
            .selectExpr(KEY, "logins_count", "feature_usage_score",
                        named(f"row_number() OVER ({LATEST_FIRST})", "weeks_ago"))
            .filter(f"weeks_ago <= {keep}"))


def _at(n: int, column: str) -> str:
    return f"MAX(CASE WHEN weeks_ago = {n} THEN {column} END)"


def _mean_between(lo: int, hi: int, column: str) -> str:
    picked = f"CASE WHEN weeks_ago BETWEEN {lo} AND {hi} THEN {column} END"
    return mean_of(f"SUM({picked})", f"COUNT({picked})")


def recent_trends(act: DataFrame, as_of: dt.date, weeks: int = 12) -> DataFrame:
    """Current / previous week, 4-row averages at weeks_ago 1 and 5, rows in last 8."""
    return (recent_rows(act, as_of, weeks).groupBy(KEY)
            .agg(col(_at(1, "logins_count"), "current_logins"),
                 col(_at(1, "feature_usage_score"), "current_usage"),
                 col(_mean_between(1, 4, "logins_count"), "current_4wk_avg_logins"),
                 col(_mean_between(1, 4, "feature_usage_score"), "current_4wk_avg_usage"),
                 col(_at(2, "logins_count"), "prev_logins"),
                 col(_at(2, "feature_usage_score"), "prev_usage"),
                 col(_mean_between(5, 8, "logins_count"), "baseline_4wk_logins"),
                 col(_mean_between(5, 8, "feature_usage_score"), "baseline_4wk_usage"),
                 col(f"COUNT(CASE WHEN weeks_ago <= {RECENT_ROWS} THEN 1 END)",
                     "active_weeks_count")))
