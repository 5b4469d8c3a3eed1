"""How even a customer's engagement is: spread of weekly usage, and weeks left out.

The state is three sums (rows, usage, usage squared) and the dates seen, all of
which merge by addition or union, so parts of a customer's rows can be reduced
apart.  The relative variance n * sum(x^2) / sum(x)^2 - 1 comes from whole
numbers and does not depend on the order of the rows.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame

from ..functions.numeric import fix6
from ..functions.sql import col, named
from .periods import KEY
from .windows import LATEST_FIRST, RECENT_ROWS, trend_rows

_WIDE = "DECIMAL(20,0)"


def consistency_partials(rows: DataFrame) -> DataFrame:
    """Per customer: scored, total, squares (of the usage score) and the dates with a row."""
    score = f"CAST(feature_usage_score AS {_WIDE})"
    return rows.groupBy(KEY).agg(
        col("COUNT(feature_usage_score)", "scored"), col(f"SUM({score})", "total"),
        col(f"SUM({score} * {score})", "squares"), col("collect_set(activity_date)", "dates"))


def merge_partials(partials: DataFrame) -> DataFrame:
    """One partial per customer from several, of different rows."""
    return partials.groupBy(KEY).agg(
        col("SUM(scored)", "scored"), col("SUM(total)", "total"), col("SUM(squares)", "squares"),
        col("array_distinct(flatten(collect_list(dates)))", "dates"))


def consistency_measures(partials: DataFrame) -> DataFrame:
    """(customer_id, usage_spread, missing_weeks).

    ``usage_spread`` is the variance of the usage score over its squared mean
    (0 where all scores are 0, null without scores).  ``missing_weeks`` counts
    the weeks without a row between a customer's first and last.
    """
    n, s, q = (f"CAST({c} AS {_WIDE})" for c in ("scored", "total", "squares"))
    spread = f"CASE WHEN total = 0 THEN 0 ELSE ({n} * {q} - {s} * {s}) / ({s} * {s}) END"
    weeks = "datediff(array_max(dates), array_min(dates)) DIV 7 + 1"
    return partials.selectExpr(
        KEY, named(fix6(spread), "usage_spread"),
        named(f"CAST(greatest({weeks} - size(dates), 0) AS BIGINT)", "missing_weeks"))


def engagement_consistency(act: DataFrame, as_of: dt.date, weeks: int = 12, keep: int = RECENT_ROWS) -> DataFrame:
    """The measures over each customer's ``keep`` latest rows of the trend horizon.

    The row limit applies before the shuffle (as in ``windows.recent_rows``).
    """
    rows = trend_rows(act, as_of, weeks).selectExpr(
        KEY, "activity_date", "feature_usage_score",
        named(f"row_number() OVER ({LATEST_FIRST})", "weeks_ago")).filter(f"weeks_ago <= {keep}")
    return consistency_measures(consistency_partials(rows))
