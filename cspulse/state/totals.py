"""Running totals per customer and date: every period is the difference of two dates.

The partition of a date holds one row for each customer seen up to then: rows,
sums and counts of each measure from the start.  A period's measures are the
totals at its end less those before its start, so a band of 28 days or of 60
reads two partitions, whatever lies between them, and several bands are one
aggregate over the partitions of their ends.  A new date needs the last
partition and the new rows; a corrected one rewrites the dates from it on.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.numeric import mean_of
from ..functions.sql import col, lit, named
from ..operators.periods import (CURRENT_NAMES, EXPANSION_RECENT_NAMES, PRIOR_NAMES, RECENT_NAMES,
                                 days_before)
from ..sources.versions import VersionedTable

DATE, KEY = "activity_date", "customer_id"
_SOURCES = {"logins": "logins_count", "usage": "feature_usage_score",
            "tickets": "support_tickets_opened", "nps": "nps_score"}
SUMS = ["rows", *(f"{m}_{part}" for m in _SOURCES for part in ("sum", "n"))]
TOTALS = T.StructType([T.StructField(DATE, T.DateType()), T.StructField(KEY, T.IntegerType()),
                       *(T.StructField(s, T.LongType()) for s in SUMS)])

#: A period: its first date and the date before which it ends; None: open.
Band = tuple[dt.date | None, dt.date | None]


def daily_sums(activity: DataFrame) -> DataFrame:
    """One row per customer and date with the rows, sums and counts of that date."""
    aggs = [col("COUNT(1)", "rows")]
    for measure, column in _SOURCES.items():
        aggs += [col(f"COALESCE(SUM({column}), 0)", f"{measure}_sum"), col(f"COUNT({column})", f"{measure}_n")]
    return activity.groupBy(KEY, DATE).agg(*aggs)


def measures(band: str, names: dict[str, str]) -> list[str]:
    """Select items of a band's measures, named as the period aggregates name them."""
    out = []
    for measure, name in names.items():
        if measure == "rows":
            out.append(f"{band}_rows AS {name}")
        elif measure == "tickets":
            out.append(f"CASE WHEN {band}_tickets_n > 0 THEN {band}_tickets_sum END AS {name}")
        else:
            out.append(named(mean_of(f"{band}_{measure}_sum", f"{band}_{measure}_n"), name))
    return out


class RunningTotals:
    """The running totals below ``root``."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.table = VersionedTable(spark, root, TOTALS, DATE)

    def dates(self, version: int | None = None) -> list[dt.date]:
        """Dates with a partition, in order."""
        return sorted(dt.date.fromisoformat(v) for v in self.table.manifest(version)["parts"])

    def extend(self, activity: DataFrame, first: dt.date | None = None, source: int | None = None) -> None:
        """Replace the totals from ``first`` on (default: from the start) by those of ``activity``.

        Rows before ``first`` are not used: the partition before it has them.
        The dates are collected, one value a calendar date.  A customer's rows
        meet as one row a date.
        """
        base = self.table.current()
        known = self.dates(base)
        kept = [d for d in known if first is not None and d < first]
        rows = activity if first is None else activity.where(f"{DATE} >= {lit(first)}")
        fresh = sorted(r[0] for r in rows.select(DATE).where(f"{DATE} IS NOT NULL").distinct().collect())
        sums = daily_sums(rows.where(f"{DATE} IS NOT NULL")).select(KEY, DATE, *SUMS)
        if kept:
            sums = sums.unionByName(self.table.read(base, values=[kept[-1].isoformat()]).select(KEY, DATE, *SUMS))
        along = f"PARTITION BY {KEY} ORDER BY {DATE}"
        running = sums.selectExpr(
            KEY, f"{DATE} AS _from", f"LEAD({DATE}) OVER ({along}) AS _until",
            *(f"SUM({s}) OVER ({along} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS {s}" for s in SUMS))
        every = f"array({', '.join(map(lit, fresh))})" if fresh else "CAST(array() AS ARRAY<DATE>)"
        dense = running.selectExpr(
            KEY, *SUMS, f"explode(filter({every}, d -> d >= _from AND (_until IS NULL OR d < _until))) AS {DATE}")
        self.table.replace(dense, base, drop=[d.isoformat() for d in known if d not in set(kept)],
                           meta={} if source is None else {"source": source})

    def refresh(self, activity: VersionedTable) -> dt.date | None:
        """Bring the totals up to the latest version of ``activity``; returns the first date that was read."""
        version = activity.current()
        written, dropped = activity.changed(self.table.manifest()["meta"].get("source"), version)
        if not written | dropped:
            return None
        first = min(written | dropped)
        self.extend(activity.read(version, since=first), dt.date.fromisoformat(first), version)
        return dt.date.fromisoformat(first)

    def bands(self, bands: dict[str, Band], version: int | None = None) -> DataFrame:
        """Per customer the sums of each band (``<band>_<sum>``), for customers with rows in any.

        Reads the partitions at the bands' ends: one scan and one aggregation.
        """
        version = self.table.current() if version is None else version
        dates = self.dates(version)

        def before(bound: dt.date | None) -> dt.date | None:
            """The last date under ``bound``; None if there is none."""
            at = len(dates) if bound is None else bisect_left(dates, bound)
            return dates[at - 1] if at else None

        ends = {name: (before(first) if first is not None else None, before(until))
                for name, (first, until) in bands.items()}
        used = {d.isoformat() for pair in ends.values() for d in pair if d is not None}
        rows = self.table.read(version, values=used)
        aggs = []
        for name, (low, high) in ends.items():
            sign = " ".join([f"WHEN {lit(high)} THEN 1" if high != low and high is not None else "",
                             f"WHEN {lit(low)} THEN -1" if high != low and low is not None else ""]).strip()
            for s in SUMS:
                total = f"SUM({s} * CASE {DATE} {sign} ELSE 0 END)" if sign else "CAST(SUM(0) AS BIGINT)"
                aggs.append(col(total, f"{name}_{s}"))
        return rows.groupBy(KEY).agg(*aggs).where(" OR ".join(f"{name}_rows > 0" for name in bands))

    # The period aggregates of the analyses, by the difference of two dates.

    def recent_activity(self, as_of: dt.date, days: int = 30, names: dict[str, str] = RECENT_NAMES) -> DataFrame:
        """As ``periods.recent_activity``."""
        return self.bands({"recent": (days_before(as_of, days), None)}).selectExpr(KEY, *measures("recent", names))

    def current_metrics(self, as_of: dt.date, weeks: int = 4) -> DataFrame:
        """As ``periods.current_metrics``."""
        return self.bands({"now": (days_before(as_of, 7 * weeks), as_of)}).selectExpr(
            KEY, *measures("now", CURRENT_NAMES))

    def prior_metrics(self, as_of: dt.date, weeks: int = 4) -> DataFrame:
        """As ``periods.prior_metrics``."""
        return self.bands({"prior": (days_before(as_of, 14 * weeks), days_before(as_of, 7 * weeks))}).selectExpr(
            KEY, *measures("prior", PRIOR_NAMES))

    def churn_period_metrics(self, as_of: dt.date, weeks: int = 4) -> DataFrame:
        """As ``periods.churn_period_metrics``."""
        edge = days_before(as_of, 7 * weeks)
        both = self.bands({"now": (edge, as_of), "prior": (days_before(as_of, 14 * weeks), edge)})
        return both.where("now_rows > 0").selectExpr(
            KEY, *measures("now", CURRENT_NAMES), *measures("prior", PRIOR_NAMES))

    def usage_trend_60d(self, as_of: dt.date, days: int = 30) -> DataFrame:
        """As ``periods.usage_trend_60d``."""
        edge = days_before(as_of, days)
        both = self.bands({"recent": (edge, None), "prior": (days_before(as_of, 2 * days), edge)})
        return both.selectExpr(KEY, *(item for m in ("logins", "usage") for band in ("recent", "prior")
                                      for item in measures(band, {m: f"{band}_{m}"})))

    def expansion_period_metrics(self, as_of: dt.date, days: int = 30) -> DataFrame:
        """As ``periods.expansion_period_metrics``."""
        edge = days_before(as_of, days)
        both = self.bands({"recent": (edge, None), "prior": (days_before(as_of, 2 * days), edge)})
        return both.where("recent_rows > 0").selectExpr(
            KEY, *measures("recent", EXPANSION_RECENT_NAMES), *measures("recent", {"usage": "recent_usage"}),
            *measures("prior", {"usage": "prior_usage"}))
