"""Late and corrected activity rows: upsert by key into a versioned, date-partitioned table.

Of all rows ever loaded under a key the one of the greatest revision stays
(equal revisions: the greatest hash of the row), so loads give one table in any
order, repeated or not.  A correction may move a row to another date.  Only the
partitions that gain or lose a row are rewritten; finding them reads the key,
date and revision columns alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas
from ..session import materialize, release
from .versions import VersionedTable

REVISION = "revision"
STORED_ACTIVITY = T.StructType([*schemas.ACTIVITY.fields, T.StructField(REVISION, T.LongType(), False)])


def activity_table(spark: SparkSession, root: str) -> VersionedTable:
    """The versioned fact table: activity with its revision, a partition a date."""
    return VersionedTable(spark, root, STORED_ACTIVITY, "activity_date")


def _winner(columns: list[str]) -> str:
    # Of two rows of one revision the greater hash stays, whichever came first.
    return f"struct({REVISION}, xxhash64({', '.join(columns)}))"


def upsert(table: VersionedTable, changes: DataFrame, key: str = "activity_id") -> int | None:
    """Publish ``table`` with ``changes`` (its columns) applied; None if they change nothing.

    Rows without key or partition value are refused: ValueError, nothing written.
    """
    columns, by = table.schema.fieldNames(), table.by
    base = table.current()
    typed = changes.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in table.schema.fields])
    newest = materialize(typed.groupBy(key).agg(
        F.max_by(F.struct(*columns), F.expr(_winner(columns))).alias("r")).select("r.*"), "upsert")
    made = [newest]
    try:
        if not newest.where(f"{key} IS NULL OR {by} IS NULL OR {REVISION} IS NULL").isEmpty():
            raise ValueError(f"changes need {key}, {by} and {REVISION}")
        # Where the keys are now, and at which revision.
        held = table.read(base).select(key, F.col(by).alias("_date"), F.expr(_winner(columns)).alias("_had"))
        won = materialize(newest.join(held, key, "left").where(
            f"_had IS NULL OR _had < {_winner(columns)}").drop("_had"), "upsert")
        made.append(won)
        dates = {str(r[0]) for r in won.select(by).union(won.select("_date")).distinct().collect()
                 if r[0] is not None}
        if not dates:
            return None
        old = table.read(base, values=dates).join(won.select(key), key, "left_anti")
        # A partition that only loses rows and has none left is dropped.
        return table.replace(old.select(*columns).unionByName(won.select(*columns)), base, drop=dates)
    finally:
        release(*made)
