"""Readers and writers for the two analysis tables.

Both tables are read with their declared schema (no inference).  The fact
table is written partitioned by ``activity_date`` so that every date bound
in the analyses becomes partition pruning at the scan, on top of Parquet
row-group filtering.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions import rules
from ..functions.sql import lit


def _load(spark: SparkSession, path: str, schema) -> DataFrame:
    # partition columns (activity_date) come back last; restore the declared order
    return spark.read.schema(schema).parquet(path).select(*[f.name for f in schema.fields])


def load_customers(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.CUSTOMERS)


def load_activity(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.ACTIVITY)


def load_baseline(spark: SparkSession, path: str) -> DataFrame:
    return _load(spark, path, schemas.BASELINE)


def conform(df: DataFrame, schema) -> DataFrame:
    """Select and cast to a declared schema (column order and types)."""
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


# Domain of each column beyond its type: SQL that holds for every good value.
CUSTOMER_DOMAIN = {
    "customer_id": "customer_id IS NOT NULL",
    "plan_type": f"plan_type IN ({', '.join(lit(p) for p in rules.PLANS)})",
    "status": f"status IN ({', '.join(lit(s) for s in rules.STATUSES)})",
    "mrr": "mrr >= 0",
}
ACTIVITY_DOMAIN = {
    "activity_id": "activity_id IS NOT NULL",
    "customer_id": "customer_id IS NOT NULL",
    "activity_date": "activity_date IS NOT NULL",
    "logins_count": "logins_count >= 0",
    "feature_usage_score": "feature_usage_score BETWEEN 0 AND 100",
    "support_tickets_opened": "support_tickets_opened >= 0",
    "nps_score": "nps_score BETWEEN 0 AND 10",
}


def domain_faults(df: DataFrame, domain: dict[str, str], key: str) -> DataFrame:
    """One row (column_name, faults) per column: values outside their domain, repeats of the key.

    Only a key may not be null; a null elsewhere is no fault.  One scan, and
    one shuffle of keys for the repeats.
    """
    counts = ", ".join(f"'{c}', COUNT(CASE WHEN {ok} THEN NULL WHEN {c} IS NULL AND "
                       f"{lit(not ok.endswith('IS NOT NULL'))} THEN NULL ELSE 1 END)"
                       for c, ok in domain.items())
    outside = (df.agg(F.expr(f"map({counts})").alias("faults"))
               .selectExpr("explode(faults) AS (column_name, faults)"))
    repeats = (df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1")
               .agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("faults"))
               .selectExpr(f"'{key} repeated' AS column_name", "faults"))
    return outside.unionByName(repeats)


def write_customers(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    conform(df, schemas.CUSTOMERS).write.mode(mode).parquet(path)


def write_activity(df: DataFrame, path: str, mode: str = "overwrite",
                   replace: str = "dates") -> None:
    """Write the fact table, one directory per activity date.

    With ``mode="overwrite"`` only the dates present in ``df`` are replaced
    (dynamic partition overwrite), so reloading a week never drops the rest
    of the history; ``replace="all"`` overwrites the whole table.

    Range partitioning on (date, customer) gives each task a contiguous slice
    of dates, so a task writes few files, while a date holding a large share
    of rows is still split across several tasks (a hash on the date alone
    would send a whole date to one task).
    """
    (conform(df, schemas.ACTIVITY)
     .repartitionByRange("activity_date", "customer_id")
     .sortWithinPartitions("activity_date", "customer_id")
     .write.mode(mode)
     .option("partitionOverwriteMode", "dynamic" if replace == "dates" else "static")
     .partitionBy("activity_date").parquet(path))
