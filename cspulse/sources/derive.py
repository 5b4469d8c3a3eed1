"""Derive ``customers`` and ``customer_activity`` from the driver tables.

The benchmark fixtures ship TPC-H-like ``customer``/``nation`` tables and an
``events`` stream, not the two analysis tables.  Both are derived here with
deterministic expressions (FIXTURES.md section 2); the DuckDB oracle derives
them with the same expressions, so both engines analyse identical rows.

* customers: one row per ``customer`` joined to its ``nation``.
* customer_activity: one row per (user, event day); day ``i`` after
  2024-01-01 becomes the weekly date 2024-01-01 + 7*i, giving every user a
  weekly series.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession

from ..functions.rules import Raw, ladder
from ..functions.sql import col, lit
from ..operators.pricing import assign_mrr
from .history import versions

# Fixed values of the fixture derivation (FIXTURES.md section 2).
SIGNUP_ORIGIN = dt.date(2022, 9, 1)
SIGNUP_STEP, SIGNUP_SPAN = 37, 696
PLAN_BALANCE_CUTS = [(6000, "Starter"), (9000, "Professional")]  # else Enterprise
STATUS_CUTS = [(15, "Active"), (17, "At Risk")]                 # k % 20, else Churned
MRR_VARIANCE_SPAN = {"Starter": 3001, "Professional": 10001, "Enterprise": 50001}
MRR_MULTIPLIER = 7919                                            # variance = ((k*7919) % span) / (span-1)
ACTIVITY_ORIGIN = dt.date(2024, 1, 1)
LOGINS_PER_EVENT = 10
DAYS_PER_USER = 100_000                                          # activity_id = user_id * this + i
FIXTURE_AS_OF = dt.date(2024, 7, 29)


def derive_customers(customer: DataFrame, nation: DataFrame) -> DataFrame:
    plan = ladder([(f"c_acctbal < {cut}", name) for cut, name in PLAN_BALANCE_CUTS],
                  "Enterprise")
    status = ladder([(f"c_custkey % 20 < {cut}", name) for cut, name in STATUS_CUTS], "Churned")
    base = (customer.join(nation, customer.c_nationkey == nation.n_nationkey, "inner")
            .selectExpr("CAST(c_custkey AS INT) AS customer_id",
                        "c_name AS company_name",
                        f"date_add({lit(SIGNUP_ORIGIN)}, CAST((c_custkey * {SIGNUP_STEP}) % "
                        f"{SIGNUP_SPAN} AS INT)) AS signup_date",
                        f"{plan} AS plan_type",
                        "c_mktsegment AS industry",
                        "n_name AS account_owner",
                        f"{status} AS status",
                        f"{_fixture_variance('c_custkey', plan)} AS _variance"))
    return assign_mrr(base, "_variance").drop("_variance")


def _fixture_variance(k: str, plan: str) -> str:
    """Deterministic stand-in for RANDOM(): a per-customer value in [0, 1].

    ``(k*7919) % span / (span-1)`` times the plan's range lands on whole cents,
    so ``assign_mrr`` yields ``base + ((k*7919) % span) / 100`` exactly.
    """
    steps = [(f"{plan} = {lit(name)}",
              Raw(f"CAST(({k} * {MRR_MULTIPLIER}) % {span} AS DECIMAL(20,0)) / {span - 1}"))
             for name, span in MRR_VARIANCE_SPAN.items()]
    return ladder(steps)


def activity_aggs() -> list:
    """Per (user, day) aggregates shared by the batch and streaming derivations."""
    # Summed as decimals, so the mean does not depend on the order of the rows.
    usage = "CAST(sum(CAST(value AS DECIMAL(18,6))) / count(value) AS DECIMAL(18,6))"
    top_view = "max(CASE WHEN event_type = 'view' THEN value END)"
    return [col("count(1)", "n"),
            col(f"CAST(round(CASE WHEN {usage} > 100 THEN 100 ELSE {usage} END, 0) AS INT)",
                "feature_usage_score"),
            col("CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS INT)",
                "support_tickets_opened"),
            col(f"CAST(CASE WHEN {top_view} IS NULL THEN NULL WHEN {top_view} >= 100 THEN 10 "
                f"ELSE floor({top_view} / 10) END AS INT)", "nps_score")]


def activity_columns(day_index: str = "i") -> list[str]:
    """Map (user_id, day index, aggregates) to the customer_activity schema."""
    return [f"CAST(user_id * {DAYS_PER_USER} + {day_index} AS BIGINT) AS activity_id",
            "CAST(user_id AS INT) AS customer_id",
            f"date_add({lit(ACTIVITY_ORIGIN)}, {day_index} * 7) AS activity_date",
            f"CAST(n * {LOGINS_PER_EVENT} AS INT) AS logins_count",
            "feature_usage_score", "support_tickets_opened", "nps_score"]


def derive_activity(events: DataFrame, since: dt.date | None = None) -> DataFrame:
    """One row per (user, event day); ``since`` keeps activity dates from then on.

    The bound becomes a literal on the raw ``ts`` column, so the scan of
    ``events`` can skip the row groups (or partitions) before it.
    """
    if since is not None:
        first = ACTIVITY_ORIGIN + dt.timedelta(days=-(-(since - ACTIVITY_ORIGIN).days // 7))
        events = events.filter(f"ts >= TIMESTAMP_NTZ '{first.isoformat()} 00:00:00'")
    return (events.selectExpr("user_id", "event_type", "value",
                              f"datediff(to_date(ts), {lit(ACTIVITY_ORIGIN)}) AS i")
            .groupBy("user_id", "i")
            .agg(*activity_aggs())
            .selectExpr(*activity_columns()))


def derive_baseline(customer: DataFrame) -> DataFrame:
    """The optional snapshot (customer_id, starting_plan, starting_mrr) for the fixtures.

    Every fourth customer started one plan lower; the starting revenue is 70 to
    149 percent of today's, by signup month; every eleventh customer is missing.
    """
    signup = (f"date_add({lit(SIGNUP_ORIGIN)}, CAST((c_custkey * {SIGNUP_STEP}) % {SIGNUP_SPAN}"
              " AS INT))")
    plan = ladder([(f"c_acctbal < {cut}", name) for cut, name in PLAN_BALANCE_CUTS], "Enterprise")
    lower = ladder([("c_custkey % 4 <> 0", Raw(plan)), (f"{plan} = 'Enterprise'", "Professional")],
                   "Starter")
    percent = f"70 + ((year({signup}) * 12 + month({signup})) * 17) % 80"
    rows = assign_mrr(customer.filter("c_custkey % 11 <> 0").selectExpr(
        "CAST(c_custkey AS INT) AS customer_id", f"{plan} AS plan_type",
        f"{lower} AS starting_plan", f"CAST({percent} AS DECIMAL(5,0)) AS _percent",
        f"{_fixture_variance('c_custkey', plan)} AS _variance"), "_variance")
    return rows.selectExpr("customer_id", "starting_plan",
                           "CAST(ROUND(mrr * _percent / 100, 2) AS DECIMAL(10,2)) AS starting_mrr")


# Fixed values of the derived snapshots (FIXTURES.md section 2).
ORDER_ORIGIN, SNAPSHOT_ORIGIN, SNAPSHOT_SPAN = dt.date(1995, 1, 1), dt.date(2022, 1, 1), 941
PLAN_PRICE_CUTS = [(150_000, "Starter"), (300_000, "Professional")]  # else Enterprise


def derive_snapshots(orders: DataFrame) -> DataFrame:
    """Recorded states (customer_id, snapshot_date, recorded, plan_type, mrr) of customers, one an order.

    The order's price gives the plan, its key the revenue within the plan and
    its date a day of 2022-01-01 to 2024-07-29; ``recorded`` is the order's key,
    so that of one customer and day the last order counts.
    """
    plan = ladder([(f"o_totalprice < {cut}", name) for cut, name in PLAN_PRICE_CUTS], "Enterprise")
    rows = orders.selectExpr(
        "CAST(o_custkey AS INT) AS customer_id",
        f"date_add({lit(SNAPSHOT_ORIGIN)}, datediff(to_date(o_orderdate), {lit(ORDER_ORIGIN)}) % {SNAPSHOT_SPAN})"
        " AS snapshot_date", "o_orderkey AS recorded", f"{plan} AS plan_type",
        f"{_fixture_variance('o_orderkey', plan)} AS _variance")
    return assign_mrr(rows, "_variance").drop("_variance")


# Declared schemas of the driver tables that feed the derivation: reading with
# a schema skips footer-based inference (the same at every scale factor).
DRIVER_SCHEMAS = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
}


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reader = spark.read
    if name in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[name])
    return reader.parquet(f"{sf_dir}/{name}.parquet")


def fixture_tables(spark: SparkSession, sf_dir: str,
                   since: dt.date | None = None) -> tuple[DataFrame, DataFrame]:
    """(customers, customer_activity) derived from the driver tables in ``sf_dir``.

    ``since`` bounds the activity dates that are read.
    """
    customers = derive_customers(read_driver_table(spark, sf_dir, "customer"),
                                 read_driver_table(spark, sf_dir, "nation"))
    activity = derive_activity(read_driver_table(spark, sf_dir, "events"), since)
    return customers, activity


def fixture_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline snapshot derived from the driver tables in ``sf_dir``."""
    return derive_baseline(read_driver_table(spark, sf_dir, "customer"))


def fixture_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer versions (plan_type, mrr, valid_from, valid_to) derived from the orders in ``sf_dir``."""
    return versions(derive_snapshots(read_driver_table(spark, sf_dir, "orders")), latest="recorded")
