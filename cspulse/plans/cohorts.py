"""Signup-month cohort retention and the retention curve.

Plan for ``cohort_retention``:

* one aggregate over ``customers`` grouped by cohort month computes the
  starting mix, current status counts, MRR sums and upgrades together (the
  reference builds three aggregates over the same base and joins them);
* engagement is row-weighted over Active customers' last 30 days.  The fact
  table is first reduced to one row of sums/counts per customer, joined on
  the unique customer key, and summed per cohort, so raw activity rows never
  shuffle by cohort (a cohort month is a very hot key: a few dozen values);
* the two small per-cohort results are joined on ``cohort_month``.

By default "starting" and "current" plan/MRR come from the same row, as in
the reference (revenue retention is then 100 %).  A ``baseline`` snapshot
(customer_id, starting_plan, starting_mrr) makes them differ; customers
missing from the snapshot are taken as unchanged.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.dates import age_month_part, age_total_months, month_trunc
from ..functions.numeric import avg_exact, mean_of, pct_of, ratio_pct
from ..functions.sql import col, lit, named
from ..operators.enrich import sort_small, top_k
from ..operators.periods import activity_partials

COHORT = "cohort_month"
LATEST_COHORTS = 24
BASE_COLUMNS = ["customer_id", "company_name", COHORT, "signup_date", "industry", "status",
                "current_plan", "current_mrr"]


def cohort_base(customers: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    base = customers.selectExpr(
        "customer_id", "company_name", named(month_trunc("signup_date"), COHORT),
        "signup_date", "industry", "status", "plan_type AS current_plan", "mrr AS current_mrr")
    if baseline is None:
        return base.selectExpr("*", "current_plan AS starting_plan",
                               "current_mrr AS starting_mrr")
    snap = baseline.selectExpr("customer_id", "starting_plan AS _sp", "starting_mrr AS _sm")
    return (base.join(snap, "customer_id", "left")
            .selectExpr(*BASE_COLUMNS,
                        "COALESCE(_sp, current_plan) AS starting_plan",
                        "COALESCE(_sm, current_mrr) AS starting_mrr"))


def _count_if(cond: str) -> str:
    return f"COUNT(CASE WHEN {cond} THEN 1 END)"


def cohort_metrics(base: DataFrame, as_of: dt.date, by: Sequence[str] = (),
                   total_months: bool = False) -> DataFrame:
    """Starting mix, status, MRR and upgrades per cohort (one aggregate).

    ``cohort_age_months`` is the AGE month field like the reference (0..11);
    ``total_months=True`` gives the whole months since the cohort started.
    """
    age = age_total_months if total_months else age_month_part
    return (base.filter(f"{COHORT} IS NOT NULL")
            .groupBy(COHORT, *by)
            .agg(col("COUNT(1)", "cohort_size"),
                 col(_count_if("starting_plan = 'Starter'"), "starter_count"),
                 col(_count_if("starting_plan = 'Professional'"), "professional_count"),
                 col(_count_if("starting_plan = 'Enterprise'"), "enterprise_count"),
                 col("SUM(starting_mrr)", "starting_mrr"),
                 col(avg_exact("starting_mrr"), "avg_starting_mrr"),
                 col(_count_if("status = 'Active'"), "active_customers"),
                 col(_count_if("status = 'At Risk'"), "at_risk_customers"),
                 col(_count_if("status = 'Churned'"), "churned_customers"),
                 col("SUM(current_mrr)", "current_mrr"),
                 col("SUM(CASE WHEN status = 'Active' THEN current_mrr ELSE 0 END)", "active_mrr"),
                 col(_count_if("starting_plan = 'Starter' AND current_plan = 'Professional'"),
                     "starter_to_pro_upgrades"),
                 col(_count_if("starting_plan = 'Professional' AND current_plan = 'Enterprise'"),
                     "pro_to_enterprise_upgrades"))
            .withColumn("cohort_age_months", col(age(lit(as_of), COHORT))))


def cohort_engagement(base: DataFrame, activity: DataFrame, as_of: dt.date, days: int = 30,
                      by: Sequence[str] = ()) -> DataFrame:
    """Row-weighted 30-day engagement of Active customers per cohort."""
    members = (base.filter(f"status = 'Active' AND {COHORT} IS NOT NULL")
               .select("customer_id", COHORT, *by))
    per_customer = activity_partials(activity, as_of, days)
    return (per_customer.join(members, "customer_id", "inner")
            .groupBy(COHORT, *by)
            .agg(col(mean_of("SUM(logins_sum)", "SUM(logins_n)"), "avg_logins"),
                 col(mean_of("SUM(usage_sum)", "SUM(usage_n)"), "avg_usage_score"),
                 col(mean_of("SUM(nps_sum)", "SUM(nps_n)"), "avg_nps"),
                 col("SUM(tickets_sum)", "total_tickets")))


def cohort_age(base: DataFrame, as_of: dt.date) -> DataFrame:
    """Month field of AGE(as_of, cohort_month) per distinct cohort."""
    return (base.select(COHORT).filter(f"{COHORT} IS NOT NULL").distinct()
            .withColumn("cohort_age_months", col(age_month_part(lit(as_of), COHORT))))


def cohort_table(customers: DataFrame, activity: DataFrame, as_of: dt.date,
                 baseline: DataFrame | None = None, by: Sequence[str] = (),
                 days: int = 30, total_months: bool = False) -> DataFrame:
    """All 27 cohort columns for every cohort (no size filter, no limit)."""
    base = cohort_base(customers, baseline)
    metrics = cohort_metrics(base, as_of, by, total_months)
    revenue_ratio = ratio_pct("current_mrr", "starting_mrr")
    # Null groups of ``by`` keep their engagement.  The groups are plain columns, never null, so
    # Spark knows that they are unique and drops the join where no engagement is asked for.
    groups = {f"_{c}": f"COALESCE(CAST({c} AS STRING), '')" for c in by} | {f"_no_{c}": f"{c} IS NULL" for c in by}
    engagement = cohort_engagement(base.selectExpr("*", *(named(e, g) for g, e in groups.items())),
                                   activity, as_of, days, list(groups))
    keyed = engagement.withColumnRenamed(COHORT, f"_{COHORT}")
    same = " AND ".join([f"{COHORT} = _{COHORT}", *(f"({e}) = {g}" for g, e in groups.items())])
    return metrics.join(keyed, F.expr(same), "left").selectExpr(
        COHORT, *by, "cohort_age_months", "cohort_size", "starter_count", "professional_count",
        "enterprise_count",
        "active_customers", named(pct_of("active_customers", "cohort_size"),
                                  "customer_retention_rate"),
        "at_risk_customers", named(pct_of("at_risk_customers", "cohort_size"), "at_risk_rate"),
        "churned_customers", named(pct_of("churned_customers", "cohort_size"), "churn_rate"),
        "ROUND(starting_mrr, 2) AS starting_mrr",
        "ROUND(current_mrr, 2) AS current_mrr",
        named(f"ROUND({revenue_ratio}, 1)", "revenue_retention_rate"),
        "ROUND(current_mrr - starting_mrr, 2) AS net_mrr_change",
        "starter_to_pro_upgrades", "pro_to_enterprise_upgrades",
        named(pct_of("starter_to_pro_upgrades + pro_to_enterprise_upgrades", "cohort_size"),
              "upgrade_rate"),
        "ROUND(avg_logins, 1) AS avg_weekly_logins",
        "ROUND(avg_usage_score, 1) AS avg_usage_score",
        "ROUND(avg_nps, 1) AS avg_nps",
        "total_tickets AS total_support_tickets_30d",
        "ROUND(avg_starting_mrr, 2) AS avg_starting_mrr_per_customer",
        named(f"ROUND({mean_of('active_mrr', 'active_customers')}, 2)",
              "avg_current_mrr_per_active_customer"),
        named(rules.at_least(revenue_ratio, rules.COHORT_HEALTH), "cohort_health"),
        named(rules.lifecycle_stage("cohort_age_months"), "lifecycle_stage"))


def cohort_limit(limit: int | None) -> int | None:
    """Cohorts shown beside customer lists of ``limit`` rows: all where those show all."""
    return None if limit is None else LATEST_COHORTS


def cohort_retention(customers: DataFrame, activity: DataFrame, as_of: dt.date,
                     min_size: int = 5, limit: int | None = LATEST_COHORTS,
                     baseline: DataFrame | None = None, days: int = 30,
                     total_months: bool = False) -> DataFrame:
    """The latest ``limit`` cohorts of at least ``min_size``; ``None``: all of them, unsorted."""
    table = cohort_table(customers, activity, as_of, baseline, days=days,
                         total_months=total_months)
    return top_k(table.filter(f"cohort_size >= {min_size}"), [F.col(COHORT).desc()], limit)


def cohort_retention_curve(customers: DataFrame, activity: DataFrame,
                           total_months: bool = False, approximate: bool = False) -> DataFrame:
    """Distinct active customers per cohort and month since signup.

    The reference uses the month *field* of AGE (wraps after 12 months);
    ``total_months=True`` counts whole months instead.  The fact table is
    shuffled once: it is reduced to one row per customer with the set of its
    dates (partial aggregation; the set is bounded by the calendar), joined to
    the customer on the same key, and turned into the customer's distinct
    months, so counting rows counts customers.  ``approximate=True`` counts with
    a HyperLogLog++ sketch.  The result (cohorts x months) is small and is
    returned ordered like the reference.
    """
    visits = activity.groupBy("customer_id").agg(col("collect_set(activity_date)", "_dates"))
    months = age_total_months if total_months else age_month_part
    joined = visits.join(customers.select("customer_id", "signup_date"), "customer_id", "inner")
    # A customer without signup date has no month since signup, but one row like any other.
    return (joined.selectExpr(named(month_trunc("signup_date"), COHORT), "customer_id",
                              "explode(array_distinct(transform(_dates, d -> "
                              f"{months('d', 'signup_date')}))) AS months_since_signup")
            .groupBy(COHORT, "months_since_signup")
            .agg(col("approx_count_distinct(customer_id)" if approximate
                     else "COUNT(1)", "active_customers"))
            .transform(sort_small, [F.col(COHORT), F.col("months_since_signup")]))
