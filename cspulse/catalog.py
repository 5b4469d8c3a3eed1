"""Named queries: every SURVEY section-2 operator applied to the fixture tables.

Each entry takes ``(spark, sf_dir)``, derives ``customers`` and
``customer_activity`` from the driver tables in ``sf_dir`` (whole tables,
no sampling) and returns the operator's result.  Exact decimals are turned
into doubles only here, at the reporting edge, so that results compare
value-for-value with the DuckDB oracle.
"""

from __future__ import annotations

import datetime as dt
import uuid
import weakref
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions.dates import age_month_part, month_trunc
from .functions.numeric import pct_change
from .functions.sql import lit, named
from .operators import consistency, periods, ranking, windows
from .operators.enrich import enrich as enrich_with
from .operators.enrich import top_k
from .plans import churn, cohorts, expansion, health, portfolio, ranked, rollups, trends
from .session import checkpoint_root
from .sources import blocks
from .sources.derive import FIXTURE_AS_OF, fixture_baseline, fixture_history, fixture_tables
from .sources.history import baseline
from .sources.tables import ACTIVITY_DOMAIN, CUSTOMER_DOMAIN, domain_faults
from .sources.upsert import REVISION, activity_table, upsert
from .sources.versions import VersionedTable, publish, read_published
from .state import CohortVisits, RunningTotals

AS_OF = FIXTURE_AS_OF
Query = Callable[[SparkSession, str], DataFrame]


def as_reported(df: DataFrame) -> DataFrame:
    """Cast exact decimals to double for reporting; other types unchanged."""
    return df.selectExpr(*[f"CAST(`{f.name}` AS DOUBLE) AS `{f.name}`"
                           if isinstance(f.dataType, T.DecimalType) else f"`{f.name}`"
                           for f in df.schema.fields])


_REGISTRY: dict[str, Query] = {}
_TABLES: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def tables(spark: SparkSession, sf_dir: str, days: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The derived (customers, customer_activity) plans, built once per session, folder and bound.

    Like views: the DataFrames are lazy, so every query still reads and
    derives the data when it runs; only the driver-side plan construction
    (file listing, analysis) is shared between queries.  ``days`` bounds the
    activity to that many days before the report date, at the scan.
    """
    per_session = _TABLES.setdefault(spark, {})
    if (sf_dir, days) not in per_session:
        since = None if days is None else AS_OF - dt.timedelta(days=days)
        per_session[sf_dir, days] = fixture_tables(spark, sf_dir, since)
    return per_session[sf_dir, days]


def query(name: str, days: int | None = None):
    """Register a query; ``days`` is the longest look-back of its filters."""
    def deco(fn: Callable[[DataFrame, DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            customers, activity = tables(spark, sf_dir, days)
            return as_reported(fn(customers, activity))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def baseline_query(name: str, days: int | None = None):
    """Register a query that also takes the derived baseline snapshot."""
    def deco(fn: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_reported(fn(*tables(spark, sf_dir, days), fixture_baseline(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


def queries() -> dict[str, Query]:
    return dict(_REGISTRY)


# ----------------------------------------------------------------- S: sources


@query("scan_customers")
def _scan_customers(cust, act):
    return cust


@query("scan_activity")
def _scan_activity(cust, act):
    return act


@query("assign_mrr")
def _assign_mrr(cust, act):
    return cust.select("customer_id", "plan_type", "mrr")


# ----------------------------------------------------------------- F: filters


@query("filter_trailing_30d", days=30)
def _filter_trailing(cust, act):
    return periods.trailing_window(act, AS_OF, 30)


@query("filter_half_open_period", days=56)
def _filter_half_open(cust, act):
    return periods.half_open_period(act, AS_OF, 56, 28)


@query("filter_status_in")
def _filter_status_in(cust, act):
    return periods.status_in(cust).select("customer_id", "company_name", "status")


@query("cohort_min_size")
def _cohort_min_size(cust, act):
    base = cohorts.cohort_base(cust)
    return (cohorts.cohort_metrics(base, AS_OF)
            .filter("cohort_size >= 5").select("cohort_month", "cohort_size"))


# -------------------------------------------------------------------- J: joins


@query("join_enrich_customers", days=30)
def _join_enrich(cust, act):
    return enrich_with(periods.recent_activity(act, AS_OF), cust,
                         ["company_name", "plan_type", "mrr", "status"])


@query("join_period_over_period", days=56)
def _join_pop(cust, act):
    return periods.period_over_period(act, AS_OF)


# --------------------------------------------------------------- G: aggregates


@query("recent_activity", days=30)
def _recent_activity(cust, act):
    return periods.recent_activity(act, AS_OF)


@query("current_metrics", days=28)
def _current_metrics(cust, act):
    return periods.current_metrics(act, AS_OF)


@query("prior_metrics", days=56)
def _prior_metrics(cust, act):
    return periods.prior_metrics(act, AS_OF)


@query("recent_usage", days=30)
def _recent_usage(cust, act):
    return periods.recent_activity(act, AS_OF, names=periods.EXPANSION_RECENT_NAMES)


@query("usage_trend_60d", days=60)
def _usage_trend_60d(cust, act):
    return periods.usage_trend_60d(act, AS_OF)


@query("customer_metrics", days=60)
def _customer_metrics(cust, act):
    return portfolio.customer_metrics(act, AS_OF)


@query("recent_trends", days=84)
def _recent_trends(cust, act):
    return windows.recent_trends(act, AS_OF)


@query("cohort_starting_metrics")
def _cohort_starting(cust, act):
    return (cohorts.cohort_metrics(cohorts.cohort_base(cust), AS_OF)
            .select("cohort_month", "cohort_size", "starter_count", "professional_count",
                    "enterprise_count", "starting_mrr", "avg_starting_mrr"))


@query("cohort_current_status")
def _cohort_status(cust, act):
    return (cohorts.cohort_metrics(cohorts.cohort_base(cust), AS_OF)
            .select("cohort_month", "active_customers", "at_risk_customers", "churned_customers",
                    "current_mrr", "active_mrr", "starter_to_pro_upgrades",
                    "pro_to_enterprise_upgrades"))


@query("cohort_engagement", days=30)
def _cohort_engagement(cust, act):
    return cohorts.cohort_engagement(cohorts.cohort_base(cust), act, AS_OF)


@query("cohort_age")
def _cohort_age(cust, act):
    return cohorts.cohort_age(cohorts.cohort_base(cust), AS_OF)


@query("cohort_retention_curve")
def _cohort_curve(cust, act):
    return cohorts.cohort_retention_curve(cust, act)


# ------------------------------------------------------------------ W: windows


@query("window_lag", days=84)
def _window_lag(cust, act):
    return windows.weekly_window_metrics(act, AS_OF).select(
        "customer_id", "activity_date", "logins_count", "prev_week_logins", "prev_week_usage")


@query("window_lead", days=84)
def _window_lead(cust, act):
    return windows.weekly_window_metrics(act, AS_OF).select(
        "customer_id", "activity_date", "logins_count", "next_week_logins", "next_week_usage")


@query("window_rolling_avg", days=84)
def _window_rolling(cust, act):
    return windows.weekly_window_metrics(act, AS_OF).select(
        "customer_id", "activity_date", "rolling_4wk_logins", "rolling_4wk_usage")


@query("window_row_number", days=84)
def _window_rn(cust, act):
    return windows.weekly_window_metrics(act, AS_OF).select(
        "customer_id", "activity_date", "weeks_ago")


@query("weekly_window_metrics", days=84)
def _weekly_window_metrics(cust, act):
    return windows.weekly_window_metrics(act, AS_OF).select(
        "customer_id", "activity_date", "logins_count", "feature_usage_score",
        "support_tickets_opened", "nps_score", "prev_week_logins", "prev_week_usage",
        "rolling_4wk_logins", "rolling_4wk_usage", "weeks_ago")


# -------------------------------------------------------------- T: sort/limit


@query("topk_mixed_order", days=30)
def _topk(cust, act):
    joined = enrich_with(periods.recent_activity(act, AS_OF), cust, ["company_name", "mrr"])
    return top_k(joined.select("customer_id", "company_name", "mrr", "avg_usage_score"),
                 [F.col("avg_usage_score").asc_nulls_last(), F.col("mrr").desc_nulls_first(),
                  F.col("customer_id").asc()], 100)


# ------------------------------------------------------------------- X: scalar


@query("scalar_month_trunc")
def _month_trunc(cust, act):
    return cust.selectExpr("customer_id", "signup_date",
                           named(month_trunc("signup_date"), "cohort_month"))


@query("scalar_age_month_part")
def _age_month_part(cust, act):
    return cust.selectExpr("customer_id", "signup_date",
                           named(age_month_part(lit(AS_OF), "signup_date"), "months_as_customer"))


@query("scalar_pct_change", days=60)
def _pct_change(cust, act):
    return periods.usage_trend_60d(act, AS_OF).selectExpr(
        "customer_id",
        named(pct_change("recent_usage", "prior_usage", "notnull"), "usage_growth_pct"),
        named(pct_change("recent_logins", "prior_logins"), "login_growth_pct"))


# ------------------------------------------------------------- scoring stages


@query("health_dimensions", days=30)
def _health_dimensions(cust, act):
    return health.health_dimensions(periods.recent_activity(act, AS_OF))


@query("health_score", days=30)
def _health_score(cust, act):
    s = health.health_scores(health.health_dimensions(periods.recent_activity(act, AS_OF)))
    return s.selectExpr("customer_id", "overall_health_score", "usage_health_score",
                        "support_health_score", "engagement_health_score",
                        *health.grade_and_action())


@query("risk_signals", days=56)
def _risk_signals(cust, act):
    return churn.risk_signals(periods.churn_period_metrics(act, AS_OF))


@query("risk_scores", days=56)
def _risk_scores(cust, act):
    return churn.risk_scores(churn.risk_signals(periods.churn_period_metrics(act, AS_OF)))


_EXP_COLS = ["customer_id", *expansion.SIGNALS, "avg_logins", "avg_usage_score", "total_tickets",
             "avg_nps", "recent_usage", "prior_usage", "plan_type", "mrr"]


@query("expansion_signals", days=60)
def _expansion_signals(cust, act):
    return expansion.expansion_signals(cust, act, AS_OF).select(*_EXP_COLS)


@query("expansion_scores", days=60)
def _expansion_scores(cust, act):
    return (expansion.expansion_scores(expansion.expansion_signals(cust, act, AS_OF))
            .select("expansion_score", *_EXP_COLS))


@query("trend_analysis", days=84)
def _trend_analysis(cust, act):
    return trends.trend_analysis(windows.recent_trends(act, AS_OF))


@query("trend_scores", days=84)
def _trend_scores(cust, act):
    return trends.trend_scores(trends.trend_analysis(windows.recent_trends(act, AS_OF)))


# --------------------------------------------------------------- composites


@query("customer_health", days=30)
def _customer_health(cust, act):
    return health.customer_health(cust, act, AS_OF)


@query("customer_health_full", days=30)
def _customer_health_full(cust, act):
    return health.customer_health(cust, act, AS_OF, limit=None)


@query("churn_risk", days=56)
def _churn_risk(cust, act):
    return churn.churn_risk(cust, act, AS_OF)


@query("churn_risk_full", days=56)
def _churn_risk_full(cust, act):
    return churn.churn_risk(cust, act, AS_OF, limit=None)


@query("expansion_opportunities", days=60)
def _expansion(cust, act):
    return expansion.expansion_opportunities(cust, act, AS_OF)


@query("expansion_opportunities_full", days=60)
def _expansion_full(cust, act):
    return expansion.expansion_opportunities(cust, act, AS_OF, limit=None)


@query("usage_trends", days=84)
def _usage_trends(cust, act):
    return trends.usage_trends(cust, act, AS_OF)


@query("usage_trends_full", days=84)
def _usage_trends_full(cust, act):
    return trends.usage_trends(cust, act, AS_OF, limit=None)


@query("cohort_retention", days=30)
def _cohort_retention(cust, act):
    return cohorts.cohort_retention(cust, act, AS_OF)


@query("cohort_retention_full", days=30)
def _cohort_retention_full(cust, act):
    return cohorts.cohort_retention(cust, act, AS_OF, limit=None)


# ------------------------------------------------------------------ rollups
# The plain names cover the whole portfolio (the ``_full`` ones are the same);
# ``_top100`` and ``_latest24`` summarise the limited reports.


def _churn_rollup(limit):
    return lambda cust, act: rollups.churn_risk_rollup(churn.churn_risk(cust, act, AS_OF, limit))


def _expansion_rollup(limit):
    return lambda cust, act: rollups.expansion_pipeline_rollup(
        expansion.expansion_opportunities(cust, act, AS_OF, limit))


def _trend_rollup(limit):
    return lambda cust, act: rollups.trend_portfolio_rollup(
        trends.usage_trends(cust, act, AS_OF, limit))


for _suffix, _limit in (("", None), ("_full", None), ("_top100", 100)):
    query(f"churn_risk_rollup{_suffix}", days=56)(_churn_rollup(_limit))
    query(f"expansion_pipeline_rollup{_suffix}", days=60)(_expansion_rollup(_limit))
    query(f"trend_portfolio_rollup{_suffix}", days=84)(_trend_rollup(_limit))


@query("cohort_compare_by_industry", days=30)
def _cohort_compare(cust, act):
    table = cohorts.cohort_table(cust, act, AS_OF, by=["industry"])
    return rollups.cohort_compare_by(table.filter("cohort_size >= 5"), "industry")


def _cohort_follow_up(rollup, limit):
    return lambda cust, act, baseline=None: rollup(
        cohorts.cohort_retention(cust, act, AS_OF, limit=limit, baseline=baseline))


for _name in ("best_cohorts", "worst_cohorts", "cohort_exec_summary"):
    _rollup = getattr(rollups, _name)
    query(_name, days=30)(_cohort_follow_up(_rollup, None))
    query(f"{_name}_latest24", days=30)(_cohort_follow_up(_rollup, cohorts.LATEST_COHORTS))
    baseline_query(f"{_name}_baseline", days=30)(_cohort_follow_up(_rollup, None))


@baseline_query("cohort_retention_baseline", days=30)
def _cohort_retention_baseline(cust, act, baseline):
    return cohorts.cohort_retention(cust, act, AS_OF, limit=None, baseline=baseline)


@query("percentile_metrics")
def _percentiles(cust, act):
    return rollups.percentile_metrics(cust, act)


@query("segment_customers", days=84)
def _segments(cust, act):
    return rollups.customer_segments(cust, act, AS_OF)


@query("engagement_consistency", days=84)
def _engagement_consistency(cust, act):
    return consistency.engagement_consistency(act, AS_OF)


# ------------------------------------------- whole lists in order, percentiles


@query("customer_health_ranked", days=30)
def _customer_health_ranked(cust, act):
    return ranked.ranked_list("customer_health", cust, act, AS_OF)


@query("churn_risk_ranked", days=56)
def _churn_risk_ranked(cust, act):
    return ranked.ranked_list("churn_risk", cust, act, AS_OF)


@query("expansion_opportunities_ranked", days=60)
def _expansion_ranked(cust, act):
    return ranked.ranked_list("expansion_opportunities", cust, act, AS_OF)


@query("usage_trends_ranked", days=84)
def _usage_trends_ranked(cust, act):
    return ranked.ranked_list("usage_trends", cust, act, AS_OF)


@query("percentile_mrr")
def _percentile_mrr(cust, act):
    return ranking.exact_percentiles(cust, "plan_type", "mrr")


# ------------------------------------------------ stored state and its tables


def _store(spark: SparkSession, name: str) -> str:
    """A new folder in the shared checkpoint folder."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _stored_activity(act: DataFrame) -> VersionedTable:
    """The fact table in two loads: first revisions that are later corrected, then the corrections.

    The first load lacks the last four weeks, has wrong logins in some rows and
    others on the wrong date; it also arrives a second time, after the corrections.
    """
    table = activity_table(act.sparkSession, _store(act.sparkSession, "activity"))
    first = act.where(f"activity_date < {lit(AS_OF - dt.timedelta(days=28))}").withColumns({
        "logins_count": F.expr("logins_count + CASE WHEN activity_id % 7 = 0 THEN 1000 ELSE 0 END"),
        "activity_date": F.expr("CASE WHEN activity_id % 41 = 0 THEN date_add(activity_date, 7) ELSE activity_date END"),
        REVISION: F.lit(1)})
    upsert(table, first)
    upsert(table, act.withColumn(REVISION, F.lit(2)).where(
        f"activity_date >= {lit(AS_OF - dt.timedelta(days=28))} OR activity_id % 7 = 0 OR activity_id % 41 = 0"))
    upsert(table, first)
    return table


@query("upserted_activity")
def _upserted_activity(cust, act):
    return _stored_activity(act).read().drop(REVISION)


@query("published_health", days=30)
def _published_health(cust, act):
    spark, root = act.sparkSession, _store(act.sparkSession, "published")
    report = health.customer_health(cust, act, AS_OF)
    publish(report.limit(3), root)
    publish(report, root)
    return read_published(spark, root, report.schema)


@query("state_retention_curve")
def _state_curve(cust, act):
    """The curve from per-date bitmaps: all dates but the last week's, then a refresh by that week."""
    spark = act.sparkSession
    table = activity_table(spark, _store(spark, "activity"))
    rows = act.withColumn(REVISION, F.lit(1))
    last = lit(AS_OF - dt.timedelta(days=7))
    visits = CohortVisits(spark, _store(spark, "visits"))
    for part in (f"activity_date < {last}", f"activity_date >= {last}"):
        upsert(table, rows.where(part))
        visits.refresh(cust, table)
    return visits.curve()


def _totals(act: DataFrame) -> RunningTotals:
    totals = RunningTotals(act.sparkSession, _store(act.sparkSession, "totals"))
    totals.extend(act)
    return totals


@query("totals_recent_activity")
def _totals_recent(cust, act):
    return _totals(act).recent_activity(AS_OF)


@query("totals_current_metrics")
def _totals_current(cust, act):
    return _totals(act).current_metrics(AS_OF)


@query("totals_prior_metrics")
def _totals_prior(cust, act):
    return _totals(act).prior_metrics(AS_OF)


@query("totals_usage_trend_60d")
def _totals_trend(cust, act):
    return _totals(act).usage_trend_60d(AS_OF)


@query("totals_churn_risk")
def _totals_churn(cust, act):
    """Churn risk of everyone from the totals of four dates."""
    return churn.churn_report(cust, _totals(act).churn_period_metrics(AS_OF), limit=None)


@query("stored_window_metrics")
def _stored_windows(cust, act):
    spark = act.sparkSession
    name = blocks.write_blocks(act, buckets=8)
    return blocks.stored_window_metrics(spark, name, AS_OF).select(
        "customer_id", "activity_date", "logins_count", "feature_usage_score",
        "support_tickets_opened", "nps_score", "prev_week_logins", "prev_week_usage",
        "rolling_4wk_logins", "rolling_4wk_usage", "weeks_ago")


def history_query(name: str, days: int | None = None):
    """Register a query that also takes the derived customer history."""
    def deco(fn: Callable[[DataFrame, DataFrame, DataFrame], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return as_reported(fn(*tables(spark, sf_dir, days), fixture_history(spark, sf_dir)))
        run.__name__ = name
        run.__doc__ = fn.__doc__
        _REGISTRY[name] = run
        return fn
    return deco


@history_query("customer_history")
def _customer_history(cust, act, history):
    return history


@history_query("baseline_at_signup")
def _baseline_at_signup(cust, act, history):
    return baseline(cust, history)


@history_query("baseline_at_quarter")
def _baseline_at_quarter(cust, act, history):
    return baseline(cust, history, "DATE '2024-07-01'")


@history_query("cohort_retention_at_signup", days=30)
def _cohort_retention_at_signup(cust, act, history):
    return cohorts.cohort_retention(cust, act, AS_OF, limit=None, baseline=baseline(cust, history))


# ------------------------------------------------------------- domain faults


@query("domain_faults_customers")
def _domain_faults_customers(cust, act):
    """Faults found in customers with seeded ones: plans, statuses, revenues, repeated rows."""
    seeded = cust.unionByName(cust.where("customer_id % 13 = 0")).withColumns({
        "plan_type": F.expr("CASE WHEN customer_id % 17 = 0 THEN 'Gold' WHEN customer_id % 19 <> 0 THEN plan_type END"),
        "status": F.expr("CASE WHEN customer_id % 23 = 0 THEN 'Lost' ELSE status END"),
        "mrr": F.expr("CASE WHEN customer_id % 29 = 0 THEN -mrr ELSE mrr END")})
    return domain_faults(seeded, CUSTOMER_DOMAIN, "customer_id")


@query("domain_faults_activity")
def _domain_faults_activity(cust, act):
    """Faults found in activity with seeded ones: scores, counts, nulls, repeated rows."""
    seeded = act.unionByName(act.where("activity_id % 13 = 0")).withColumns({
        "customer_id": F.expr("CASE WHEN activity_id % 17 <> 0 THEN customer_id END"),
        "logins_count": F.expr("CASE WHEN activity_id % 19 = 0 THEN -1 ELSE logins_count END"),
        "feature_usage_score": F.expr("feature_usage_score + CASE WHEN activity_id % 23 = 0 THEN 101 ELSE 0 END"),
        "nps_score": F.expr("CASE WHEN activity_id % 29 = 0 THEN 11 ELSE nps_score END")})
    return domain_faults(seeded, ACTIVITY_DOMAIN, "activity_id")
