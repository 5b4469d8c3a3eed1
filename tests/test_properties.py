"""Properties on the sf0.01 fixture tables: rewritten plans equal literal forms."""

import pytest
from conftest import AS_OF, SF01

from cspulse.operators import periods, windows
from cspulse.plans import (churn_risk, cohort_table, customer_health, expansion_opportunities,
                           expansion_signals, risk_scores, risk_signals, usage_trends)
from cspulse.sources.derive import fixture_tables


@pytest.fixture(scope="module")
def fx(spark):
    cust, act = fixture_tables(spark, SF01)
    return cust.cache(), act.cache()


def same_rows(a, b):
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_merged_churn_periods_equal_left_join(fx):
    _, act = fx
    merged = periods.churn_period_metrics(act, AS_OF)
    literal = periods.period_over_period(act, AS_OF)
    same_rows(merged.select(*literal.columns), literal)


def test_merged_expansion_periods_equal_join(fx):
    _, act = fx
    merged = periods.expansion_period_metrics(act, AS_OF)
    recent = periods.recent_activity(act, AS_OF, names=periods.EXPANSION_RECENT_NAMES)
    trend = periods.usage_trend_60d(act, AS_OF).select("customer_id", "recent_usage", "prior_usage")
    literal = recent.join(trend, "customer_id", "left")
    same_rows(merged.select(*literal.columns), literal)


def test_bounded_trends_equal_full_windows(fx):
    """The trend pivot equals the full windows' rows 1, 2 and 5 joined."""
    _, act = fx
    full = windows.weekly_window_metrics(act, AS_OF)

    def row(n, **names):
        return full.where(f"weeks_ago = {n}").selectExpr(
            "customer_id", *(f"{source} AS {name}" for name, source in names.items()))

    first = row(1, current_logins="logins_count", current_usage="feature_usage_score",
                current_4wk_avg_logins="rolling_4wk_logins", current_4wk_avg_usage="rolling_4wk_usage")
    second = row(2, prev_logins="logins_count", prev_usage="feature_usage_score")
    fifth = row(5, baseline_4wk_logins="rolling_4wk_logins", baseline_4wk_usage="rolling_4wk_usage")
    weeks = full.where("weeks_ago <= 8").groupBy("customer_id").count().withColumnRenamed(
        "count", "active_weeks_count")
    literal = (first.join(second, "customer_id", "left").join(fifth, "customer_id", "left")
               .join(weeks, "customer_id"))
    bounded = windows.recent_trends(act, AS_OF)
    same_rows(bounded.select(*literal.columns), literal)


def test_rolling_average_within_frame_bounds(fx):
    _, act = fx
    w = windows.weekly_window_metrics(act, AS_OF)
    frame = f"({windows.LATEST_FIRST} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"
    bounds = windows.trend_rows(act, AS_OF).selectExpr(
        "customer_id", "activity_date", f"MIN(logins_count) OVER {frame} AS lo",
        f"MAX(logins_count) OVER {frame} AS hi")
    bad = (w.join(bounds, ["customer_id", "activity_date"])
           .filter("rolling_4wk_logins < lo OR rolling_4wk_logins > hi OR "
                   "(prev_week_logins IS NULL AND rolling_4wk_logins != logins_count)"))
    assert bad.count() == 0


def test_scores_equal_signal_sums(fx):
    cust, act = fx
    scores = risk_scores(risk_signals(periods.churn_period_metrics(act, AS_OF)))
    assert scores.filter("churn_risk_score != LEAST(usage_decline_risk + support_burden_risk + "
                         "nps_decline_risk + login_decline_risk + inactivity_risk, 100)").count() == 0
    sig = expansion_signals(cust, act, AS_OF)
    assert sig.filter("plan_ceiling_signal < 0 OR adoption_signal < 0").count() == 0


def test_status_counts_partition_each_cohort(fx):
    cust, act = fx
    t = cohort_table(cust, act, AS_OF)
    assert t.filter("active_customers + at_risk_customers + churned_customers != cohort_size "
                    "OR starter_count + professional_count + enterprise_count != cohort_size"
                    ).count() == 0
    assert t.filter("revenue_retention_rate != 100.0 OR net_mrr_change != 0").count() == 0


@pytest.mark.parametrize("analysis", [customer_health, churn_risk, expansion_opportunities,
                                      usage_trends])
def test_top_list_is_subset_of_portfolio(fx, analysis):
    cust, act = fx
    top = analysis(cust, act, AS_OF)
    full = analysis(cust, act, AS_OF, limit=None)
    assert top.count() == min(100, full.count())
    assert top.exceptAll(full).count() == 0


def plain_windows(act):
    """The same columns by ordinary windows over whole customers."""
    frame = f"({windows.LATEST_FIRST} ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING)"
    order = f"({windows.LATEST_FIRST})"

    def mean(column):
        return (f"CAST(CAST(SUM({column}) OVER {frame} AS DECIMAL(38,12)) / COUNT({column}) OVER {frame}"
                " AS DECIMAL(18,6))")

    return windows.trend_rows(act, AS_OF).selectExpr(
        "customer_id", "activity_date", "activity_id", "logins_count", "feature_usage_score",
        "support_tickets_opened", "nps_score",
        f"lead(logins_count) OVER {order} AS prev_week_logins",
        f"lead(feature_usage_score) OVER {order} AS prev_week_usage",
        f"lag(logins_count) OVER {order} AS next_week_logins",
        f"lag(feature_usage_score) OVER {order} AS next_week_usage",
        f"{mean('logins_count')} AS rolling_4wk_logins", f"{mean('feature_usage_score')} AS rolling_4wk_usage",
        f"CAST(row_number() OVER {order} AS BIGINT) AS weeks_ago")


@pytest.mark.parametrize("block_rows", [4, 5, 4096])
def test_blocked_windows_equal_plain_windows(fx, block_rows):
    _, act = fx
    same_rows(windows.weekly_window_metrics(act, AS_OF, block_rows=block_rows), plain_windows(act))


def test_blocked_windows_split_a_hot_customer(spark):
    """One customer holding most rows gets exact numbers and frames, in bounded window partitions."""
    import datetime as dt

    from cspulse import schemas
    rows = [(i, 1, AS_OF - dt.timedelta(days=i % 80), i % 50, i % 100, 0, None) for i in range(3000)]
    rows += [(100000 + i, 2, AS_OF - dt.timedelta(days=7 * i), 10, 20, 0, 5) for i in range(6)]
    act = spark.createDataFrame(rows, schemas.ACTIVITY).repartition(7)
    blocked = windows.weekly_window_metrics(act, AS_OF, block_rows=64)
    same_rows(blocked, plain_windows(act))
    assert blocked.filter("customer_id = 1").agg({"weeks_ago": "max"}).first()[0] == 3000
    text = blocked._jdf.queryExecution().optimizedPlan().toString()
    window_keys = [line for line in text.splitlines() if "Window [" in line]
    assert window_keys and not any("[customer_id#" in line.split("],")[-2] and
                                   "_block" not in line and "activity_date" not in line
                                   for line in window_keys)


def test_percentiles_equal_a_sorted_list(fx):
    from cspulse.plans import percentile_metrics
    cust, act = fx
    got = {r.plan_type: r for r in percentile_metrics(cust, act).collect()}
    rows = act.join(cust, "customer_id").select("plan_type", "feature_usage_score").collect()
    for plan in {r.plan_type for r in rows}:
        scores = sorted(r.feature_usage_score for r in rows if r.plan_type == plan)
        assert got[plan].activity_rows == len(scores)
        for p in (25, 50, 75, 90):
            assert got[plan][f"p{p}_usage"] == scores[-(-len(scores) * p // 100) - 1]


def test_portfolio_report_equals_standalone_analyses(fx):
    from cspulse.plans import portfolio_report
    cust, act = fx
    reports = portfolio_report(cust, act, AS_OF, limit=None, include_trends=False,
                               include_cohorts=False)
    same_rows(reports["customer_health"], customer_health(cust, act, AS_OF, limit=None))
    same_rows(reports["churn_risk"], churn_risk(cust, act, AS_OF, limit=None))
    same_rows(reports["expansion_opportunities"],
              expansion_opportunities(cust, act, AS_OF, limit=None))


def test_sql_views_answer_follow_up_queries(spark, fx):
    from cspulse.plans import churn_risk_rollup, register_views
    cust, act = fx
    names = register_views(spark, cust, act, AS_OF, prefix="v_")
    assert "v_churn_risk" in names and "v_customer_segments" in names
    via_sql = spark.sql("""
        SELECT risk_category, COUNT(*) AS customer_count,
               SUM(monthly_revenue_at_risk) AS total_mrr_at_risk
        FROM v_churn_risk GROUP BY risk_category""")
    via_api = churn_risk_rollup(churn_risk(cust, act, AS_OF)).drop("avg_risk_score")
    same_rows(via_sql, via_api)
    assert spark.sql("SELECT COUNT(*) FROM v_customer_health").first()[0] == 100
