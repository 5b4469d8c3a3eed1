"""Hand-written fixtures for the edge cases of each analysis (FIXTURES.md section 3)."""

import datetime as dt
from decimal import Decimal

from conftest import AS_OF, activity, customer, rows_by_id, weeks_ago

from cspulse import schemas
from cspulse.functions.dates import age_month_part, age_total_months
from cspulse.plans import (churn_risk, cohort_retention, cohort_table, customer_health,
                           expansion_opportunities, usage_trends)
from cspulse.plans.health import health_dimensions
from cspulse.operators.periods import recent_activity


def test_health_null_nps_null_tickets_and_grade_edge(spark, tables):
    cust = [customer(1), customer(2), customer(3, mrr="70.00")]
    rows = []
    for k in range(1, 5):  # four weekly rows inside 30 days, NPS never answered
        rows.append(activity(1, weeks_ago(k), logins=40, usage=80, tickets=0, nps=None))
        rows.append(activity(2, weeks_ago(k), logins=20, usage=50, tickets=None, nps=None))
    # eight rows with usage summing to 429 -> 53.625; 0 tickets; logins 40; nps 8
    for i, u in enumerate([53, 53, 54, 54, 54, 54, 54, 53]):
        rows.append(activity(3, dt.date(2024, 7, 1) + dt.timedelta(days=i), logins=40, usage=u,
                             tickets=0, nps=8))
    c, a = tables(cust, rows)
    out = rows_by_id(customer_health(c, a, AS_OF))
    assert out[1]["engagement_health_score"] == Decimal("90.0")     # 90 + 0 for NULL NPS
    assert out[1]["overall_health_score"] == Decimal("89.0")
    assert out[1]["avg_nps_score"] is None
    assert out[2]["support_health_score"] == Decimal("100.0")       # NULL tickets -> ELSE
    assert out[2]["tickets_last_30d"] is None
    assert out[3]["overall_health_score"] == Decimal("80.0")        # 79.95 rounds up
    assert out[3]["health_grade"] == "A - Healthy"


def test_health_includes_rows_on_and_after_as_of(spark, tables):
    c, a = tables([customer(1)], [activity(1, AS_OF, usage=10), activity(1, weeks_ago(-1), usage=30)])
    r = recent_activity(a, AS_OF).first()
    assert r.weeks_with_activity == 2 and r.avg_usage_score == Decimal("20.000000")
    assert churn_risk(c, a, AS_OF).count() == 0                       # excluded from churn


def test_churn_periods_cap_and_inactivity(spark, tables):
    cust = [customer(i, status="Active") for i in range(1, 5)]
    rows = []
    # 1: no prior period, low usage -> only the floor branch of usage decline
    rows += [activity(1, weeks_ago(k), usage=30, logins=25) for k in (1, 2, 3)]
    # 2: only prior-period rows -> absent
    rows += [activity(2, weeks_ago(k), usage=30) for k in (5, 6)]
    # 3: every signal at its maximum: 25 + 25 + 20 + 20 + 15 = 105 -> 100
    rows += [activity(3, weeks_ago(k), usage=90, logins=50, nps=9) for k in (5, 6, 7, 8)]
    rows += [activity(3, weeks_ago(1), usage=10, logins=5, tickets=4, nps=2)]
    # 4: exactly one current row, otherwise healthy
    rows += [activity(4, weeks_ago(2), usage=80, logins=45, nps=9)]
    c, a = tables(cust, rows)
    out = rows_by_id(churn_risk(c, a, AS_OF, limit=None))
    assert 2 not in out
    assert out[1]["prior_usage"] is None and out[1]["usage_flag"] == "⚠ Usage Declining"
    assert out[1]["churn_risk_score"] == 10
    assert out[3]["churn_risk_score"] == 100 and out[3]["risk_category"] == "Critical Risk"
    assert out[4]["churn_risk_score"] == 15 and out[4]["activity_flag"] == "⚠ Low Activity"
    assert out[4]["annual_revenue_at_risk"] == Decimal("600.00")


def test_churn_ties_are_broken_by_customer_id(spark, tables):
    cust = [customer(7, mrr="60.00"), customer(3, mrr="60.00"), customer(5, mrr="70.00")]
    rows = [activity(i, weeks_ago(1), usage=80, logins=45, nps=9) for i in (7, 3, 5)]
    c, a = tables(cust, rows)
    assert [r.customer_id for r in churn_risk(c, a, AS_OF, limit=2).collect()] == [5, 3]


def test_expansion_unknown_plan_and_zero_prior_usage(spark, tables):
    cust = [customer(1, plan="Trial", mrr="100.00"), customer(2, plan="Starter"),
            customer(3, plan="Enterprise")]
    rows = [activity(1, weeks_ago(k), usage=88, tickets=1, nps=None) for k in (1, 2)]
    rows += [activity(2, weeks_ago(6), usage=0), activity(2, weeks_ago(1), usage=80)]
    rows += [activity(3, weeks_ago(1), usage=99)]
    c, a = tables(cust, rows)
    out = rows_by_id(expansion_opportunities(c, a, AS_OF, limit=None))
    assert 3 not in out                                             # Enterprise excluded
    assert out[1]["expansion_opportunity"] == "Add-on features/modules"
    assert out[1]["estimated_expansion_mrr"] == Decimal("30.0000")
    assert out[2]["usage_growth_pct"] is None                      # prior usage 0: NULL
    assert out[2]["growth_flag"] == "✓ Growing fast"
    assert out[2]["expansion_opportunity"] == "Upgrade to Professional"


def test_trends_short_history_and_gap_weeks(spark, tables):
    cust = [customer(1), customer(2)]
    rows = [activity(1, weeks_ago(k), usage=60, logins=30) for k in (1, 2, 3)]
    # customer 2: weekly rows with week 4 missing; row-based frames skip it
    usage = {1: 90, 2: 90, 3: 90, 5: 60, 6: 60, 7: 60, 8: 60, 9: 60}
    rows += [activity(2, weeks_ago(k), usage=u, logins=40) for k, u in usage.items()]
    c, a = tables(cust, rows)
    out = rows_by_id(usage_trends(c, a, AS_OF, limit=None))
    assert out[1]["usage_trend_4wk"] is None and out[1]["overall_trend_score"] == -35
    assert out[1]["trend_category"] == "Sharp Decline"
    assert out[1]["engagement_consistency"] == "Sporadic"
    # rows 1-4 = weeks 1,2,3,5 -> (90*3+60)/4 = 82.5 ; rows 5-8 = weeks 6..9 -> 60
    assert out[2]["four_week_avg_usage"] == Decimal("82.5")
    assert out[2]["usage_trend_4wk"] == Decimal("37.5")
    assert out[2]["active_weeks_last_8"] == 8


def test_cohort_min_size_no_active_and_ages(spark, tables):
    cust = [customer(i, signup=dt.date(2024, 1, 5 + i)) for i in range(4)]            # Jan: 4
    cust += [customer(10 + i, signup=dt.date(2024, 2, 1 + i)) for i in range(5)]       # Feb: 5
    cust += [customer(20 + i, status="Churned", signup=dt.date(2024, 3, 3)) for i in range(5)]
    c, a = tables(cust, [activity(10, weeks_ago(1), logins=30, usage=70, nps=8)])
    out = {r.cohort_month: r.asDict() for r in cohort_retention(c, a, AS_OF).collect()}
    assert set(out) == {dt.date(2024, 2, 1), dt.date(2024, 3, 1)}
    march = out[dt.date(2024, 3, 1)]
    assert march["avg_current_mrr_per_active_customer"] is None
    assert march["avg_weekly_logins"] is None and march["churn_rate"] == Decimal("100.0")
    feb = out[dt.date(2024, 2, 1)]
    assert feb["avg_weekly_logins"] == Decimal("30.0") and feb["cohort_age_months"] == 5
    assert feb["revenue_retention_rate"] == Decimal("100.0") and feb["cohort_health"] == "Healthy"


def test_cohort_baseline_makes_upgrades_visible(spark, tables):
    cust = [customer(i, plan="Professional", mrr="120.00", signup=dt.date(2024, 2, 10))
            for i in range(5)]
    c, a = tables(cust, [])
    base = spark.createDataFrame([(i, "Starter", Decimal("100.00")) for i in range(5)],
                                 schemas.BASELINE)
    r = cohort_table(c, a, AS_OF, baseline=base).first()
    assert r.starter_to_pro_upgrades == 5 and r.upgrade_rate == Decimal("100.0")
    assert r.revenue_retention_rate == Decimal("120.0") and r.cohort_health == "Expanding"
    assert r.net_mrr_change == Decimal("100.00") and r.starter_count == 5


def test_age_month_field(spark):
    pairs = [(dt.date(2024, 2, 29), dt.date(2024, 1, 31), 0, 0),
             (dt.date(2024, 4, 30), dt.date(2024, 3, 31), 0, 0),
             (dt.date(2024, 1, 1), dt.date(2024, 3, 15), -2, -2),
             (dt.date(2024, 7, 29), dt.date(2024, 7, 1), 0, 0),
             (dt.date(2024, 7, 29), dt.date(2023, 8, 1), 11, 11),
             (dt.date(2024, 7, 29), dt.date(2023, 7, 1), 0, 12),
             (dt.date(2024, 7, 29), dt.date(2023, 5, 1), 2, 14)]
    df = spark.createDataFrame([(a, b) for a, b, _, _ in pairs], "a DATE, b DATE")
    got = df.selectExpr(f"{age_month_part('a', 'b')} AS m", f"{age_total_months('a', 'b')} AS t") \
        .collect()
    assert [(r.m, r.t) for r in got] == [(m, t) for _, _, m, t in pairs]


def test_health_dimensions_keep_raw_metrics(spark, tables):
    c, a = tables([customer(1)], [activity(1, weeks_ago(1), logins=33, usage=71, tickets=3, nps=6)])
    r = health_dimensions(recent_activity(a, AS_OF)).first()
    assert (r.support_health, r.engagement_health, r.usage_health) == (50, 75, Decimal("71.000000"))


def test_churn_include_silent_flags_inactivity(spark, tables):
    c, a = tables([customer(1), customer(2), customer(3, status="Churned")],
                  [activity(1, weeks_ago(1), usage=80, logins=45, nps=9)])
    default = rows_by_id(churn_risk(c, a, AS_OF, limit=None))
    assert set(default) == {1}
    silent = rows_by_id(churn_risk(c, a, AS_OF, limit=None, include_silent=True))
    assert set(silent) == {1, 2}
    assert silent[2]["activity_flag"] == "⚠ Low Activity" and silent[2]["churn_risk_score"] == 15


def test_cohort_total_months_and_approximate_curve(spark, tables):
    cust = [customer(i, signup=dt.date(2023, 5, 10)) for i in range(5)]
    rows = [activity(i, weeks_ago(1)) for i in range(5)]
    c, a = tables(cust, rows)
    field = cohort_retention(c, a, AS_OF).first()
    total = cohort_retention(c, a, AS_OF, total_months=True).first()
    assert field.cohort_age_months == 2 and total.cohort_age_months == 14
    assert total.lifecycle_stage.startswith("Established")
    from cspulse.plans import cohort_retention_curve
    exact = [tuple(r) for r in cohort_retention_curve(c, a).collect()]
    approx = [tuple(r) for r in cohort_retention_curve(c, a, approximate=True).collect()]
    assert exact == approx == [(dt.date(2023, 5, 1), 2, 5)]


def test_null_nps_adds_nothing_anywhere(spark, tables):
    cust = [customer(1), customer(2, plan="Starter")]
    # 1: low usage, so churn has a score (> 0) and shows up; 2: expansion candidate
    rows = [activity(i, weeks_ago(k), usage=u, logins=30, tickets=0, nps=None)
            for i, u in ((1, 30), (2, 75)) for k in (1, 2, 5, 6)]
    c, a = tables(cust, rows)
    churn = rows_by_id(churn_risk(c, a, AS_OF, limit=None))
    assert churn[1]["churn_risk_score"] == 10                 # usage floor only, NPS adds 0
    assert churn[1]["nps_flag"] is None and churn[1]["current_nps"] is None
    exp = rows_by_id(expansion_opportunities(c, a, AS_OF, limit=None))
    assert exp[2]["satisfaction_flag"] is None and exp[2]["nps_score"] is None
    assert exp[2]["expansion_score"] == 20 + 15 + 10          # ceiling + adoption + mastery


def test_age_formula_matches_duckdb_on_random_pairs(spark):
    """Month field and total months of AGE(a, b) for 3,000 seeded random date pairs."""
    import random

    import duckdb

    rng = random.Random(7)
    days = [dt.date(1990, 1, 1) + dt.timedelta(days=rng.randrange(0, 18_000)) for _ in range(2_400)]
    month_ends = [dt.date(y, m, 1) - dt.timedelta(days=1) for y in (2023, 2024, 2025)
                  for m in range(1, 13)]
    days += month_ends * 16 + [dt.date(2024, 2, 29)] * 24
    pairs = [(rng.choice(days), rng.choice(days)) for _ in range(3_000)]
    df = spark.createDataFrame(pairs, "a DATE, b DATE")
    got = sorted(tuple(r) for r in df.selectExpr(
        "a", "b", f"{age_month_part('a', 'b')} AS m", f"{age_total_months('a', 'b')} AS t").collect())
    con = duckdb.connect()
    con.execute("CREATE TABLE p (a DATE, b DATE)")
    con.executemany("INSERT INTO p VALUES (?, ?)", pairs)
    want = sorted(con.execute(
        "SELECT a, b, CAST(date_part('month', age(a::TIMESTAMP, b::TIMESTAMP)) AS INTEGER), "
        "CAST(date_part('year', age(a::TIMESTAMP, b::TIMESTAMP)) * 12 "
        "+ date_part('month', age(a::TIMESTAMP, b::TIMESTAMP)) AS INTEGER) FROM p").fetchall())
    assert got == want


def test_segment_ladder_branches_and_precedence(spark):
    from cspulse.plans import segment_customers
    rows = [  # (id, trend_category, active weeks, four_week_avg_usage, spread, missing weeks) -> expected segment
        (1, "Strong Growth", 7, "50.0", "0.359999", 2, "ACCELERATING"),
        (2, "Strong Growth", 6, "80.0", "0.1", 0, "STABLE POWER USERS"),
        (3, "Sharp Decline", 4, "90.0", "0.1", 0, "ABANDONING"),
        (4, "Sharp Decline", 8, "90.0", "0.1", 0, "DECLINING"),
        (5, "Declining", 8, "75.0", "0.9", 5, "DECLINING"),
        (6, "Stable", 4, "95.0", "0.1", 0, "VOLATILE"),
        (7, "Stable", 8, "70.0", "0.1", 0, "STABLE POWER USERS"),
        (8, "Improving", 8, "69.9", "0.36", 0, "VOLATILE"),
        (9, "Stable", 8, None, "0.1", 0, None),
        (10, "Stable", 8, "69.9", "0.1", 0, None),       # steady, below the usage bar: none of the five
        (11, "Stable", 7, "90.0", "0.1", 3, "VOLATILE"),
        (12, "Sharp Decline", 8, "90.0", "0.5", 0, "ABANDONING"),
        (13, "Stable", 8, "80.0", None, None, "STABLE POWER USERS"),
    ]
    df = spark.createDataFrame(
        [(r[0], f"Co{r[0]}", Decimal("10.00"), 0, r[1], "x", None if r[3] is None else Decimal(r[3]), r[2])
         for r in rows],
        "customer_id INT, company_name STRING, mrr DECIMAL(10,2), overall_trend_score INT, "
        "trend_category STRING, engagement_consistency STRING, four_week_avg_usage DECIMAL(20,1), "
        "active_weeks_last_8 BIGINT")
    even = spark.createDataFrame([(r[0], None if r[4] is None else Decimal(r[4]), r[5]) for r in rows],
                                 "customer_id INT, usage_spread DECIMAL(18,6), missing_weeks BIGINT")
    got = {r.customer_id: r.segment for r in segment_customers(df, even).collect()}
    assert got == {r[0]: r[-1] for r in rows}


def test_consistency_measures(spark, tables):
    from cspulse.operators.consistency import (consistency_measures, consistency_partials, engagement_consistency,
                                               merge_partials)
    scores = {1: [50] * 8, 2: [0, 100] * 4, 3: [0] * 5, 4: [None] * 3, 5: [10, 30]}
    rows = [activity(c, weeks_ago(k + 1 + (3 if c == 5 and k else 0)), usage=u)
            for c, all_ in scores.items() for k, u in enumerate(all_)]
    rows.append(activity(1, weeks_ago(9), usage=0))  # the ninth latest row does not count
    _, act = tables([customer(1)], rows)
    got = rows_by_id(engagement_consistency(act, AS_OF))
    assert {c: (None if r["usage_spread"] is None else float(r["usage_spread"]), r["missing_weeks"])
            for c, r in got.items()} == {1: (0.0, 0), 2: (1.0, 0), 3: (0.0, 0), 4: (None, 0), 5: (0.25, 3)}
    # Parts of a customer's rows, reduced apart and merged, give the same.
    parts = [consistency_partials(act.where(f"activity_id % 3 = {i}")) for i in range(3)]
    merged = consistency_measures(merge_partials(parts[0].unionByName(parts[1]).unionByName(parts[2])))
    whole = consistency_measures(consistency_partials(act))
    assert merged.exceptAll(whole).count() == 0 and whole.exceptAll(merged).count() == 0


def test_volatile_customers_are_the_uneven_ones(spark):
    from cspulse import catalog
    rows = catalog.queries()["segment_customers"](spark, "/root/testdata/sf0.1").collect()
    steady = [r for r in rows if r.active_weeks_last_8 >= 7 and r.usage_spread < 0.36 and r.missing_weeks < 3]
    assert steady and all(r.segment != "VOLATILE" for r in steady)
    assert {"ACCELERATING", "VOLATILE", "DECLINING", "STABLE POWER USERS"} <= {r.segment for r in rows}


def test_null_groups_keep_their_engagement(tables):
    """Customers without industry are a group of their own, apart from the empty text."""
    from cspulse.plans import cohort_table
    cust, act = tables([customer(1, industry=None), customer(2, industry=""), customer(3, industry="SaaS")],
                       [activity(i, weeks_ago(1), logins=10 * i) for i in (1, 2, 3)])
    rows = cohort_table(cust, act, AS_OF, by=["industry"]).collect()
    assert {r.industry: float(r.avg_weekly_logins) for r in rows} == {None: 10.0, "": 20.0, "SaaS": 30.0}
