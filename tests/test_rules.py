"""Every rule ladder: each branch, both sides of each cut point, and NULL."""

from decimal import Decimal

import pytest

from cspulse.functions import rules


def evaluate(spark, expr, values, sql_type="DECIMAL(18,6)"):
    """Evaluate a one-argument rule on a list of inputs (one Spark job)."""
    conv = int if sql_type in ("INT", "BIGINT") else (lambda v: Decimal(str(v)))
    data = [(i, None if v is None else conv(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(data, f"i INT, x {sql_type}")
    out = df.selectExpr("i", f"{expr} AS y").orderBy("i").collect()
    return [r["y"] for r in out]


def test_support_health(spark):
    got = evaluate(spark, rules.support_health("x"), [0, 1, 2, 3, 4, 9, None], "BIGINT")
    assert got == [100, 85, 70, 50, 30, 30, 100]


def test_engagement_health_logins_and_nps(spark):
    df = spark.createDataFrame(
        [(1, Decimal("40"), Decimal("9")), (2, Decimal("39.999999"), Decimal("8.999999")),
         (3, Decimal("30"), Decimal("7")), (4, Decimal("20"), Decimal("5")),
         (5, Decimal("10"), Decimal("4.999999")), (6, Decimal("9.999999"), None),
         (7, None, None)],
        "i INT, logins DECIMAL(18,6), nps DECIMAL(18,6)")
    got = [r.y for r in df.selectExpr("i", f"{rules.engagement_health('logins', 'nps')} AS y")
           .orderBy("i").collect()]
    assert got == [100, 80, 80, 60, 30, 20, 20]


def test_grades_and_actions_on_rounded_score(spark):
    scores = [80, 79.9, 60, 59.9, 40, 39.9, 20, 19.9, 0]
    grades = evaluate(spark, rules.at_least("x", rules.HEALTH_GRADES), scores)
    assert grades == ["A - Healthy", "B - Good", "B - Good", "C - At Risk", "C - At Risk",
                      "D - High Risk", "D - High Risk", "F - Critical", "F - Critical"]
    actions = evaluate(spark, rules.at_least("x", rules.HEALTH_ACTIONS), [80, 60, 40, 39.9, 0])
    assert actions[0].startswith("Upsell") and actions[1].startswith("Check-in")
    assert actions[2].startswith("Intervention") and actions[3] == actions[4]


def test_weighted_health_rounds_half_up(spark):
    df = spark.createDataFrame([(Decimal("53.625"), 100, 95)],
                               "u DECIMAL(18,6), s INT, e INT")
    got = df.selectExpr(f"{rules.weighted_health('u', 's', 'e')} AS y").first().y
    assert got == Decimal("80.0")  # 21.45 + 30 + 28.5 = 79.95 -> 80.0


@pytest.mark.parametrize("cur,prior,expected", [
    (49.999999, 100, 25), (50, 100, 15), (69.999999, 100, 15), (70, 100, 0),
    (39.999999, None, 10), (40, None, 0), (None, 100, 0), (30, 100, 25),
])
def test_usage_decline(spark, cur, prior, expected):
    df = spark.createDataFrame(
        [(None if cur is None else Decimal(str(cur)), None if prior is None else Decimal(str(prior)))],
        "c DECIMAL(18,6), p DECIMAL(18,6)")
    assert df.selectExpr(f"{rules.usage_decline_risk('c', 'p')} AS y").first().y == expected


def test_support_burden(spark):
    assert evaluate(spark, rules.support_burden_risk("x"), [5, 4, 3, 2, 1, 0, None], "BIGINT") == \
        [25, 25, 15, 5, 0, 0, 0]


def test_nps_decline(spark):
    df = spark.createDataFrame(
        [(1, Decimal("4.9"), None), (2, Decimal("5"), None), (3, Decimal("6.9"), Decimal("9")),
         (4, Decimal("7"), Decimal("9.1")), (5, Decimal("7"), Decimal("9")), (6, None, Decimal("9")),
         (7, Decimal("8"), None)],
        "i INT, c DECIMAL(18,6), p DECIMAL(18,6)")
    got = [r.y for r in df.selectExpr("i", f"{rules.nps_decline_risk('c', 'p')} AS y")
           .orderBy("i").collect()]
    assert got == [20, 10, 10, 15, 0, 0, 0]


def test_login_decline(spark):
    df = spark.createDataFrame(
        [(1, Decimal("9.9"), None), (2, Decimal("10"), None), (3, Decimal("19.9"), None),
         (4, Decimal("20"), Decimal("34")), (5, Decimal("20"), Decimal("33.333334")),
         (6, Decimal("20"), Decimal("33.333333")), (7, None, Decimal("50"))],
        "i INT, c DECIMAL(18,6), p DECIMAL(18,6)")
    got = [r.y for r in df.selectExpr("i", f"{rules.login_decline_risk('c', 'p')} AS y")
           .orderBy("i").collect()]
    assert got == [20, 10, 10, 10, 10, 0, 0]


def test_inactivity_and_cap(spark):
    assert evaluate(spark, rules.inactivity_risk("x"), [1, 2, 0], "BIGINT") == [15, 0, 15]
    df = spark.createDataFrame([(25, 25, 20, 20, 15), (5, 0, 0, 0, 0)], "a INT, b INT, c INT, d INT, e INT")
    got = [r.y for r in df.selectExpr(f"{rules.capped_sum(list('abcde'))} AS y").collect()]
    assert got == [100, 5]


def test_plan_ceiling_adoption_growth_satisfaction_mastery(spark):
    df = spark.createDataFrame(
        [(1, "Starter", Decimal("80")), (2, "Starter", Decimal("79.9")),
         (3, "Starter", Decimal("59.9")), (4, "Professional", Decimal("90")),
         (5, "Professional", Decimal("75")), (6, "Professional", Decimal("74.9")),
         (7, "Enterprise", Decimal("99")), (8, "Trial", Decimal("88"))],
        "i INT, plan STRING, u DECIMAL(18,6)")
    got = [r.y for r in df.selectExpr("i", f"{rules.plan_ceiling_signal('plan', 'u')} AS y")
           .orderBy("i").collect()]
    assert got == [30, 20, 0, 25, 15, 0, 0, 0]
    assert evaluate(spark, rules.at_least("x", rules.ADOPTION), [85, 84.9, 70, 69.9, None]) == \
        [25, 15, 15, 0, 0]
    assert evaluate(spark, rules.at_least("x", rules.SATISFACTION), [9, 8, 7.5, 7, 6.9, None]) == \
        [15, 10, 5, 5, 0, 0]
    g = spark.createDataFrame(
        [(1, Decimal("131"), Decimal("100")), (2, Decimal("130"), Decimal("100")),
         (3, Decimal("115.000001"), Decimal("100")), (4, Decimal("115"), Decimal("100")),
         (5, Decimal("200"), None), (6, Decimal("1"), Decimal("0"))],
        "i INT, r DECIMAL(18,6), p DECIMAL(18,6)")
    got = [r.y for r in g.selectExpr("i", f"{rules.growth_signal('r', 'p')} AS y")
           .orderBy("i").collect()]
    assert got == [20, 10, 10, 0, 0, 20]
    m = spark.createDataFrame(
        [(1, 0, Decimal("60.1")), (2, 1, Decimal("61")), (3, 0, Decimal("60")),
         (4, 2, Decimal("90")), (5, None, Decimal("90"))],
        "i INT, t BIGINT, u DECIMAL(18,6)")
    got = [r.y for r in m.selectExpr("i", f"{rules.mastery_signal('t', 'u')} AS y")
           .orderBy("i").collect()]
    assert got == [10, 5, 0, 0, 0]


def test_expansion_opportunity_and_mrr(spark):
    df = spark.createDataFrame(
        [(1, "Starter", 20, 0, 0, Decimal("50")), (2, "Professional", 15, 0, 0, Decimal("250")),
         (3, "Starter", 0, 25, 0, Decimal("50")), (4, "Starter", 0, 15, 20, Decimal("50")),
         (5, "Trial", 0, 25, 0, Decimal("100")), (6, "Starter", 0, 0, 10, Decimal("50"))],
        "i INT, plan STRING, c INT, a INT, g INT, mrr DECIMAL(10,2)")
    out = df.selectExpr("i", f"{rules.expansion_opportunity('plan', 'c', 'a', 'g')} AS o",
                        f"{rules.estimated_expansion_mrr('plan', 'mrr')} AS m").orderBy("i").collect()
    assert [r.o for r in out] == ["Upgrade to Professional", "Upgrade to Enterprise",
                                  "Add-on features/modules", "Seat expansion",
                                  "Add-on features/modules", "General expansion conversation"]
    assert [float(r.m) for r in out] == [150.0, 700.0, 150.0, 150.0, 30.0, 150.0]


def test_trend_points_null_is_worst(spark):
    vals = [20.1, 20, 10.1, 10, 0.1, 0, -9.9, -10, -19.9, -20, None]
    assert evaluate(spark, rules.trend_points("x", rules.USAGE_TREND_POINTS), vals) == \
        [30, 20, 20, 10, 10, 0, 0, -10, -10, -20, -20]
    assert evaluate(spark, rules.trend_points("x", rules.LOGIN_TREND_POINTS), vals) == \
        [20, 10, 10, 5, 5, 0, 0, -10, -10, -15, -15]


def test_consistency_categories_and_lifecycle(spark):
    assert evaluate(spark, rules.at_least("x", rules.CONSISTENCY_POINTS), [8, 7, 6, 5, 4, 3, 2, 0],
                    "BIGINT") == [10, 10, 5, 5, 0, 0, -10, -10]
    cats = evaluate(spark, rules.at_least("x", rules.TREND_CATEGORIES), [30, 29, 10, 9, -10, -11, -30, -31],
                    "INT")
    assert cats == ["Strong Growth", "Improving", "Improving", "Stable", "Stable", "Declining",
                    "Declining", "Sharp Decline"]
    stages = evaluate(spark, rules.lifecycle_stage("x"), [0, 3, 4, 6, 7, 12, 13, -2], "INT")
    assert [s.split(" ")[0] for s in stages] == ["Onboarding", "Onboarding", "Early", "Early",
                                                "Maturing", "Maturing", "Established", "Onboarding"]
    health = evaluate(spark, rules.at_least("x", rules.COHORT_HEALTH), [110, 109.999999, 90, 70, 69.9, None])
    assert health == ["Expanding", "Healthy", "Healthy", "Declining", "At Risk", "At Risk"]


def test_flags_keep_exact_code_points(spark):
    df = spark.createDataFrame([(1,), (0,)], "s INT")
    got = [r.f for r in df.selectExpr(f"{rules.flag('s', rules.CHURN_FLAGS[0])} AS f").collect()]
    assert got == ["⚠ Usage Declining", None]
    got = df.selectExpr(f"{rules.flag('s', rules.EXPANSION_FLAGS[1])} AS f").first().f
    assert got == "✓ Power user"
