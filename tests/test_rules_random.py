"""Randomized check of the scoring ladders against plain-Python versions of the rule tables.

arithmetic, NULL as None with SQL three-valued comparisons); every ladder is evaluated by
Spark on 2,000 seeded random rows with values on and around the cut points.
"""

import random
from decimal import Decimal

import pytest

from cspulse.functions import rules as R


def lt(a, b):
    return a is not None and b is not None and a < b


def ge(a, b):
    return a is not None and b is not None and a >= b


def gt(a, b):
    return a is not None and b is not None and a > b


def support_health(t):
    return {0: 100, 1: 85, 2: 70, 3: 50}.get(t, 30 if ge(t, 4) else 100)


def engagement(logins, nps):
    base = next((v for cut, v in ((40, 90), (30, 75), (20, 60), (10, 40)) if ge(logins, cut)), 20)
    bonus = next((v for cut, v in ((9, 10), (7, 5), (5, 0)) if ge(nps, cut)), None)
    if bonus is None:
        bonus = -10 if lt(nps, 5) else 0
    return base + bonus


def usage_decline(cur, prior):
    if prior is not None and lt(cur, prior * Decimal("0.5")):
        return 25
    if prior is not None and lt(cur, prior * Decimal("0.7")):
        return 15
    return 10 if lt(cur, 40) else 0


def nps_decline(cur, prior):
    if lt(cur, 5):
        return 20
    if lt(cur, 7):
        return 10
    return 15 if prior is not None and lt(cur, prior - 2) else 0


def login_decline(cur, prior):
    if lt(cur, 10):
        return 20
    if lt(cur, 20):
        return 10
    return 10 if prior is not None and lt(cur, prior * Decimal("0.6")) else 0


def growth(recent, prior):
    if prior is not None and gt(recent, prior * Decimal("1.3")):
        return 20
    return 10 if prior is not None and gt(recent, prior * Decimal("1.15")) else 0


def usage_trend(pct):
    return next((v for cut, v in ((20, 30), (10, 20), (0, 10), (-10, 0), (-20, -10))
                 if gt(pct, cut)), -20)


CUTS = [0, 2, 5, 7, 9, 10, 20, 30, 40, 60, 70, 75, 80, 85, 90, 100]


def value(rng, signed=False):
    if rng.random() < 0.1:
        return None
    if rng.random() < 0.5:
        base = Decimal(rng.choice(CUTS)) * (rng.choice([-1, 1]) if signed else 1)
        return base + Decimal(rng.choice([-1, 0, 0, 1])) / Decimal(1_000_000)
    low = -40 if signed else 0
    return Decimal(rng.randint(low * 1_000_000, 110_000_000)) / Decimal(1_000_000)


CASES = {
    "engagement": (lambda a, b: R.engagement_health(a, b), engagement, False),
    "usage_decline": (R.usage_decline_risk, usage_decline, False),
    "nps_decline": (R.nps_decline_risk, nps_decline, False),
    "login_decline": (R.login_decline_risk, login_decline, False),
    "growth": (R.growth_signal, growth, False),
    "usage_trend": (lambda a, b: R.trend_points(a, R.USAGE_TREND_POINTS),
                    lambda a, b: usage_trend(a), True),
}


@pytest.mark.parametrize("name", sorted(CASES))
def test_ladder_matches_rule_table(spark, name):
    build, expected, signed = CASES[name]
    rng = random.Random(sum(map(ord, name)))  # deterministic per rule
    rows = [(i, value(rng, signed), value(rng)) for i in range(2_000)]
    df = spark.createDataFrame(rows, "i INT, a DECIMAL(18,6), b DECIMAL(18,6)")
    got = {r.i: r.y for r in df.selectExpr("i", f"{build('a', 'b')} AS y").collect()}
    bad = [(a, b, got[i], expected(a, b)) for i, a, b in rows if got[i] != expected(a, b)]
    assert not bad, bad[:5]


def test_support_health_matches_rule_table(spark):
    rows = [(i, t) for i, t in enumerate([None, *range(0, 12)] * 20)]
    df = spark.createDataFrame(rows, "i INT, t BIGINT")
    got = {r.i: r.y for r in df.selectExpr("i", f"{R.support_health('t')} AS y").collect()}
    assert all(got[i] == support_health(t) for i, t in rows)
