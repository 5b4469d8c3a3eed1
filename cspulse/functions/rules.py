"""Scoring rules as Spark SQL ``CASE`` expressions.

Every rule is an ordered ladder: the first true condition wins, and a NULL
condition falls through to the next step (so a NULL trend ends in the ELSE
branch).  Rule functions take SQL expressions (usually column names) and
return SQL text for ``selectExpr``.  Thresholds live in the tables below so
callers can pass their own; the defaults are the reference's values.
"""

from __future__ import annotations

from collections.abc import Sequence

from .sql import decimal, lit

# ---------------------------------------------------------------------------
# Thresholds, points and label texts that must equal the
# reference analyses for identical results.  Listed in the reference's order.
# ---------------------------------------------------------------------------

# Health scoring
SUPPORT_HEALTH = {"exact": [(0, 100), (1, 85), (2, 70), (3, 50)], "at_least": (4, 30), "else": 100}
LOGIN_ENGAGEMENT = {"steps": [(40, 90), (30, 75), (20, 60), (10, 40)], "else": 20}
NPS_ENGAGEMENT = {"steps": [(9, 10), (7, 5), (5, 0)], "below_last": -10, "else": 0}
HEALTH_WEIGHTS = {"usage": "0.40", "support": "0.30", "engagement": "0.30"}
HEALTH_GRADES = {"steps": [(80, "A - Healthy"), (60, "B - Good"), (40, "C - At Risk"),
                           (20, "D - High Risk")], "else": "F - Critical"}
HEALTH_ACTIONS = {"steps": [(80, "Upsell opportunity - customer thriving"),
                            (60, "Check-in - ensure continued success"),
                            (40, "Intervention needed - declining engagement")],
                  "else": "Urgent outreach - churn risk high"}

# Churn risk
USAGE_DECLINE = {"ratio_steps": [("0.5", 25), ("0.7", 15)], "floor": (40, 10), "else": 0}
SUPPORT_BURDEN = {"at_least": (4, 25), "exact": [(3, 15), (2, 5)], "else": 0}
NPS_DECLINE = {"below": [(5, 20), (7, 10)], "drop": (2, 15), "else": 0}
LOGIN_DECLINE = {"below": [(10, 20), (20, 10)], "ratio": ("0.6", 10), "else": 0}
INACTIVITY = {"below": (2, 15), "else": 0}
CHURN_CAP = 100
RISK_CATEGORIES = {"steps": [(60, "Critical Risk"), (40, "High Risk"), (20, "Medium Risk")],
                   "else": "Low Risk"}
CHURN_FLAGS = ["⚠ Usage Declining", "⚠ High Support Load", "⚠ NPS Concerns",
               "⚠ Login Decline", "⚠ Low Activity"]
CHURN_ACTIONS = {"steps": [(60, "URGENT: Executive escalation + immediate intervention"),
                           (40, "HIGH: Schedule check-in call this week"),
                           (20, "MEDIUM: Proactive email outreach")],
                 "else": "LOW: Monitor next cycle"}

# Expansion
PLAN_CEILING = {"Starter": [(80, 30), (60, 20)], "Professional": [(90, 25), (75, 15)], "else": 0}
ADOPTION = {"steps": [(85, 25), (70, 15)], "else": 0}
GROWTH = {"ratio_steps": [("1.3", 20), ("1.15", 10)], "else": 0}
SATISFACTION = {"steps": [(9, 15), (8, 10), (7, 5)], "else": 0}
MASTERY = {"usage_above": 60, "tickets": [(0, 10), (1, 5)], "else": 0}
EXPANSION_READINESS = {"steps": [(60, "Hot - Ready Now"), (40, "Warm - Qualified"),
                                 (20, "Developing - Monitor")], "else": "Early - Nurture"}
EXPANSION_OPPORTUNITY = {"upgrade": [("Starter", 20, "Upgrade to Professional"),
                                     ("Professional", 15, "Upgrade to Enterprise")],
                         "adoption": (20, "Add-on features/modules"),
                         "growth": (15, "Seat expansion"),
                         "else": "General expansion conversation"}
EXPANSION_MRR = {"Starter": "150.0", "Professional": "700.0", "else_factor": "0.30"}
EXPANSION_FLAGS = ["✓ At plan limits", "✓ Power user", "✓ Growing fast", "✓ High NPS",
                   "✓ Product mastery"]
TALKING_POINTS = {"steps": [(60, "Customer is maxing out current plan. Strong adoption and "
                                 "satisfaction make this a low-risk upsell conversation."),
                            (40, "Usage patterns indicate readiness for expansion. Schedule "
                                 "value review to discuss growth needs.")],
                  "else": "Continue building value. Monitor for increased usage patterns."}

# Usage trends
USAGE_TREND_POINTS = {"above": [(20, 30), (10, 20), (0, 10), (-10, 0), (-20, -10)], "else": -20}
LOGIN_TREND_POINTS = {"above": [(20, 20), (10, 10), (0, 5), (-10, 0), (-20, -10)], "else": -15}
CONSISTENCY_POINTS = {"steps": [(7, 10), (5, 5), (3, 0)], "else": -10}
TREND_CATEGORIES = {"steps": [(30, "Strong Growth"), (10, "Improving"), (-10, "Stable"),
                              (-30, "Declining")], "else": "Sharp Decline"}
CONSISTENCY_LABELS = {"steps": [(7, "Highly Consistent"), (5, "Mostly Consistent"),
                                (3, "Sporadic")], "else": "Rare/Inactive"}
TREND_ACTIONS = {"steps": [(30, "Capitalize on momentum - explore expansion opportunities"),
                           (10, "Positive trajectory - reinforce good habits"),
                           (-10, "Monitor - ensure stability continues"),
                           (-30, "Intervention needed - schedule check-in")],
                 "else": "URGENT - immediate outreach required"}

# Cohorts
COHORT_HEALTH = {"steps": [(110, "Expanding"), (90, "Healthy"), (70, "Declining")],
                 "else": "At Risk"}
LIFECYCLE_STAGES = {"at_most": [(3, "Onboarding phase - critical retention period"),
                                (6, "Early adoption - building habits"),
                                (12, "Maturing - expansion opportunities")],
                    "else": "Established - retention and advocacy focus"}
PLANS = ["Starter", "Professional", "Enterprise"]
STATUSES = ["Active", "At Risk", "Churned"]

# ---------------------------------------------------------------------------
# Generic ladder
# ---------------------------------------------------------------------------


def _value(v) -> str:
    return v.sql if isinstance(v, Raw) else lit(v)


class Raw:
    """An SQL expression used as a ladder value (instead of a literal)."""

    def __init__(self, sql: str):
        self.sql = sql


def ladder(steps: Sequence[tuple[str, object]], default=None) -> str:
    """Searched CASE: ``steps`` are ``(condition_sql, value)`` tried in order."""
    whens = " ".join(f"WHEN {cond} THEN {_value(v)}" for cond, v in steps)
    tail = f" ELSE {_value(default)}" if default is not None else ""
    return f"CASE {whens}{tail} END"


def at_least(x: str, table: dict) -> str:
    """x >= t1 -> v1, x >= t2 -> v2, ..., else."""
    return ladder([(f"{x} >= {t}", v) for t, v in table["steps"]], table["else"])


def flag(signal: str, text: str) -> str:
    """Text when the signal fired, NULL otherwise."""
    return f"CASE WHEN {signal} > 0 THEN {lit(text)} END"


# ---------------------------------------------------------------------------
# Health
# ---------------------------------------------------------------------------


def support_health(tickets: str, table: dict = SUPPORT_HEALTH) -> str:
    steps = [(f"{tickets} = {n}", v) for n, v in table["exact"]]
    steps.append((f"{tickets} >= {table['at_least'][0]}", table["at_least"][1]))
    return ladder(steps, table["else"])


def engagement_health(avg_logins: str, avg_nps: str,
                      logins: dict = LOGIN_ENGAGEMENT, nps: dict = NPS_ENGAGEMENT) -> str:
    last = nps["steps"][-1][0]
    nps_steps = [(f"{avg_nps} >= {t}", v) for t, v in nps["steps"]]
    nps_steps.append((f"{avg_nps} < {last}", nps["below_last"]))
    return f"({at_least(avg_logins, logins)} + {ladder(nps_steps, nps['else'])})"


def weighted_health(usage: str, support: str, engagement: str,
                    weights: dict = HEALTH_WEIGHTS) -> str:
    """ROUND(w_u*usage + w_s*support + w_e*engagement, 1) on unrounded inputs."""
    return (f"ROUND(({usage} * {decimal(weights['usage'])}) + ({support} * {decimal(weights['support'])})"
            f" + ({engagement} * {decimal(weights['engagement'])}), 1)")


# ---------------------------------------------------------------------------
# Churn
# ---------------------------------------------------------------------------


def usage_decline_risk(cur: str, prior: str, table: dict = USAGE_DECLINE) -> str:
    steps = [(f"{prior} IS NOT NULL AND {cur} < {prior} * {decimal(r)}", v)
             for r, v in table["ratio_steps"]]
    steps.append((f"{cur} < {table['floor'][0]}", table["floor"][1]))
    return ladder(steps, table["else"])


def support_burden_risk(tickets: str, table: dict = SUPPORT_BURDEN) -> str:
    steps = [(f"{tickets} >= {table['at_least'][0]}", table["at_least"][1])]
    steps += [(f"{tickets} = {n}", v) for n, v in table["exact"]]
    return ladder(steps, table["else"])


def nps_decline_risk(cur: str, prior: str, table: dict = NPS_DECLINE) -> str:
    steps = [(f"{cur} IS NOT NULL AND {cur} < {t}", v) for t, v in table["below"]]
    drop, points = table["drop"]
    steps.append((f"{prior} IS NOT NULL AND {cur} < {prior} - {drop}", points))
    return ladder(steps, table["else"])


def login_decline_risk(cur: str, prior: str, table: dict = LOGIN_DECLINE) -> str:
    steps = [(f"{cur} < {t}", v) for t, v in table["below"]]
    ratio, points = table["ratio"]
    steps.append((f"{prior} IS NOT NULL AND {cur} < {prior} * {decimal(ratio)}", points))
    return ladder(steps, table["else"])


def inactivity_risk(weeks: str, table: dict = INACTIVITY) -> str:
    return ladder([(f"{weeks} < {table['below'][0]}", table["below"][1])], table["else"])


def capped_sum(parts: Sequence[str], cap: int = CHURN_CAP) -> str:
    return f"LEAST({' + '.join(parts)}, {cap})"


# ---------------------------------------------------------------------------
# Expansion
# ---------------------------------------------------------------------------


def plan_ceiling_signal(plan: str, usage: str, table: dict = PLAN_CEILING) -> str:
    steps = []
    for name in ("Starter", "Professional"):
        steps += [(f"{plan} = {lit(name)} AND {usage} >= {t}", v) for t, v in table[name]]
    return ladder(steps, table["else"])


def growth_signal(recent: str, prior: str, table: dict = GROWTH) -> str:
    return ladder([(f"{prior} IS NOT NULL AND {recent} > {prior} * {decimal(r)}", v)
                   for r, v in table["ratio_steps"]], table["else"])


def mastery_signal(tickets: str, usage: str, table: dict = MASTERY) -> str:
    """tickets = t0 and usage above the bar, then tickets <= t1 and usage above."""
    (t0, v0), (t1, v1) = table["tickets"]
    busy = f"{usage} > {table['usage_above']}"
    return ladder([(f"{tickets} = {t0} AND {busy}", v0), (f"{tickets} <= {t1} AND {busy}", v1)],
                  table["else"])


def expansion_opportunity(plan: str, ceiling: str, adoption: str, growth: str,
                          table: dict = EXPANSION_OPPORTUNITY) -> str:
    steps = [(f"{plan} = {lit(p)} AND {ceiling} >= {t}", text) for p, t, text in table["upgrade"]]
    steps.append((f"{adoption} >= {table['adoption'][0]}", table["adoption"][1]))
    steps.append((f"{growth} >= {table['growth'][0]}", table["growth"][1]))
    return ladder(steps, table["else"])


def estimated_expansion_mrr(plan: str, mrr: str, table: dict = EXPANSION_MRR) -> str:
    return ladder([(f"{plan} = 'Starter'", Raw(decimal(table["Starter"]))),
                   (f"{plan} = 'Professional'", Raw(decimal(table["Professional"])))],
                  Raw(f"{mrr} * {decimal(table['else_factor'])}"))


# ---------------------------------------------------------------------------
# Trends
# ---------------------------------------------------------------------------


def trend_points(pct: str, table: dict) -> str:
    """pct > t1 -> v1, ...; NULL falls to the ELSE value (worst)."""
    return ladder([(f"{pct} > {t}", v) for t, v in table["above"]], table["else"])


# ---------------------------------------------------------------------------
# Cohorts
# ---------------------------------------------------------------------------


def lifecycle_stage(age: str, table: dict = LIFECYCLE_STAGES) -> str:
    return ladder([(f"{age} <= {t}", text) for t, text in table["at_most"]], table["else"])
