"""Driver contract: entry smoke check and Spark/DuckDB parity for every key."""

import pytest
from conftest import SF01

import __spark_entry__ as entry
from cspulse import catalog
from verify import oracle
from verify.compare import digest, duck_connection

KEYS = sorted(catalog.queries())


def test_entry_returns_rows(spark):
    df = entry.entry(spark)
    assert df.columns[:5] == ["customer_id", "company_name", "plan_type", "mrr", "account_owner"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(oracle.build()) == set(KEYS) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def duck():
    return duck_connection(SF01)


@pytest.mark.parametrize("key", KEYS)
def test_matches_oracle(spark, duck, key):
    df = entry.queries()[key](spark, SF01)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.sql(oracle.build()[key])
    expected = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(rows) == len(expected)
    assert digest(df.columns, rows) == digest(rel.columns, expected)


def test_entry_schema_is_stable(spark):
    assert entry.entry(spark).schema == entry.entry(spark).schema


def test_every_query_has_unique_column_names(spark):
    for key in KEYS:
        columns = entry.queries()[key](spark, SF01).columns
        assert len(columns) == len(set(columns)), key


# Changing one threshold in the package must turn its query red: the oracle does not share it.
CHANGES = [("SUPPORT_HEALTH", ["exact", 0], (0, 99), "health_dimensions"),
           ("LOGIN_ENGAGEMENT", ["steps", 2], (21, 60), "health_dimensions"),
           ("HEALTH_GRADES", ["steps", 1], (61, "B - Good"), "health_score"),
           ("USAGE_DECLINE", ["floor"], (50, 10), "risk_signals"),
           ("LOGIN_DECLINE", ["below", 1], (35, 10), "risk_signals"),
           ("RISK_CATEGORIES", ["steps", 2], (20, "Middle Risk"), "churn_risk_full"),
           ("ADOPTION", ["else"], 1, "expansion_signals"),
           ("USAGE_TREND_POINTS", ["above", 2], (0, 11), "trend_scores"),
           ("COHORT_HEALTH", ["steps", 1], (100, "Healthy"), "cohort_retention_baseline")]


@pytest.mark.parametrize("table,path,value,key", CHANGES)
def test_a_changed_threshold_turns_its_query_red(spark, duck, monkeypatch, table, path, value, key):
    from cspulse.functions import rules

    def result():
        df = entry.queries()[key](spark, SF01)
        return digest(df.columns, [tuple(r) for r in df.collect()])

    rel = duck.sql(oracle.build()[key])
    expected = digest(rel.columns, rel.fetchall())
    assert result() == expected
    holder = getattr(rules, table)
    for step in path[:-1]:
        holder = holder[step]
    if isinstance(holder, dict):
        monkeypatch.setitem(holder, path[-1], value)
    else:
        old = holder[path[-1]]
        holder[path[-1]] = value
    try:
        assert result() != expected
    finally:
        if not isinstance(holder, dict):
            holder[path[-1]] = old


def test_the_oracle_does_not_import_the_package():
    import pathlib
    assert "cspulse" not in pathlib.Path(oracle.__file__).read_text()


def test_baseline_cohorts_differ(spark):
    rows = entry.queries()["cohort_retention_baseline"](spark, SF01).collect()
    assert sum(r.starter_to_pro_upgrades + r.pro_to_enterprise_upgrades for r in rows) > 0
    assert len({r.cohort_health for r in rows}) >= 3
    best, worst = ({r.cohort_month for r in entry.queries()[k](spark, SF01).collect()}
                   for k in ("best_cohorts_baseline", "worst_cohorts_baseline"))
    assert not best & worst
