"""Customer history and baselines as of a date."""

import datetime as dt
from decimal import Decimal

from conftest import AS_OF, activity, customer, weeks_ago

from cspulse.plans import cohort_retention
from cspulse.sources.history import as_of, baseline, versions

D = dt.date


def snapshots(spark, rows):
    return spark.createDataFrame([(c, d, n, p, None if m is None else Decimal(m)) for c, d, n, p, m in rows],
                                 "customer_id int, snapshot_date date, n int, plan_type string, mrr decimal(10,2)")


ROWS = [(1, D(2024, 1, 1), 1, "Starter", "50.00"), (1, D(2024, 2, 1), 1, "Starter", "50.00"),
        (1, D(2024, 3, 1), 1, "Professional", "200.00"), (1, D(2024, 3, 1), 2, "Professional", "210.00"),
        (1, D(2024, 5, 1), 1, "Starter", "50.00"), (2, D(2024, 4, 1), 1, None, None),
        (2, D(2024, 4, 2), 1, None, None), (2, D(2024, 4, 3), 1, "Starter", None),
        (None, D(2024, 4, 1), 1, "Starter", "1.00"), (3, None, 1, "Starter", "1.00")]


def test_versions_join_equal_neighbours(spark):
    got = sorted((r.customer_id, r.valid_from, r.valid_to, r.plan_type, r.mrr and str(r.mrr))
                 for r in versions(snapshots(spark, ROWS), latest="n").collect())
    assert got == [
        (1, D(2024, 1, 1), D(2024, 3, 1), "Starter", "50.00"),
        (1, D(2024, 3, 1), D(2024, 5, 1), "Professional", "210.00"),
        (1, D(2024, 5, 1), None, "Starter", "50.00"),
        (2, D(2024, 4, 1), D(2024, 4, 3), None, None), (2, D(2024, 4, 3), None, "Starter", None)]


def test_versions_do_not_depend_on_the_order_of_loads(spark):
    a = versions(snapshots(spark, ROWS), latest="n")
    b = versions(snapshots(spark, ROWS[::-1]).repartition(3), latest="n")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_as_of_takes_the_version_of_the_day(spark):
    history = versions(snapshots(spark, ROWS), latest="n")
    asked = spark.createDataFrame([(1, D(2023, 12, 31)), (1, D(2024, 1, 1)), (1, D(2024, 2, 29)), (1, D(2024, 3, 1)),
                                   (1, D(2030, 1, 1)), (2, D(2024, 4, 2)), (9, D(2024, 4, 2)), (1, None)],
                                  "customer_id int, at date")
    got = sorted((str(r.customer_id), str(r.at), r.plan_type) for r in as_of(asked, history, "at").collect())
    assert got == sorted([("1", "2023-12-31", None), ("1", "2024-01-01", "Starter"), ("1", "2024-02-29", "Starter"),
                          ("1", "2024-03-01", "Professional"), ("1", "2030-01-01", "Starter"),
                          ("2", "2024-04-02", None), ("9", "2024-04-02", None), ("1", "None", None)])
    assert as_of(asked, history, "at", how="inner").count() == 5


def test_baseline_at_signup_shows_upgrades(spark, tables):
    """Six customers signed up as Starter and are Professional today; one has no recorded state."""
    people = [customer(i, plan="Professional", mrr="200.00", signup=D(2024, 1, 15)) for i in range(1, 8)]
    cust, act = tables(people, [activity(1, weeks_ago(1))])
    states = snapshots(spark, [r for i in range(1, 7) for r in (
        (i, D(2024, 1, 1), 1, "Starter", "50.00"), (i, D(2024, 6, 1), 1, "Professional", "200.00"))])
    history = versions(states)
    at_signup = baseline(cust, history)
    assert at_signup.count() == 6
    row = cohort_retention(cust, act, AS_OF, baseline=at_signup).collect()[0]
    assert (row.starter_to_pro_upgrades, float(row.starting_mrr), float(row.current_mrr)) == (6, 500.0, 1400.0)
    later = cohort_retention(cust, act, AS_OF, baseline=baseline(cust, history, "DATE '2024-07-01'")).collect()[0]
    assert later.starter_to_pro_upgrades == 0 and float(later.revenue_retention_rate) == 100.0
