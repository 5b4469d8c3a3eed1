"""Physical-plan checks: the shapes the analyses rely on at scale."""

import os
import tempfile

from conftest import AS_OF, SF001

from cspulse.operators import periods
from cspulse.plans import churn_risk, cohort_retention, usage_trends
from cspulse.sources import load_activity, load_customers, write_activity, write_customers
from cspulse.sources.derive import fixture_tables


def plan_text(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_trend_plan_limits_rows_before_shuffle(spark):
    cust, act = fixture_tables(spark, SF001)
    text = plan_text(usage_trends(cust, act, AS_OF))
    assert "WindowGroupLimit" in text and "Partial" in text


def test_churn_scans_activity_once(spark):
    cust, act = fixture_tables(spark, SF001)
    text = plan_text(churn_risk(cust, act, AS_OF))
    assert text.count("events.parquet") == 1


def test_stored_tables_prune_dates_and_columns(spark):
    cust, act = fixture_tables(spark, SF001)
    root = tempfile.mkdtemp(prefix="cspulse-tables-")
    write_customers(cust, os.path.join(root, "customers"))
    write_activity(act, os.path.join(root, "activity"))
    stored = load_activity(spark, os.path.join(root, "activity"))
    df = periods.recent_activity(stored, AS_OF)
    text = plan_text(df)
    assert "PartitionFilters: [isnotnull(activity_date" in text
    assert "activity_date" in text and ">= 2024-06-29" in text
    # only the measures used are read
    read_schema = text.split("ReadSchema: ")[1]
    assert read_schema.startswith("struct<customer_id:int,logins_count:int,feature_usage_score")
    assert "activity_id" not in read_schema
    # same results as on the derived table
    assert df.exceptAll(periods.recent_activity(act, AS_OF)).count() == 0
    stored_cust = load_customers(spark, os.path.join(root, "customers"))
    a = cohort_retention(stored_cust, stored, AS_OF)
    b = cohort_retention(cust, act, AS_OF)
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_curve_shuffles_the_fact_table_once(spark):
    """One exchange of the fact side below the join, and counting rows above it."""
    from cspulse.plans import cohort_retention_curve
    cust, act = fixture_tables(spark, SF001)
    root = tempfile.mkdtemp(prefix="cspulse-curve-")
    write_activity(act, os.path.join(root, "activity"))
    stored = load_activity(spark, os.path.join(root, "activity"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")   # behave like large tables
    try:
        text = plan_text(cohort_retention_curve(cust, stored))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    join = text.index("SortMergeJoin")
    fact = text[join:].split("Exchange hashpartitioning(customer_id")
    assert len(fact) == 3                      # one for each side of the join, no more
    assert "count(distinct" not in text


def test_dated_queries_bound_the_raw_scan(spark):
    from cspulse import catalog
    undated = {"scan_customers", "scan_activity", "assign_mrr", "filter_status_in", "cohort_min_size",
               "cohort_starting_metrics", "cohort_current_status", "cohort_age", "percentile_metrics",
               "cohort_retention_curve", "scalar_month_trunc", "scalar_age_month_part", "domain_faults_activity"}
    stored = ("state_", "totals_", "stored_", "upserted_", "published_")  # they read what they have stored
    keys = {k for k in catalog.queries() if not k.startswith(stored) and not k.endswith("_ranked")}
    for key in sorted(keys - undated):
        text = plan_text(catalog.queries()[key](spark, SF001))
        assert "GreaterThanOrEqual(ts," in text or "events.parquet" not in text, key


def test_checkpoint_folder_is_required_on_a_cluster(spark, monkeypatch):
    import pytest
    from pyspark import SparkContext
    from pyspark.sql.conf import RuntimeConfig

    from cspulse.session import checkpoint_root
    original = RuntimeConfig.get
    monkeypatch.setattr(RuntimeConfig, "get", lambda self, key, *d: (
        (d[0] if d else None) if key == "spark.checkpoint.dir" else original(self, key, *d)))
    monkeypatch.setattr(SparkContext, "getCheckpointDir", lambda self: None)
    monkeypatch.setattr(type(spark.sparkContext), "master", property(lambda self: "yarn"),
                        raising=False)
    monkeypatch.setitem(spark.sparkContext.__dict__, "master", "yarn")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        checkpoint_root(spark)


def test_release_deletes_a_materialized_table(spark):
    from cspulse import materialize, release
    copy = materialize(spark.range(3).toDF("id"), "released")
    path = copy.materialized_path.split("file:")[-1]
    assert os.path.isdir(path)
    release(copy)
    assert not os.path.exists(path)


def _many_cohorts(spark, months=50):
    import datetime as dt

    from conftest import activity, customer
    from cspulse import schemas
    rows = []
    for m in range(months):
        y, k = divmod(m, 12)
        rows += [customer(m * 10 + i, signup=dt.date(2020 + y, k + 1, 5), mrr="10.00")
                 for i in range(5)]
    return (spark.createDataFrame(rows, schemas.CUSTOMERS),
            spark.createDataFrame([activity(0, AS_OF)], schemas.ACTIVITY))


def test_no_limit_means_every_cohort(spark):
    from decimal import Decimal

    from cspulse import portfolio_report, register_views
    from cspulse.__main__ import build
    cust, act = _many_cohorts(spark)
    assert build("cohort_retention", cust, act, AS_OF, None).count() == 50
    assert build("cohort_retention", cust, act, AS_OF, 100).count() == 24
    summary = build("cohort_exec_summary", cust, act, AS_OF, None).first()
    mature = build("cohort_retention", cust, act, AS_OF, None).where("cohort_age_months >= 6").count()
    assert summary.total_mrr == Decimal(50 * mature)
    assert portfolio_report(cust, act, AS_OF, limit=None, include_trends=False)["cohort_retention"].count() == 50
    register_views(spark, cust, act, AS_OF, limit=None, prefix="all_")
    assert spark.sql("SELECT COUNT(*) FROM all_cohort_retention").first()[0] == 50


def test_command_line_prints_every_row(spark, capsys):
    from cspulse.__main__ import main
    cust, act = _many_cohorts(spark)
    root = tempfile.mkdtemp(prefix="cspulse-all-")
    write_customers(cust, os.path.join(root, "customers"))
    write_activity(act, os.path.join(root, "activity"))
    main(["run", "cohort_retention", "--customers", os.path.join(root, "customers"), "--activity",
          os.path.join(root, "activity"), "--as-of", AS_OF.isoformat(), "--all"])
    assert len(capsys.readouterr().out.strip().splitlines()) == 51


def test_domain_faults_counts_values_outside(spark):
    import datetime as dt

    from conftest import activity
    from cspulse import schemas
    from cspulse.sources import domain_faults
    from cspulse.sources.tables import ACTIVITY_DOMAIN
    good, bad = activity(1, AS_OF), activity(2, AS_OF + dt.timedelta(days=1), logins=-1, usage=101, nps=None)
    rows = spark.createDataFrame([good, good, bad], schemas.ACTIVITY)
    faults = {r.column_name: r.faults for r in domain_faults(rows, ACTIVITY_DOMAIN, "activity_id").collect()}
    assert faults == {"activity_id": 0, "customer_id": 0, "activity_date": 0, "logins_count": 1,
                      "feature_usage_score": 1, "support_tickets_opened": 0, "nps_score": 0,
                      "activity_id repeated": 1}


def test_command_line_run_publishes_the_analysis(spark, capsys):
    from cspulse.__main__ import main
    from cspulse.plans import churn_risk, churn_risk_rollup
    from cspulse.sources import read_published

    cust, act = fixture_tables(spark, SF001)
    root = tempfile.mkdtemp(prefix="cspulse-cli-")
    write_customers(cust, os.path.join(root, "customers"))
    write_activity(act, os.path.join(root, "activity"))
    for _ in range(3):
        main(["run", "churn_risk_rollup", "--customers", os.path.join(root, "customers"),
              "--activity", os.path.join(root, "activity"), "--as-of", AS_OF.isoformat(), "--all",
              "--out", os.path.join(root, "out")])
    folder = capsys.readouterr().out.split()[-1]
    expected = churn_risk_rollup(churn_risk(cust, act, AS_OF, limit=None))
    written = read_published(spark, os.path.join(root, "out"), expected.schema)
    assert spark.read.parquet(folder).exceptAll(written).count() == 0
    # The version before stays for its readers, older ones go.
    assert len([d for d in os.listdir(os.path.join(root, "out")) if d.startswith("load=")]) == 2
    assert written.exceptAll(expected).count() == 0 and expected.exceptAll(written).count() == 0


def test_summaries_without_engagement_do_not_scan_activity(spark):
    """Where no engagement column is asked for, its join and its scan go."""
    from cspulse import catalog
    for key in ("cohort_exec_summary", "cohort_exec_summary_latest24", "cohort_exec_summary_baseline",
                "cohort_compare_by_industry"):
        plan = catalog.queries()[key](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
        assert "ts#" not in plan and "event_type" not in plan, key
    plan = catalog.queries()["cohort_retention"](spark, SF001)._jdf.queryExecution().optimizedPlan().toString()
    assert "event_type" in plan
