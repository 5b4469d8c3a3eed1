"""Session helpers: shared checkpoint folder and the date-partitioned writer."""

import os
import tempfile

from conftest import SF001
from pyspark.sql.conf import RuntimeConfig

from cspulse.session import checkpoint_root, materialize
from cspulse.sources import load_activity, write_activity
from cspulse.sources.derive import fixture_tables


def test_checkpoint_folder_is_stable_and_used(spark):
    """Here the bundled spark-defaults.conf names the folder; otherwise a private one is made."""
    root = checkpoint_root(spark)
    assert root == checkpoint_root(spark) and os.path.isdir(root)
    copy = materialize(spark.range(10).selectExpr("id", "id * 2 AS twice"), "probe")
    assert copy.count() == 10
    assert os.path.normpath(root) in os.path.normpath(copy.inputFiles()[0].split("file:")[-1])


def test_configured_checkpoint_dir_wins(spark, monkeypatch):
    """On a cluster spark.checkpoint.dir is set at session creation; it is used as is."""
    shared = tempfile.mkdtemp(prefix="cspulse-shared-")
    original = RuntimeConfig.get

    def get(self, key, *default):
        return shared if key == "spark.checkpoint.dir" else original(self, key, *default)

    monkeypatch.setattr(RuntimeConfig, "get", get)
    assert checkpoint_root(spark) == shared
    copy = materialize(spark.range(5), "cluster")
    assert copy.count() == 5
    assert any(name.startswith("cluster-") for name in os.listdir(shared))


def test_write_activity_makes_one_directory_per_date(spark):
    _, act = fixture_tables(spark, SF001)
    path = os.path.join(tempfile.mkdtemp(prefix="cspulse-act-"), "activity")
    write_activity(act, path)
    dates = {r.activity_date for r in act.select("activity_date").distinct().collect()}
    dirs = [d for d in os.listdir(path) if d.startswith("activity_date=")]
    assert len(dirs) == len(dates)
    back = load_activity(spark, path)
    assert back.exceptAll(act).count() == 0 and act.exceptAll(back).count() == 0


def test_rewriting_some_dates_keeps_the_others(spark):
    _, act = fixture_tables(spark, SF001)
    path = os.path.join(tempfile.mkdtemp(prefix="cspulse-reload-"), "activity")
    write_activity(act, path)
    last = act.agg({"activity_date": "max"}).first()[0]
    reload = act.filter(act.activity_date == last).withColumn("logins_count", act.logins_count * 0)
    write_activity(reload, path)                      # replaces only the last date
    back = load_activity(spark, path)
    assert back.count() == act.count()
    assert back.filter(back.activity_date == last).agg({"logins_count": "max"}).first()[0] == 0
    older = act.filter(act.activity_date < last)
    assert back.filter(back.activity_date < last).exceptAll(older).count() == 0
