"""Session construction and lineage-cutting helpers.

Cluster settings win: every default below is applied only when the key is
unset, so a cluster-provided ``spark.sql.shuffle.partitions`` or
``spark.checkpoint.dir`` is never overridden.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import pyspark
from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Defaults for a laptop / CI run.  On a cluster the submitter sets these.
_LOCAL_DEFAULTS = {
    "spark.ui.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(master: str | None = None, app_name: str = "cspulse",
                  shuffle_partitions: int | None = None,
                  extra: dict[str, str] | None = None) -> SparkSession:
    """Return a SparkSession with analytics-friendly defaults.

    Explicit arguments (``master``, ``shuffle_partitions``, ``extra``) are
    applied; the library defaults only fill settings nobody set.  A running
    session (spark-submit, notebook) is returned with the explicit arguments
    that can change at run time and the defaults it leaves unset; for a new session, settings given through
    spark-submit or ``spark-defaults.conf`` are kept.
    """
    explicit = dict(extra or {})
    if shuffle_partitions:
        explicit["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    active = SparkSession.getActiveSession()
    if active is not None:
        for key, value in _LOCAL_DEFAULTS.items():
            if key.startswith("spark.sql.") and active.conf.get(key, None) is None:
                active.conf.set(key, value)
        for key, value in explicit.items():
            if active.conf.isModifiable(key):
                active.conf.set(key, value)
        return active
    preset = _preset_keys()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in _LOCAL_DEFAULTS.items():
        if key not in explicit and key not in preset:
            builder = builder.config(key, value)
    for key, value in explicit.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("WARN")
    return spark


def _preset_keys() -> set[str]:
    """Keys set by spark-submit or ``spark-defaults.conf``.

    When a JVM already runs (spark-submit, notebook) its SparkConf is read.
    Otherwise the JVM must not be started here: settings such as
    ``spark.driver.memory`` only apply at launch, so the defaults files the
    launcher would load are read instead.
    """
    if SparkContext._jvm is not None or os.environ.get("PYSPARK_GATEWAY_PORT"):
        SparkContext._ensure_initialized()
        return {key for key, _ in SparkConf().getAll()}
    keys: set[str] = set()
    folders = [os.environ.get("SPARK_CONF_DIR"),
               os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__),
                            "conf")]
    for folder in filter(None, folders):
        path = os.path.join(folder, "spark-defaults.conf")
        if os.path.isfile(path):
            with open(path) as fh:
                keys |= {re.split(r"[\s=:]", line.strip(), maxsplit=1)[0] for line in fh
                         if line.strip() and not line.lstrip().startswith("#")}
    return keys


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for tables that cut lineage.

    ``spark.checkpoint.dir`` wins, then a checkpoint folder already set on the
    SparkContext.  Without either a private folder is made, once per context,
    and only in local mode: on a cluster executors don't share the driver's
    disk, so the missing setting is an error there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    sc = spark.sparkContext
    existing = sc.getCheckpointDir()
    if existing:
        return existing
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="cspulse-ckpt-")
    sc.setCheckpointDir(root)
    return sc.getCheckpointDir() or root


def materialize(df: DataFrame, name: str | None = None) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it back.

    Used when one analysis feeds several rollups: the rollups then read a
    finished Parquet table instead of re-running (or holding in executor
    memory) the whole upstream plan, and a lost executor costs a re-read, not
    a recomputation.  ``release`` deletes the files when they are no longer read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_root(spark).rstrip('/')}/{name or 'table'}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.materialized_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete the files of tables that ``materialize`` returned."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.materialized_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
