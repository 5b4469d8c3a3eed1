"""Tables that outlive one job: written once under the shared folder, read by the next jobs.

The folder comes from ``spark.checkpoint.dir`` (see ``session.checkpoint_root``),
so a lost executor costs a re-read and never a recomputation of the work before.
"""

from __future__ import annotations

import os
import re
import uuid
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession

from cspulse.session import checkpoint_root

_PACKAGE_HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


class Scratch:
    """A private folder of Parquet tables in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark = spark
        self.root = f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: list[str] = []

    def table(self, df: DataFrame, name: str, gather: bool = False) -> DataFrame:
        """Write ``df`` and return it read back, its lineage cut.

        ``gather``, for rows few beside the input: one more shuffle, and files by
        the bytes instead of one a task.  Each file costs its task several
        processes on a local file system (Hadoop's chmod).
        """
        if gather:
            df = df.hint("rebalance", self.spark.sparkContext.defaultParallelism)
        self.count += 1
        path = f"{self.root}/{self.count:03d}-{name}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        self.paths.append(path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later job reads."""
        for df in tables:
            _delete(self.spark, df._scratch_path)
            self.paths.remove(df._scratch_path)

    def keep(self, *tables: DataFrame) -> None:
        """Delete all tables but those that a result reads."""
        kept = {df._scratch_path for df in tables}
        for path in [p for p in self.paths if p not in kept]:
            _delete(self.spark, path)
            self.paths.remove(path)


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def release(result: DataFrame) -> None:
    """Delete the scratch tables that an operator's result still reads, once it is written or no longer needed.

    Only tables of a ``Scratch`` under this session's checkpoint folder are
    deleted; the caller's own tables stay.
    """
    spark = result.sparkSession
    home = urlparse(checkpoint_root(spark)).path.rstrip("/") + "/"
    # <home>/<operator>-<32 hexadecimal digits>/<number>-<table>/<part>
    own = re.compile(re.escape(home) + r"[a-z]+-[0-9a-f]{32}/[0-9]{3}-[^/]+(?=/)")
    found = {(uri.scheme, uri.netloc, m[0]) for uri in map(urlparse, result.inputFiles()) if (m := own.match(unquote(uri.path)))}
    for scheme, place, path in sorted(found):
        _delete(spark, f"{scheme}://{place}{path}")


def importable_in_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it.

    On a cluster the package is installed (or sent with ``--py-files``); the
    extra path is then merely unused.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _PACKAGE_HOME not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, _PACKAGE_HOME])
