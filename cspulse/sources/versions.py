"""Parquet tables with versions: written aside, published by a manifest.

A version is a manifest, a small JSON file that lists the directory of each
partition.  A write puts its files into a new directory and then adds the next
manifest by one rename, so a reader sees the old version or the new one, and a
write that fails leaves nothing that a reader looks at.  A partition that a
write does not touch keeps its directory, and so its files.  Readers pin one
version; ``expire`` deletes what only older versions list.

Manifests are as long as the table has partitions (dates).  The rename must fail
where the target exists, as it does on HDFS; two writers that start from one
version cannot both publish.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"


class VersionConflict(RuntimeError):
    """Another writer published a version since this one started."""


class VersionedTable:
    """The table below ``root``: columns of ``schema``, one partition a value of ``by`` (or one in all)."""

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, by: str | None = None) -> None:
        self.spark, self.root, self.schema, self.by = spark, root.rstrip("/"), schema, by
        self._jvm = spark._jvm
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    # ------------------------------------------------------------- manifests

    def versions(self) -> list[int]:
        """Published versions, oldest first."""
        folder = self._path("_manifests")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and not n.startswith("."))

    def current(self) -> int | None:
        """The latest version; None before the first write."""
        return max(self.versions(), default=None)

    def manifest(self, version: int | None = None) -> dict:
        """``parts`` (partition value to directory) and ``meta`` of a version, by default the latest."""
        version = self.current() if version is None else version
        if version is None:
            return {"parts": {}, "meta": {}}
        stream = self._fs.open(self._path(f"_manifests/{version:010d}.json"))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return json.loads(text)

    def changed(self, before: int | None, after: int | None = None) -> tuple[set[str], set[str]]:
        """Partition values (written, dropped) between two versions; ``before`` None: since the start."""
        old = self.manifest(before)["parts"] if before is not None else {}
        new = self.manifest(after)["parts"]
        return {v for v, d in new.items() if old.get(v) != d}, set(old) - set(new)

    # ------------------------------------------------------------ read, write

    def read(self, version: int | None = None, values: Iterable[str] | None = None,
             since: str | None = None, until: str | None = None) -> DataFrame:
        """Rows of one version: all partitions, those of ``values``, or ``since`` <= value < ``until``.

        The manifest decides which directories are read; filters on ``by`` prune further.
        """
        parts = self.manifest(version)["parts"]
        if values is not None:
            parts = {v: d for v, d in parts.items() if v in set(values)}
        paths = [f"{self.root}/{d}" for v, d in sorted(parts.items())
                 if (since is None or v >= since) and (until is None or v < until)]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read.schema(self.schema).option("basePath", self.root)
        return reader.parquet(*paths).select(*self.schema.fieldNames())

    def replace(self, df: DataFrame, base: int | None = None, drop: Iterable[str] = (),
                meta: dict | None = None, whole: bool = False) -> int:
        """Publish a version whose partitions in ``df`` are ``df``'s rows, without those of ``drop``.

        ``base`` is the version the rows were made from (default: the latest
        when called); VersionConflict if another one was published since.
        ``whole``: all other partitions go.  Returns the new version.
        """
        base = self.current() if base is None else base
        load = f"load={uuid.uuid4().hex}"
        target = f"{self.root}/{load}"
        rows = df.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields])
        if self.by:
            # A value of many rows is split over tasks, few values do not make many files.
            others = [f.name for f in self.schema.fields if f.name != self.by][:1]
            rows = rows.repartitionByRange(self.by, *others).sortWithinPartitions(self.by, *others)
            rows.write.partitionBy(self.by).parquet(target)
            names = [s.getPath().getName() for s in self._fs.listStatus(self._path(load)) if s.isDirectory()]
            written = {n.split("=", 1)[1]: f"{load}/{n}" for n in names if n.startswith(f"{self.by}=")}
        else:
            rows.write.parquet(target)
            written = {"": load}
        old = {"parts": {}, "meta": {}} if base is None else self.manifest(base)
        kept = {} if whole else {v: d for v, d in old["parts"].items() if v not in set(drop)}
        self._publish((base or 0) + 1, {"parts": kept | written, "meta": old["meta"] | (meta or {})})
        return (base or 0) + 1

    def expire(self, keep: int = 1) -> None:
        """Delete all but the ``keep`` latest versions, and the directories that only those list."""
        versions = self.versions()
        used = {d for v in versions[-keep:] for d in self.manifest(v)["parts"].values()}
        for version in versions[:-keep]:
            for directory in set(self.manifest(version)["parts"].values()) - used:
                self._fs.delete(self._path(directory), True)
            self._fs.delete(self._path(f"_manifests/{version:010d}.json"), False)

    # -------------------------------------------------------------- internals

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _publish(self, version: int, manifest: dict) -> None:
        aside = self._path(f"_manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        target = self._path(f"_manifests/{version:010d}.json")
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self.spark.sparkContext._gateway.new_array(rename, 1)
        options[0] = rename.NONE
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(
            self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(aside), self._fs.makeQualified(target), options)
        except Exception as error:
            self._fs.delete(aside, False)
            if self._fs.exists(target):
                raise VersionConflict(f"version {version} of {self.root} exists already") from error
            raise


def publish(df: DataFrame, root: str) -> int:
    """Publish a result as the next version of the table below ``root``; readers keep the old one until then."""
    return VersionedTable(df.sparkSession, root, df.schema).replace(df, whole=True)


def read_published(spark: SparkSession, root: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """A published result: the latest version, or the one named."""
    return VersionedTable(spark, root, schema).read(version)
