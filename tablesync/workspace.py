"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession

T = TypeVar("T")
R = TypeVar("R")

#: Runtime SQL settings every sync expects; all can be set on a running session.
SQL_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "static",
}


def configure(spark: SparkSession, **settings: str) -> SparkSession:
    """Apply :data:`SQL_SETTINGS` (and overrides) to a session."""
    for key, value in {**SQL_SETTINGS, **settings}.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors reach, named by ``spark.checkpoint.dir``.

    Only a local session without the setting (a test) falls back to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tablesync-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def fresh_folder(spark: SparkSession, label: str = "run") -> str:
    """A new, not yet existing path under the shared folder."""
    return f"{shared_folder(spark)}/tablesync/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str = "cut", folder: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut and survives lost executors."""
    path = folder or fresh_folder(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_parallel(spark: SparkSession, fn: Callable[[T], R], items: Iterable[T], workers: int) -> list[R]:
    """Run independent Spark jobs from a few threads that share the caller's job group and pool."""
    task = inheritable_thread_target(spark)(fn)
    with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
        return list(pool.map(task, items))


class Folder:
    """The few Hadoop file-system calls the sinks need, on any scheme Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.path = path.rstrip("/")
        self._fs = self._jpath().getFileSystem(self._conf)

    def _jpath(self, name: str = ""):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._jpath(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._jpath(name)))

    def create(self, name: str, text: str) -> None:
        """Create a small file; fails if it exists, so two writers cannot both succeed."""
        out = self._fs.create(self._jpath(name), False)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def text(self, name: str) -> str:
        stream = self._fs.open(self._jpath(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def bytes(self) -> int:
        """Size of all files below."""
        return int(self._fs.getContentSummary(self._jpath()).getLength())

    def take_place_of(self, other: Folder) -> None:
        """Rename this folder to ``other``; what was there is kept until the new one is in place, then removed."""
        old = f"{other.path}.old-{uuid.uuid4().hex}"
        target, aside = other._jpath(), self._jvm.org.apache.hadoop.fs.Path(old)
        if self._fs.exists(target) and not self._fs.rename(target, aside):
            raise OSError(f"{other.path} cannot be renamed")
        if not self._fs.rename(self._jpath(), target):
            self._fs.rename(aside, target)
            raise OSError(f"{self.path} cannot take the place of {other.path}")
        self._fs.delete(aside, True)

    def remove(self, name: str = "") -> None:
        self._fs.delete(self._jpath(name), True)
