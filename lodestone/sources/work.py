"""The folder that the driver and all executors share, written tables there, and paths in any store that Spark reads."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """That of ``spark.checkpoint.dir``, which becomes the session's checkpoint folder.  Without the
    setting a local session uses its warehouse; a cluster has no such folder."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder; any other trouble with the store is an error."""
    where, store = _path(spark, path)
    return store.exists(where)


def listed(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Names and sizes of what is in a folder, by name; nothing if there is no folder."""
    where, store = _path(spark, path)
    return sorted((s.getPath().getName(), s.getLen()) for s in store.listStatus(where)) if store.exists(where) else []


def ages(spark: SparkSession, path: str) -> list[tuple[str, float]]:
    """Names of what is in a folder, and for how many seconds it has not been changed."""
    where, store = _path(spark, path)
    now = spark.sparkContext._jvm.System.currentTimeMillis()
    return sorted((s.getPath().getName(), (now - s.getModificationTime()) / 1000) for s in store.listStatus(where)) if store.exists(where) else []


def remove(spark: SparkSession, path: str) -> None:
    """Removes a file or a folder with all in it, if it is there."""
    where, store = _path(spark, path)
    store.delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> str:
    """``path``, which goes when the driver's process ends: for what a returned table still reads."""

    def gone() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            remove(spark, path)

    atexit.register(gone)
    return path


class Scratch:
    """Tables in the shared folder that cut lineage: a lost executor costs tasks of one step only,
    and Spark knows their sizes.  ``clear`` removes them when what was made of them is written; those that
    are left go when the driver's process ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.paths = spark, []
        self.folder = remove_at_exit(spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}")

    def cut(self, rows: DataFrame, **options: str | int) -> DataFrame:
        """``rows``, written, with ``options`` of the writer, and to be read from there."""
        self.paths.append(f"{self.folder}/{len(self.paths)}")
        rows.write.options(**options).parquet(self.paths[-1])
        return self.spark.read.schema(rows.schema).parquet(self.paths[-1])

    def clear(self, keep: int = 0) -> None:
        """Removes the tables but for the last ``keep``."""
        for path in self.paths[: len(self.paths) - keep]:
            remove(self.spark, path)
