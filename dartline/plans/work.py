"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; where that is unset, a folder of our own.

    Only a session in one JVM gets a temporary folder of this machine. On a cluster, where no folder is known to be
    shared, a missing setting is a ValueError.
    """
    context = spark.sparkContext
    base = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if base:
        return base
    if context.master.startswith("local") and not context.master.startswith("local-cluster"):
        base = tempfile.mkdtemp(prefix="dartline-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(base)
    return base


def delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


#: Removes an execution's shuffle files when it ends; a lost executor's are made again meanwhile, as ever.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession):
    """Executions in this block leave no shuffle files behind: their result is in a table, nothing reads them again."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


_roots: list[tuple[SparkSession, str]] = []


@atexit.register
def _clean() -> None:
    """Removes the work tables of this process if its session still runs."""
    for spark, root in _roots:
        with contextlib.suppress(Exception):  # the session may have ended before
            if spark.sparkContext._jsc is not None:
                delete(spark, root)


class Work:
    """Tables of one call in the shared folder; removed when no longer read, or when the process ends."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/work-{uuid.uuid4().hex}"
        self.at = 0
        _roots.append((spark, self.root))

    def keep(self, df: DataFrame, by: str | None = None, **options: str) -> DataFrame:
        """df, written as Parquet and read again: cuts the lineage and outlives lost executors.

        by: a column whose values are folders of their own.
        """
        self.at += 1
        path = f"{self.root}/{self.at}"
        rows = df.write.options(**{"compression": "zstd", **options})
        with shuffles_removed(self.spark):
            (rows.partitionBy(by) if by else rows).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._work_path = path
        return out

    def drop(self, *kept: DataFrame, part: str = "") -> None:
        """Deletes kept tables that nothing will read again, or the folder of one value, part: column=value."""
        for df in kept:
            delete(self.spark, f"{df._work_path}/{part}" if part else df._work_path)
