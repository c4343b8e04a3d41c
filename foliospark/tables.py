"""Intermediate tables in the folder that driver and executors share, and small inputs dealt to all cores."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Whether a finished query's shuffle files go at its end, not when the driver happens to collect garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Input bytes a core under which a table is dealt out by row before work on its rows.
SMALL = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Only a session within one process gets a new one where that is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir is not set: it must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="foliospark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


@contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Queries inside leave no shuffle files."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def passing(spark: SparkSession, path: str) -> str:
    """path, whose files go when the driver ends, if nothing has discarded them before."""
    system, target = _file_system(spark, path)
    system.deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage, outlives lost executors, goes with the driver."""
    path = fresh_path(df.sparkSession, label)
    with tidy(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(passing(df.sparkSession, path))


def dropped(*tables: DataFrame) -> None:
    """Delete the files of written tables that nothing reads any more."""
    for df in tables:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            discard(df.sparkSession, path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder in the shared folder that nothing reads any more."""
    system, target = _file_system(spark, path)
    system.delete(target, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where it is small: its files may then hold fewer row groups than there are cores.

    Above ``SMALL`` bytes a core the scan has splits enough, and dealing out rows would only cost a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(2 * cores) if int(str(size)) < SMALL * cores else df
