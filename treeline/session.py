"""Small helpers over the session: tables in the shared folder, and the loop of a fixed point."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir, or one of our own where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = known.get() if known.isDefined() else None
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):  # one machine, one process
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="shared-")
        atexit.register(shutil.rmtree, named, True)
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may already be gone at exit
        pass


def settle(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back, so that a loop's lineage stays short and survives lost executors. The table goes when the interpreter ends.

    Its joins are shuffled, as lists of facts pack so well that Spark, which goes by the size of files, would send a large table through the driver.
    """
    path = f"{shared_dir(df.sparkSession)}/steps/{uuid.uuid4().hex}"
    atexit.register(_delete, df.sparkSession, path)
    # Spark 4.1 plans joins by the partitions of a union and then merges those of its parts one by one, so that the sides no longer match.
    df.sparkSession.conf.set("spark.sql.unionOutputPartitioning", "false")
    # What joins, groups and filters make of such tables carries no hint, so sizes that were measured in a shuffle decide there, none that were guessed from files.
    df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    df.sparkSession.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).hint("merge")


def few(df: DataFrame, most: int = 100_000) -> DataFrame:
    """df, sent to all tasks of a join if its rows are counted and at most `most`; for narrow rows whose keys are few, as packages are."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside can be stopped by cancel(spark, tag) from another thread; they end with an error."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Stop all running jobs that carry the tag."""
    spark.sparkContext.cancelJobsWithTag(tag)
