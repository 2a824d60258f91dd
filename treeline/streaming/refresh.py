"""Incremental refresh as a stream: files arrive as snapshots, changed ones are parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from treeline.functions import text as T


def latest(changes: DataFrame) -> DataFrame:
    """The newest text of each path of changes(path, text, version); a null text takes the file away."""
    newest = changes.groupBy("path").agg(F.max_by(F.struct("text", "version"), "version").alias("n"))
    return newest.select("path", "n.text", "n.version").filter("text is not null")


def stream_facts(spark: SparkSession, folder: str, out: str, checkpoint: str, extract):  # noqa: ANN001, ANN201
    """Read a growing folder of Parquet snapshots (path, text, version); append facts of each batch's files with their version.

    Readers take the newest version of a path (see newest_only), so a batch that runs twice
    after a failure does no harm.
    """
    source = spark.readStream.schema("path string, text string, version long").parquet(folder)

    def handle(batch: DataFrame, number: int) -> None:
        extract(latest(batch)).withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    return source.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_only(facts: DataFrame) -> DataFrame:
    """Facts of each path's newest version: ranked by path, ties by batch."""
    top = F.row_number().over(Window.partitionBy("path").orderBy(F.desc("version"), F.desc("batch")))
    newest = facts.select("path", "version", "batch").distinct().withColumn("r", top).filter("r = 1").drop("r")
    return facts.join(newest, ["path", "version", "batch"], "left_semi")


def stale(dependencies: DataFrame, changed: DataFrame) -> DataFrame:
    """Paths whose consulted files(path, consulted) changed."""
    return dependencies.join(changed.select(F.col("path").alias("consulted")), "consulted", "left_semi").select("path").distinct()


def windowed_events(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """An extension: events per window and type, with a watermark; the same plan for a batch and a stream."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def snapshot_of(files: DataFrame) -> DataFrame:
    return files.select("path", T.content_id(F.col("text")).alias("content_id"))
