"""Structured Streaming over an events table: windows, deduplication, late results, stuck jobs.

These extend the batch engine. Each function takes a streaming or a batch DataFrame,
so that a batch twin can be checked against SQL.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def source(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """A Parquet folder or file as a stream, `files` at a time."""
    from pathlib import PurePosixPath

    schema = spark.read.parquet(path).schema
    name = PurePosixPath(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    return reader.option("pathGlobFilter", name.name).parquet(str(name.parent)) if name.suffix == ".parquet" and not _is_folder(spark, path) else reader.parquet(path)


def _is_folder(spark: SparkSession, path: str) -> bool:
    files = spark.read.parquet(path).inputFiles()
    return not (len(files) == 1 and files[0].rstrip("/").endswith(path.rstrip("/").rsplit("/", 1)[-1]))


def tumbling(events: DataFrame, width: str, late: str) -> DataFrame:
    """Counts and sums per window and type; what is later than the watermark is left out."""
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sliding(events: DataFrame, width: str, step: str, late: str) -> DataFrame:
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str, late: str) -> DataFrame:
    """Runs of a user's events without a longer gap."""
    g = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def distinct_within(events: DataFrame, keys: list[str], late: str) -> DataFrame:
    """Replays dropped: the first of each key within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def progress(events: DataFrame, key: str, value: str) -> DataFrame:
    """A value that never goes back."""
    return events.groupBy(key).agg(F.max(value).alias("progress"))


def run_available(spark: SparkSession, stream: DataFrame, mode: str, checkpoint: str) -> DataFrame:
    """Process all there is, then return what the sink holds."""
    name = "t" + uuid.uuid4().hex
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def fenced(results: DataFrame, job: str, attempt: str, terminal: str, sequence: str) -> DataFrame:
    """Late results are kept for audit only: of an older attempt, after the job ended, or seen before."""
    from pyspark.sql import Window

    newest = F.max(attempt).over(Window.partitionBy(job))
    again = F.row_number().over(Window.partitionBy(job, attempt, sequence).orderBy(F.col("ts"), F.col("event_id")))
    return results.withColumn("disposition", F.when(again > 1, "duplicate").when(F.col(attempt) < newest, "obsolete").when(F.col(terminal), "terminal").otherwise("publish"))
