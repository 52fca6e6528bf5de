"""The queue operators over streams."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.readwriter import DataStreamWriter

from ..operators import queue


def heartbeat_stream(spark: SparkSession, folder: str, files_per_batch: int = 4) -> DataFrame:
    """Heartbeats as they arrive in a folder of Parquet files."""
    return (
        spark.readStream.schema("event_id long, user_id long, ts timestamp, action string, value double")
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )


def session_stream(beats: DataFrame, gap: str = "45 seconds", late: str = "10 minutes") -> DataFrame:
    """Sessions that a gap closes, appended once the watermark has passed them."""
    return queue.sessions(beats.withWatermark("ts", late), gap)


def unique_stream(events: DataFrame, key: str = "event_id", late: str = "10 minutes") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


COUNTED = "job_id long, made long, at timestamp"


def counted(log: DataFrame) -> DataFrame:
    """A log's dispatches (job_id, at) by job: how many were made, and the last moment."""
    return log.groupBy("job_id").agg(F.count("*").alias("made"), F.max("at").alias("at"))


def with_dispatches(jobs: DataFrame, log: DataFrame) -> DataFrame:
    """jobs with the attempts and the last dispatch that a log (job_id, at), or what is counted of it, adds to their own."""
    made = log if "made" in log.columns else counted(log)
    own = jobs.schema["last_dispatch"].dataType
    return jobs.join(made, "job_id", "left").withColumns(
        {
            "attempts": F.col("attempts") + F.coalesce("made", F.lit(0)),
            "last_dispatch": F.greatest("last_dispatch", F.col("at").cast(own)),
            "progress": F.when(F.col("made") > 0, F.greatest("progress", F.lit(2))).otherwise(F.col("progress")),
        }
    ).drop("made", "at")


def held_before(spark: SparkSession, log: str, number: int, every: int) -> DataFrame:
    """(job_id, made, at) of all ticks before ``number``: the snapshot of the last multiple of ``every`` and at most ``every``
    ticks after it, named by their numbers, so that what is read and planned is the same at any age of the log."""
    base = number // every * every
    parts = [spark.createDataFrame([], COUNTED)]
    if base:
        parts.append(spark.read.schema(COUNTED).parquet(f"{log}/_counted/before={base}"))
    if number > base:
        parts.append(counted(spark.read.schema("job_id long, at timestamp").parquet(*[f"{log}/tick={n}" for n in range(base, number)])))
    both = parts[0]
    for part in parts[1:]:
        both = both.unionByName(part)
    return both.groupBy("job_id").agg(F.sum("made").cast("long").alias("made"), F.max("at").alias("at"))


def dispatch_tick(jobs: DataFrame, moments: Callable[[int], str], log: str, limit: int = 3, live: int = 45, every: int = 100) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: at each tick the oldest jobs that may be dispatched, by their own state and the dispatches
    logged so far, are logged in turn, so attempts rise, a job rests for its cooldown and stops at its cap. Each tick has a
    folder of its own: one that runs again, with the same moment, writes the same rows in place of its first ones. Every
    ``every`` ticks what was logged so far is counted into a snapshot, and ticks two snapshots old are deleted."""
    spark = jobs.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(log).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def snapshot(number: int) -> None:
        before = number - every
        parts = [counted(spark.read.schema("job_id long, at timestamp").parquet(*[f"{log}/tick={n}" for n in range(before, number)]))]
        if before:
            parts.append(spark.read.schema(COUNTED).parquet(f"{log}/_counted/before={before}"))
        both = parts[0].unionByName(parts[1]) if before else parts[0]
        both.groupBy("job_id").agg(F.sum("made").cast("long").alias("made"), F.max("at").alias("at")).write.mode("overwrite").parquet(f"{log}/_counted/before={number}")
        for n in range(max(0, before - every), before):  # this tick may run again, and reads back to ``before``
            fs.delete(path(f"{log}/tick={n}"), True)
        if before:
            fs.delete(path(f"{log}/_counted/before={before - every}"), True)

    def tick(batch: DataFrame, number: int) -> None:
        if number and number % every == 0:
            snapshot(number)
        at = moments(number)
        due = queue.recoverable(with_dispatches(jobs, held_before(spark, log, number, every)), at, limit, live)
        due.select("job_id", F.lit(at).cast("timestamp").alias("at")).write.mode("overwrite").parquet(f"{log}/tick={number}")

    return tick


def half_minutes(stream: DataFrame, seconds: int = 30) -> DataStreamWriter:
    """A writer of a stream that ticks every ``seconds``."""
    return stream.writeStream.trigger(processingTime=f"{seconds} seconds")


def now_text() -> str:
    """The moment, in UTC, as an ISO text with its offset."""
    return datetime.now(timezone.utc).isoformat()
