"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or (local tests only) a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quirespark-")
        spark.sparkContext.setCheckpointDir(folder)
        folder = spark.sparkContext.getCheckpointDir()
    return folder


#: Writer's options for tables whose rows take megabytes: sizes are looked at after each row (after 100 at first by default), and
#: readers, which hold a row group's rows at a time, get some 8 MB of them, however large a task's share of the table is.
LARGE_ROWS = {
    "parquet.block.size": str(8 << 20), "parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1",
    "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1",
}


def materialize(df: DataFrame, options: dict[str, str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: lineage is cut, executors may be lost. ``options`` are the writer's.

    The files go when the driver's file system closes, or earlier through :func:`discard`.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/quire-{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    out = spark.read.schema(df.schema).parquet(path)
    out._quire_path = path
    if scopes := getattr(_SCOPES, "open", None):
        scopes[-1].append(out)
    return out


_SCOPES = threading.local()  # tables written in settled() calls that are still running in this thread


def settled(make: Callable[[], DataFrame]) -> DataFrame:
    """What ``make`` returns, materialized; the tables it wrote on the way are deleted."""
    scopes = _SCOPES.open = getattr(_SCOPES, "open", [])
    scopes.append([])
    out = None
    try:
        out = materialize(make())
    finally:
        for df in scopes.pop():
            if df is not out:
                discard(df)
    if scopes:
        scopes[-1].append(out)
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of a materialized table that no later plan reads."""
    if path := getattr(df, "_quire_path", None):
        spark = df.sparkSession
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def ranked(df: DataFrame, order: list, name: str) -> DataFrame:
    """df, written, with a column ``name``: each row's place from 1 in that order over all rows (any order among rows that
    agree in it). Rows are sorted by range over all tasks; a count for each partition, not a window over everything, adds up to
    places. The counts are as many as the sort's partitions."""
    spark = df.sparkSession
    out = materialize(df.sort(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = sorted((r["p"], r["n"]) for r in out.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())
    starts, before = [], 0
    for p, n in counts:
        starts.append((p, before))
        before += n
    offsets = spark.createDataFrame(starts, "_p long, _before long")
    ahead = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    placed = out.join(F.broadcast(offsets), part == F.col("_p")).withColumn(name, ahead).drop("_p", "_before", "_at")
    placed._quire_path = out._quire_path
    placed._quire_rows = before
    return placed


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows``, so that a task holds few texts as Python strings at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Smaller Arrow batches for a job over texts, so that executors hold less outside their heap; a setting other than
    Spark's default is left alone. For the jobs (queries, stages) that own their session: operators change no setting."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == 10_000:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def fold(key: str, mod: int):
    """crc32 of an id's decimal text modulo mod: the deterministic split into folds."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(mod))
