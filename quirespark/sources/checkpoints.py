"""Checkpoints of unfinished documents: gzipped JSON, one generation a stage, guarded on reading."""

from __future__ import annotations

import gzip
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VERSION = 1
SCHEMA = "doc_id long, version int, source_sha256 string, language string, saved_at timestamp, stage string, state string"


#: The largest checkpoint stored, in bytes, packed.
LARGEST = 50 * 1024 * 1024


@F.pandas_udf(LongType())
def packed_size(state: pd.Series) -> pd.Series:
    """Bytes of a state when it is packed as it is stored; 0 for null."""
    return state.map(lambda s: 0 if s is None else len(gzip.compress(s.encode(), 6)))


def save(states: DataFrame, folder: str, stage: str, language: str, source: str = "text", largest: int = LARGEST) -> None:
    """Write (doc_id, ``source``, state) as the checkpoints of a stage, in place of the same documents' earlier ones; those of
    other documents stay. A state that packs to more than ``largest`` bytes is an error, and nothing is written."""
    # Only states that could be too large when packed are packed to see.
    big = states.where(F.octet_length("state") > largest).where(packed_size("state") > largest)
    if not big.isEmpty():
        raise ValueError(f"a checkpoint above {largest:,} bytes: document {big.first()['doc_id']}")
    rows = states.select(
        "doc_id", F.lit(VERSION).alias("version"), F.sha2(source, 256).alias("source_sha256"), F.lit(language).alias("language"),
        F.current_timestamp().alias("saved_at"), F.lit(stage).alias("stage"), "state",
    )
    _commit(rows, _folder(folder, language, stage), None)


def _folder(folder: str, language: str, stage: str) -> str:
    return f"{folder.rstrip('/')}/{language}/{stage}"


def _files(spark: SparkSession, path: str) -> tuple:
    """Hadoop's file system of a path, and what makes paths of it."""
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return make(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), make


def generations(spark: SparkSession, at: str) -> list[int]:
    """Numbers of the generations that stand in a folder."""
    fs, path = _files(spark, at)
    if not fs.exists(path(at)):
        return []
    names = (f.getPath().getName() for f in fs.listStatus(path(at)))
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith("gen="))


def _commit(rows: DataFrame, at: str, instead_of: list[int] | None) -> None:
    """Write rows beside a folder's generations and let them in by one rename: a job that is killed, or a task that runs twice,
    leaves no part of them to be read. ``instead_of``: generations that they replace."""
    spark = rows.sparkSession
    fs, path = _files(spark, at)
    making = f"{at}/_making-{uuid.uuid4().hex}"
    try:
        rows.write.option("compression", "gzip").json(making)
        number = max(generations(spark, at), default=0) + 1
        while not fs.rename(path(making), path(f"{at}/gen={number}")):  # another writer took it
            if not fs.exists(path(f"{at}/gen={number}")):
                raise OSError(f"{making} could not be moved to gen={number}")
            number += 1
    finally:
        if fs.exists(path(making)):
            fs.delete(path(making), True)
    for n in instead_of or ():
        fs.delete(path(f"{at}/gen={n}"), True)


def _latest(spark: SparkSession, at: str, numbers: list[int]) -> DataFrame:
    """Each document's checkpoint of its last generation: a combinable maximum, no sort."""
    held = spark.read.option("basePath", at).schema(SCHEMA + ", gen int").json([f"{at}/gen={n}" for n in numbers])
    rest = [c.split()[0] for c in SCHEMA.split(", ") if not c.startswith("doc_id")]
    return held.groupBy("doc_id").agg(F.max_by(F.struct(*rest), F.struct("gen", "saved_at")).alias("m")).select("doc_id", "m.*")


def compact(spark: SparkSession, folder: str, stage: str, language: str) -> int:
    """Make one generation of all of a stage's; how many there were."""
    at = _folder(folder, language, stage)
    numbers = generations(spark, at)
    if len(numbers) > 1:
        _commit(_latest(spark, at, numbers), at, numbers)
    return len(numbers)


def latest(spark: SparkSession, folder: str, stage: str, language: str) -> DataFrame | None:
    """Each document's last checkpoint of a stage, if it is of this version and language; None for a stage without any."""
    at = _folder(folder, language, stage)
    numbers = generations(spark, at)
    if not numbers:
        return None
    return _latest(spark, at, numbers).where((F.col("version") == VERSION) & (F.col("language") == language))


def load(docs: DataFrame, folder: str, stage: str, language: str, source: str = "text") -> DataFrame:
    """docs with the state to go on from: null unless version, language and the source's hash of the document's last checkpoint
    still agree."""
    held = latest(docs.sparkSession, folder, stage, language)
    if held is None:
        return docs.withColumn("state", F.lit(None).cast("string"))
    good = held.select("doc_id", F.col("source_sha256").alias("_sha"), "state")
    return docs.withColumn("_sha", F.sha2(source, 256)).join(good, ["doc_id", "_sha"], "left").drop("_sha")


def delete(spark: SparkSession, folder: str, stage: str, language: str) -> bool:
    """Remove a stage's checkpoints; False if there were none."""
    at = _folder(folder, language, stage)
    fs, path = _files(spark, at)
    return fs.delete(path(at), True)
