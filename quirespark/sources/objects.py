"""Stored objects: read as binary rows, checked, and written by key."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The largest object taken, in bytes.
LARGEST = 50 * 1024 * 1024


def fault(content: Column, length: Column, magic: bytes = b"%PDF", largest: int = LARGEST) -> Column:
    """``empty``, ``too large`` or ``type`` (the first bytes differ); null for a good object."""
    head = F.substring(F.hex(content), 1, 2 * len(magic))
    return F.when(length == 0, "empty").when(length > largest, "too large").when(head != magic.hex().upper(), "type")


def read_objects(spark: SparkSession, folder: str, pattern: str = "*.pdf", largest: int = LARGEST) -> DataFrame:
    """(path, length, fault, sha256) of a folder's objects. Objects above ``largest`` are listed by a pass that reads
    no content. Spark's file sources pass over files of no bytes, so those give no row; an anti join with the keys
    expected finds them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder)
    small = files.where(F.col("length") <= largest)
    good = small.select("path", "length", fault(F.col("content"), F.col("length"), largest=largest).alias("fault"), F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > largest).select("path", "length", F.lit("too large").alias("fault"), F.lit(None).cast("string").alias("sha256"))
    return good.unionByName(large)


def write_objects(objects: DataFrame, folder: str, magic: bytes = b"%PDF", largest: int = LARGEST) -> DataFrame:
    """Store objects (path, content) under ``folder`` by their path, over what is there; (path, length, fault) of each. Those
    with a fault are not stored. Each task writes its rows, so a task that runs again stores the same bytes again."""
    checked = objects.select("path", "content", fault(F.col("content"), F.length("content"), magic, largest).alias("fault"))

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        for batch in batches:
            sizes = []
            for path, content, bad in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sizes.append(len(content or b""))
                if bad is None and path and content is not None:
                    if ".." in path.split("/"):
                        raise ValueError(f"a path outside the folder: {path}")
                    whole = f"{root.rstrip('/')}/{path.lstrip('/')}"
                    files.create_dir(whole.rsplit("/", 1)[0], recursive=True)
                    with files.open_output_stream(whole) as out:
                        out.write(content)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), batch.column(2)], names=["path", "length", "fault"])

    return checked.mapInArrow(store, "path string, length long, fault string")


def insert_rows(rows: DataFrame, folder: str) -> None:
    """Append rows to a table of files."""
    rows.write.mode("append").parquet(folder)
