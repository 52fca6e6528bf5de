"""Documents through ordered stages: what each has reached is read from its checkpoints, and only what is left is made."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import checkpoints

#: The stages of a document, in order.
NAMES = ("analysis_complete", "vision_partial", "structure_complete", "math_repair", "math_complete", "translation_partial", "translation_complete")


class Stage(NamedTuple):
    """``make`` gets documents with the state of the stage before (null before the first) and returns them with their new
    ``state``; a document that it leaves out stays where it is."""

    name: str
    make: Callable[[DataFrame], DataFrame]


def manifest(docs: DataFrame, names: Sequence[str], folder: str, language: str, source: str = "text") -> DataFrame:
    """docs with ``reached``, the number of the last stage in order that has a checkpoint of this source (-1: none), and its
    ``state``. A later stage's checkpoint stands for all before it, whether or not they still have theirs. All stages' checkpoints
    are read as one table and meet the documents in one join by (doc_id, hash of the source)."""
    spark = docs.sparkSession
    parts = []
    for i, name in enumerate(names):
        held = checkpoints.latest(spark, folder, name, language)
        if held is not None:
            parts.append(held.select("doc_id", F.col("source_sha256").alias("_sha"), F.lit(i).alias("at"), "state"))
    rest = [c for c in docs.columns if c not in ("reached", "state")]
    if not parts:
        return docs.select(*rest, F.lit(-1).alias("reached"), F.lit(None).cast("string").alias("state"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    last = every.groupBy("doc_id", "_sha").agg(F.max(F.struct("at", "state")).alias("m")).select("doc_id", "_sha", F.col("m.at").alias("at"), F.col("m.state").alias("state"))
    own = docs.select(*rest).withColumn("_sha", F.sha2(source, 256))
    return own.join(last, ["doc_id", "_sha"], "left").select(*rest, F.coalesce("at", F.lit(-1)).alias("reached"), "state")


def run(docs: DataFrame, stages: Sequence[Stage], folder: str, language: str, source: str = "text", until: str | None = None) -> DataFrame:
    """Take every document through the stages that it lacks, one stage at a time, and return the manifest.

    A stage is made for the documents that stand just before it, so one that was stopped at any point, or whose documents
    stand at different stages, goes on without making anything twice. What a stage makes is committed as a whole: a
    run that fails in a stage leaves the stages before it. A changed source starts anew. ``until``: the last stage to make.
    """
    names = [s.name for s in stages]
    for i, stage in enumerate(stages):
        todo = manifest(docs, names, folder, language, source).where(F.col("reached") == i - 1)
        if not todo.isEmpty():
            made = stage.make(todo.drop("reached")).where("state is not null")
            checkpoints.save(made, folder, stage.name, language, source)
        if stage.name == until:
            break
    return manifest(docs, names, folder, language, source)
