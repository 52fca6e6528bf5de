"""Watching and stopping work: metrics of a running query, cancellation by tag, restabilising part of a document."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def watched(df: DataFrame, done: Column, name: str = "progress") -> tuple[DataFrame, Observation]:
    """df with metrics that its next action fills in, at no extra pass: rows seen, rows done and their share in percent."""
    seen = Observation(f"{name}-{uuid.uuid4().hex[:8]}")
    part = F.count_if(done) / F.greatest(F.lit(1), F.count(F.lit(1)))
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), F.count_if(done).alias("done"), F.floor(part * 100).alias("percent")), seen


@contextmanager
def cancellable(spark: SparkSession, gone: Callable[[], bool], every: float = 0.5) -> Iterator[str]:
    """Work inside is interrupted once ``gone()`` holds, which is asked ``every`` few seconds beside it. Only jobs with this
    block's own tag stop."""
    tag, stop = f"work-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        while not stop.wait(every):
            if gone():
                context.cancelJobsWithTag(tag)
                return

    context = spark.sparkContext
    context.addJobTag(tag)
    watcher = threading.Thread(target=watch, daemon=True)
    watcher.start()
    try:
        yield tag
    finally:
        stop.set()
        watcher.join()
        context.removeJobTag(tag)
