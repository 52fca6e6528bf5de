"""Ordered folds: greedy batches, page batches, clusters and span merges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def greedy_batches(items: DataFrame, max_items: int = 10, max_chars: int = 4200) -> DataFrame:
    """Batch number of each item: a batch closes before an item that would exceed either limit.

    One fold over each document's ordered items; a document's items are bounded by its length.
    """
    rows = F.sort_array(F.collect_list(F.struct("pos", F.length("source").cast("long").alias("len"))))
    start = F.expr("named_struct('b', 0L, 'n', 0L, 'c', 0L, 'out', cast(array() as array<struct<pos:int,batch:bigint>>))")

    def step(a, x):
        full = (a["n"] > 0) & ((a["n"] >= max_items) | (a["c"] + x["len"] > max_chars))
        b = a["b"] + full.cast("long")
        return F.struct(
            b.alias("b"), F.when(full, F.lit(1).cast("long")).otherwise(a["n"] + 1).alias("n"),
            F.when(full, x["len"]).otherwise(a["c"] + x["len"]).alias("c"),
            F.array_append(a["out"], F.struct(x["pos"].cast("int").alias("pos"), b.alias("batch"))).alias("out"),
        )

    return items.groupBy("doc_id").agg(F.aggregate(rows, start, step, lambda a: a["out"]).alias("o")).select("doc_id", F.inline("o"))


def page_batches(pages: DataFrame, k: int = 2) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy("page")
    return pages.withColumn("batch", F.floor((F.row_number().over(w) - 1) / k))


def clusters(values: DataFrame, threshold: float = 105.0) -> DataFrame:
    """Number of 1-D clusters of x0 by page: a value joins the last cluster if within ``threshold`` of its mean."""
    xs = F.sort_array(F.collect_list("x0"))
    start = F.struct(F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("s"), F.lit(0).cast("long").alias("n"))

    def step(a, x):
        joins = (a["n"] > 0) & (F.abs(x - a["s"] / F.greatest(F.lit(1), a["n"])) <= threshold)
        return F.struct(
            (a["k"] + (~joins).cast("long")).alias("k"), F.when(joins, a["s"] + x).otherwise(x).alias("s"),
            F.when(joins, a["n"] + 1).otherwise(F.lit(1).cast("long")).alias("n"),
        )

    return values.groupBy("doc_id", "page").agg(F.aggregate(xs, start, step, lambda a: a["k"]).alias("n_clusters"))


def merge_spans(spans: DataFrame) -> DataFrame:
    """Union of overlapping or touching spans (doc_id, s, e)."""
    w = Window.partitionBy("doc_id").orderBy("s", "e")
    top = F.max("e").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("new", F.coalesce(F.col("s") > top, F.lit(True)).cast("int")).withColumn("island", F.sum("new").over(w))
    return marked.groupBy("doc_id", "island").agg(F.min("s").alias("s"), F.max("e").alias("e")).drop("island")


def request_slots(requests: DataFrame, interval_ms: int = 3334, key: str = "user_id") -> DataFrame:
    """When each request (key, event_id, at_ms, free_ms) may start: not before it is there, its cooldown ends
    (null: none) and ``interval_ms`` have passed since the one before. The recurrence
    start = max(ready, previous start + interval) is a running maximum of ready - i * interval, so no fold is needed."""
    w = Window.partitionBy(key).orderBy("at_ms", "event_id")
    ready = F.greatest(F.col("at_ms"), F.coalesce(F.col("free_ms"), F.col("at_ms")))
    placed = requests.withColumn("lag_ms", (F.row_number().over(w) - 1).cast("long") * interval_ms)
    top = F.max(ready - F.col("lag_ms")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return placed.select(key, "event_id", (top + F.col("lag_ms")).alias("start_ms"))
