"""Sharding by vector bin packing over (bytes, tokens, rows)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, materialize


def place(need: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """Greedy vector packing: largest unit first, to the shard of the highest dot product of the unit's need with
    the shard's residual capacity, which it then lowers (in place). Both are relative to a shard's capacity; ties
    go to the lower shard."""
    out = np.zeros(len(need), dtype=np.int32)
    for i in np.lexsort((np.arange(len(need)), -need.max(axis=1))) if len(need) else ():
        out[i] = j = int(np.argmax(residual @ need[i]))
        residual[j] -= need[i]
    return out


def _packer(free: np.ndarray, capacity: np.ndarray):
    """Places one block's units into ``free``; ties go to another shard first in each block."""

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("unit", kind="stable")
        turn = int(df["block"].iloc[0]) % len(free)
        shard = place(df[["b", "t", "r"]].to_numpy(dtype=float) / capacity, np.roll(free, turn, axis=0))
        return pd.DataFrame({"unit": df["unit"], "shard": (shard - turn) % len(free), "b": df["b"], "t": df["t"], "r": df["r"]})

    return pack


def shard_documents(
    docs: DataFrame, n_shards: int = 24, grain: int = 512, block: int = 32_768, rows_per_slot_cell: int = 8_192
) -> DataFrame:
    """Give every row of docs (doc_id, text) a shard, sizes near equal (law ``bytes``).

    Every group of equal texts is placed whole, by :func:`place`, in levels of size. Level 0 holds groups above
    1/grain of a shard in any dimension (at most 3 * n_shards * grain, whatever the input) and is one task. Each
    further level holds groups up to grain times smaller, dealt by hash to blocks of about ``block`` groups; each block
    packs its groups into its equal part of what earlier levels left free. So a task holds a bounded number of
    groups, the driver holds n_shards sums, and blocks at one level differ by less than their groups do.
    A group larger than a whole shard cannot stay together without breaking the law: its rows are dealt by hash of
    the row (not of its id, which may repeat) into chunks of about an eighth of a shard, placed like groups.

    Size is the UTF-8 bytes plus 8; tokens are spaces and line ends plus one. Null text is a group of
    its own, with size 8, crc 0 and no tokens; empty text is another. Repeated rows are rows. Other
    columns are ignored. Empty in, empty out. slot is gapless from 0 in each shard, ordered within
    hashed sub-cells of bounded size, so no task sorts a whole shard.
    """
    text = F.col("text")
    words = F.length(text) - F.length(F.replace(F.replace(text, F.lit(" ")), F.lit("\n"))) + 1
    sized = materialize(
        docs.select(
            F.col("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
            F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(words, F.lit(0)).cast("long").alias("tokens"),
            F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("digest"),
            F.xxhash64(F.monotonically_increasing_id()).alias("deal"),
        )
    )
    total = sized.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    capacity = np.maximum(np.array([float(x or 0) for x in total]) / n_shards, 1)
    sums = (F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r"))
    share = F.greatest(*[F.col(c) / F.lit(float(v)) for c, v in zip("btr", capacity, strict=True)])
    groups = materialize(sized.groupBy("digest").agg(*sums).withColumn("share", share))
    # Groups above a shard: fewer than 3 * n_shards, whatever the input.
    split = groups.where("share > 1").select("digest", F.ceil(F.col("share") * 8).cast("int").alias("chunks"))
    chunk = F.concat_ws("#", "digest", F.pmod("deal", F.col("chunks")).cast("string"))
    rows = sized.join(F.broadcast(split), "digest", "left").withColumn(
        "unit", F.when(F.col("chunks").isNull(), F.col("digest")).otherwise(chunk)
    )
    chunks = rows.where("chunks is not null").groupBy("unit").agg(*sums).withColumn("share", share)
    units = groups.where("share <= 1").withColumnRenamed("digest", "unit").unionByName(chunks)

    residual = np.ones((n_shards, 3))
    placed: list[DataFrame] = []
    left = units.count()
    while left or not placed:
        level = len(placed)
        last = left <= block * grain**level
        own = units if not level else units.where(F.col("share") <= grain**-level)
        own = own if last else own.where(F.col("share") > grain ** -(level + 1))
        n = left if last else own.count()
        blocks = max(1, min(grain**level, -(-n // block)))

        got = materialize(
            own.withColumn("block", F.pmod(F.xxhash64("unit", F.lit(level)), F.lit(blocks)))
            .groupBy("block")
            .applyInPandas(_packer(residual / blocks, capacity), "unit string, shard int, b long, t long, r long")
        )
        placed.append(got)
        for r in got.groupBy("shard").agg(F.sum("b").alias("b"), F.sum("t").alias("t"), F.sum("r").alias("r")).collect():
            residual[r["shard"]] -= np.array([r["b"], r["t"], r["r"]]) / capacity
        left -= n

    # Rows of level 0 meet a broadcast table of bounded size; other groups are small, so their join has no hot key.
    top = placed[0].select("unit", "shard")
    dealt = rows.join(F.broadcast(top), "unit") if len(placed) > 1 else rows.join(top, "unit")
    if len(placed) > 1:
        rest = placed[1]
        for p in placed[2:]:
            rest = rest.unionByName(p)
        others = rows.join(F.broadcast(top), "unit", "left_anti").join(rest.select("unit", "shard"), "unit")
        dealt = dealt.unionByName(others)
    subs = max(1, -(-int(total[2]) // (n_shards * rows_per_slot_cell)))
    dealt = dealt.select("doc_id", "size", "text_crc32", "tokens", "shard", "deal", F.pmod("deal", F.lit(subs)).alias("sub"))
    dealt = materialize(dealt)
    for table in (sized, groups, *placed):
        discard(table)
    before = Window.partitionBy("shard").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("shard", "sub").agg(F.count("*").alias("n")).select(
        "shard", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first")
    )
    within = Window.partitionBy("shard", "sub").orderBy("doc_id", "text_crc32", "size", "deal")
    return (
        dealt.withColumn("rank", F.row_number().over(within))
        .join(offsets, ["shard", "sub"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("first") + F.col("rank") - 1).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "tokens",
        )
    )
