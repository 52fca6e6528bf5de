"""Importance resampling towards a target: hashed n-gram features by an integer word dictionary, then a Gumbel top-k draw.

Texts are read once and turned into blocks: the distinct words of some documents, their distinct n-grams as tuples of places
in that list, and each document's counts of them. Only a block's distinct words and tuples ever meet those of other blocks,
so a word that stands in every document is one row for each block, not for each document. Distinct words get integers; an
n-gram is the tuple of its words' integers; each distinct tuple is spelled and hashed once; its gain goes back to the blocks,
where documents add up what they count.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import LARGE_ROWS, discard, materialize, ranked, settled, sliced

#: Words: runs of digits, small ASCII letters and anything beyond ASCII, once A-Z are small.
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLOCK_CHARS = 4_000_000
BLOCK_DOCS = 2000
_INTS = pa.list_(pa.int32())
_DOC = pa.struct([("at", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("grams", _INTS), ("counts", _INTS)])
_BLOCK = pa.schema(
    [("part", pa.int32()), ("number", pa.int32()), ("words", pa.list_(pa.string())), ("grams", pa.list_(_INTS)), ("totals", pa.list_(pa.int64())), ("docs", pa.list_(_DOC))]
)
_BLOCK_DDL = (
    "part int, number int, words array<string>, grams array<array<int>>, totals array<long>, "
    "docs array<struct<at:int, doc_id:long, n_words:long, n_features:long, grams:array<int>, counts:array<int>>>"
)


class _Block:
    """Places of words and n-grams in one block's lists, and what its documents count. Single words need no list of n-grams:
    their places are those of the words."""

    def __init__(self, least: int, most: int) -> None:
        self.least, self.most = least, most
        self.words: dict[str, int] = {}
        self.grams: dict[tuple, int] = {}
        self.docs: list[tuple] = []  # (doc_id, words, features, distinct features)
        self.ids: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.chars = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        """Count one document; ``setdefault`` with the list's length gives a new word or n-gram the next place."""
        found = WORD.findall((text or "").translate(_SMALL))
        words = self.words
        if self.most == 1:
            counts, known = Counter(found), words
        else:
            counts, known = Counter(), self.grams
            places = [words.setdefault(w, len(words)) for w in found]
            for n in range(self.least, self.most + 1):
                counts.update(zip(*(places[i:] for i in range(n)), strict=False))
        self.ids.append(np.fromiter((known.setdefault(g, len(known)) for g in counts), np.int32, len(counts)))
        self.counts.append(np.fromiter(counts.values(), np.int32, len(counts)))
        self.docs.append((doc_id, len(found), int(self.counts[-1].sum()), len(counts)))
        self.chars += len(text or "")

    def batch(self, part: int, number: int) -> pa.RecordBatch:
        ids, counts = np.concatenate(self.ids), np.concatenate(self.counts)
        n_known = len(self.words if self.most == 1 else self.grams)
        totals = np.bincount(ids, counts, n_known).astype(np.int64)
        doc_ids, n_words, n_features, n_distinct = zip(*self.docs, strict=True)
        offsets = pa.array(np.concatenate([[0], np.cumsum(n_distinct)]), pa.int32())
        docs = pa.StructArray.from_arrays(
            [
                pa.array(range(len(self.docs)), pa.int32()), pa.array(doc_ids, pa.int64()), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(counts)),
            ],
            fields=list(_DOC),
        )
        grams = pa.array([list(g) for g in self.grams], _INTS)
        lists = [pa.ListArray.from_arrays([0, len(x)], x) for x in (pa.array(self.words, pa.string()), grams, pa.array(totals), docs)]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), *lists], schema=_BLOCK)


def _blocks(docs: DataFrame, least: int, most: int) -> DataFrame:
    """One row for up to BLOCK_DOCS documents or BLOCK_CHARS characters (a longer text is a block of its own)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, number, block = TaskContext.get().partitionId(), 0, _Block(least, most)
        for batch in sliced(batches, 100):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if block.docs and (len(block.docs) >= BLOCK_DOCS or block.chars + len(text or "") > BLOCK_CHARS):
                    yield block.batch(part, number)
                    number, block = number + 1, _Block(least, most)
                block.add(doc_id, text)
        if block.docs:
            yield block.batch(part, number)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _BLOCK_DDL)


def _gathered(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(block, place, value) -> (block, array of values in order of place)."""
    pairs = F.array_sort(F.collect_list(F.struct("place", value)))
    return rows.groupBy("block").agg(F.transform(pairs, lambda x: x[value]).alias(name))


def _hash(feature: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(feature).cast("binary")), F.lit(buckets)).cast("int").alias("bucket")


def _sums() -> list[Column]:
    """Counts of the documents and of the target."""
    return [F.sum(F.when(F.col("side") == side, F.col("total")).otherwise(0)).alias(name) for side, name in ((0, "s"), (1, "t"))]


def count_features(blocks: DataFrame, least: int, most: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """What (side, block, words, grams, totals) holds: (block, place, bucket) of each block's distinct n-grams, and
    (bucket, s, t), the counts on either side, at most ``buckets`` rows.

    Distinct words get integers. A tuple of one word is that word's row of the dictionary, so its bytes are hashed there; longer
    tuples are told apart by their integers, spelled from the dictionary and hashed once each, and joined back by integers.
    """
    words = blocks.select("side", "block", F.posexplode(F.arrays_zip("words", "totals") if most == 1 else F.arrays_zip("words")).alias("place", "x"))
    words = words.select("side", "block", "place", "x.*").withColumnRenamed("words", "word").withColumnRenamed("totals", "total")
    known = words.groupBy("word").agg(*(_sums() if most == 1 else [F.count("*").alias("n")]))
    dictionary = materialize(known.select("*", F.monotonically_increasing_id().alias("id"), _hash("word", buckets)))
    if most == 1:
        placed = words.drop("side", "total").join(dictionary.select("word", "bucket"), "word").select("block", "place", "bucket")
        return placed, materialize(dictionary.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))
    ids = _gathered(words.join(dictionary.select("word", "id"), "word").select("block", "place", "id"), "id", "ids")
    as_ids = F.transform("grams", lambda g: F.transform(g, lambda i: F.get("ids", i))).alias("tuple")
    tuples = blocks.join(ids, "block").select("side", "block", F.posexplode(F.arrays_zip(as_ids, "totals")).alias("place", "x"))
    tuples = materialize(tuples.select("side", "block", "place", F.col("x.tuple").alias("tuple"), F.col("x.totals").alias("total")))
    distinct = materialize(tuples.groupBy("tuple").agg(*_sums()).withColumn("gram", F.monotonically_increasing_id()))
    spelled = (
        distinct.select("gram", F.posexplode("tuple").alias("place", "id"))
        .join(dictionary.select("id", "word"), "id")
        .groupBy("gram")
        .agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"])).alias("feature"))
    )
    hashed = materialize(distinct.join(spelled.select("gram", _hash("feature", buckets)), "gram"))
    placed = tuples.join(hashed.select("tuple", "bucket"), "tuple").select("block", "place", "bucket")
    return placed, materialize(hashed.groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")))


def importance_weights(docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """:func:`_importance_weights`, with the tables written on the way deleted."""
    return settled(lambda: _importance_weights(docs, target, least, most, buckets))


def _importance_weights(docs: DataFrame, target: DataFrame, least: int, most: int, buckets: int) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of every document; ``row`` tells repeated rows apart.

    Features are all runs of ``least`` to ``most`` words, joined by a space, with repeats; a feature's bucket is the crc32 of its
    UTF-8 bytes modulo ``buckets``. A bucket with s of the documents' S features and t of the target's T gains
    floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))); a document's weight is the sum over its features.
    The gains are at most ``buckets`` rows, and are broadcast.
    """
    ours = _blocks(docs, least, most).withColumn("side", F.lit(0))
    theirs = _blocks(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), least, most).withColumn("side", F.lit(1))
    block = F.shiftleft(F.col("part").cast("long"), 32) + F.shiftleft(F.col("number").cast("long"), 1) + F.col("side")
    blocks = materialize(ours.unionByName(theirs).withColumn("block", block), LARGE_ROWS)
    features, per = count_features(blocks, least, most, buckets)
    sums = per.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("s"), F.coalesce(F.sum("t"), F.lit(0)).alias("t")).first()
    ratio = ((F.col("t") + 1) * F.lit(float(sums.s + buckets))) / ((F.col("s") + 1) * F.lit(float(sums.t + buckets)))
    gains = per.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))
    # A place and its gain, either within 32 bits, go back as one number that sorts by place.
    both = F.shiftleft(F.col("place").cast("long"), 32) + F.col("gain") + (1 << 31)
    back = features.where("block % 2 = 0").join(F.broadcast(gains), "bucket").groupBy("block").agg(F.sort_array(F.collect_list(both)).alias("both"))
    gained = back.select("block", F.transform("both", lambda x: x.bitwiseAND((1 << 32) - 1) - (1 << 31)).alias("gains"))
    priced = blocks.where("side = 0").select("block", "docs").join(gained, "block", "left")
    weight = lambda d: F.aggregate(
        F.zip_with(d["grams"], d["counts"], lambda g, n: F.get("gains", g) * n), F.lit(0).cast("long"), lambda a, x: a + x
    )
    rows = F.transform("docs", lambda d: F.struct(
        F.struct("block", d["at"].alias("at")).alias("row"), d["doc_id"].alias("doc_id"), d["n_words"].alias("n_words"),
        d["n_features"].alias("n_features"), weight(d).alias("weight"),
    ))
    return priced.select(F.inline(rows))


def resample_to_target(
    docs: DataFrame, target: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document: ``percent`` of the documents of at least ``min_words`` words
    are drawn without replacement with chances proportional to exp(weight / 1000), and ranked from 1; undrawn ones have no rank.

    score is the weight plus Gumbel noise floor(-1000 ln(-ln((h + 0.5) / 2^32))), h the first 32 bits of sha256 of
    ``seed:doc_id``; the highest scores are drawn, ties to the smaller doc_id. Ranks come from a sort by range over all tasks.

    Nulls: a null text has no words; a null doc_id hashes as an empty one and loses ties. Repeated rows are documents of their
    own with equal scores. An empty target gives all features a gain from its pseudo-counts alone. Columns other than doc_id
    and text are not read. No rows in, no rows out.
    """
    weighed = importance_weights(docs, target, least, most, buckets)
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name.cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = weighed.withColumn("score", F.col("weight") + noise).withColumn("fit", (F.col("n_words") >= min_words).cast("int"))
    order = [F.col("fit").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("row")]
    placed = ranked(scored, order, "place")
    n_fit = placed.agg(F.coalesce(F.sum("fit"), F.lit(0))).first()[0]
    drawn = (F.col("fit") == 1) & (F.col("place") <= percent * n_fit // 100)
    discard(weighed)
    return placed.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).alias("rank"))


def resampling_sql(buckets: int = 10_000, percent: int = 10, min_words: int = 20, seed: int = 2024) -> str:
    """DuckDB SQL of op11_resampling (single words): crc32 worked out byte by byte over a table made from its polynomial."""
    return rf"""
with recursive bits as (
  select i, i::bigint as v, 0 as k from range(256) t(i)
  union all select i, case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end, k + 1 from bits where k < 8
), crc_table as (
  select list(v order by i) as tab from bits where k = 8
), texts as (
  select 0 as side, doc_id, row_number() over () as r, text from documents
  union all select 1, null, row_number() over (), text from benchmark
), split as (
  select side, r, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as word
  from texts
), counted as (
  select side, r, word, count(*) as n from split group by all
), hashed as (
  select word, xor(list_reduce(
      list_prepend(4294967295::bigint, list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, (2 * i - 1)::bigint, 2))::bigint)),
      lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1])), 4294967295) % {buckets} as bucket
  from (select word, hex(encode(word)) as h from (select distinct word from counted)), crc_table
), per as (
  select bucket, sum(n) filter (side = 0) as s, sum(n) filter (side = 1) as t from counted join hashed using (word) group by bucket
), gains as (
  select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (coalesce(sum(s) over (), 0) + {buckets})::double
    / ((coalesce(s, 0) + 1)::double * (coalesce(sum(t) over (), 0) + {buckets})::double)))::bigint as gain
  from per
), weighed as (
  select r, sum(n) as n_features, sum(n * gain) as weight from counted join hashed using (word) join gains using (bucket) where side = 0 group by r
), scored as (
  select doc_id, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
    (coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{seed}:' || coalesce(doc_id::varchar, '')), 1, 8))::bigint + 0.5::double) / 4294967296::double))))::bigint as score
  from texts left join weighed using (r) where side = 0
), placed as (
  select *, row_number() over (order by n_features >= {min_words} desc, score desc, doc_id nulls last) as place, count(*) filter (n_features >= {min_words}) over () as n_fit
  from scored
)
select doc_id, n_features, weight, score, case when n_features >= {min_words} and place <= {percent} * n_fit // 100 then place end as rank
from placed"""
