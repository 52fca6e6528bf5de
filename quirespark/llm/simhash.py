"""SimHash fingerprints and their near duplicates by a Gray-ordered hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialize, ranked, settled, sliced
from .components import connected_components

U64 = np.uint64


def fingerprint(text: str | None, words: int = 3) -> int:
    """64-bit SimHash of a text's shingles: a bit is set if it is set in over half of their hashes."""
    import xxhash

    parts = (text or "").encode("utf-8", "replace").lower().split()  # bytes: ASCII case and white space only
    n = len(parts)
    if not n:
        return 0
    joined = b" ".join(parts)
    h = xxhash.xxh64_intdigest
    if n <= words:
        return h(joined, 42)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = np.concatenate(([0], ends[:-1]))[: n - words + 1].tolist()
    stops = (ends[words - 1 :] - 1).tolist()
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(starts), 100_000):
        part = zip(starts[at : at + 100_000], stops[at : at + 100_000], strict=True)
        by_byte = np.array([h(joined[a:b], 42) for a, b in part], dtype=U64).view(np.uint8).reshape(-1, 8)
        for k in range(8):
            ones[8 * k : 8 * k + 8] += np.bincount(by_byte[:, k], minlength=256) @ _BITS
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > len(starts)).tolist()))


_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1


def add_fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, digest, fp): fp is the fingerprint as a signed long; null, empty and blank texts get 0. digest names
    the row by id and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = np.array([fingerprint(t, words) for t in batch.column(1).to_pylist()], dtype=U64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(got.view(np.int64))], names=["doc_id", "digest", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text", _row_key().alias("digest")).mapInArrow(run, f"doc_id {kind}, digest string, fp long")


def gray_rank(fps: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence (its prefix parity)."""
    out = fps.copy()
    for s in (1, 2, 4, 8, 16, 32):
        out ^= out >> U64(s)
    return out


class GrayIndex:
    """Fingerprints in Gray order under nodes that hold the bits all their members share.

    A node is (mask, value): the shared bits and what they are. Neighbours in Gray order share long
    patterns, so masks stay wide for several levels. A search goes down by pairs of nodes and carries
    their differences along: each level adds those in the bits that become shared there, and a pair that differs in
    more than ``radius`` places is dropped with all below it.
    """

    STEP = 2048  # pairs of nodes taken down together: at most 2048 * fanout^2 pairs are held at a time

    def __init__(self, fps: np.ndarray, fanout: int = 16):
        self.order = np.argsort(gray_rank(fps), kind="stable")
        self.fps = fps[self.order]
        self.fanout = fanout
        mask, value = np.full(len(fps), U64(0xFFFFFFFFFFFFFFFF)), self.fps
        self.levels = [(mask, value)]
        while len(mask) > 1:
            begins = np.arange(0, len(mask), fanout)
            ones = np.bitwise_and.reduceat(mask & value, begins)
            zeros = np.bitwise_and.reduceat(mask & ~value, begins)
            mask, value = ones | zeros, ones
            self.levels.append((mask, value))

    def pairs(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions (i < j in Gray order) of all pairs at most ``radius`` bits apart."""
        found = [*self.near(self, radius), (np.zeros(0, dtype=np.int64),) * 2]
        return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])

    def near(self, other: GrayIndex, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Positions (i here, j in ``other``; i < j if that is this index) of all pairs at most ``radius`` bits apart, in parts."""
        height = max(len(self.levels), len(other.levels)) - 1
        mine, theirs = (x.levels + [x.levels[-1]] * (height + 1 - len(x.levels)) for x in (self, other))
        zero = np.zeros(1, dtype=np.int64)
        todo = [(height, zero, zero, *_apart(mine[-1], theirs[-1], zero, zero, np.zeros(1, dtype=U64), zero))]
        if todo[0][-1][0] > radius:
            return
        while todo:
            # known: the bits that the two nodes of a pair both share, those already compared; apart: in how many of them they differ
            level, a, b, known, apart = todo.pop()
            if level == 0:
                ok = a < b if other is self else slice(None)
                yield a[ok], b[ok]
                continue
            level -= 1
            a, b, above = self._children(a, b, len(mine[level][0]), len(theirs[level][0]), other is self)
            known, apart = _apart(mine[level], theirs[level], a, b, known[above], apart[above])
            ok = np.flatnonzero(apart <= radius)
            for at in range(0, len(ok), self.STEP):
                part = ok[at : at + self.STEP]
                todo.append((level, a[part], b[part], known[part], apart[part]))

    def links(self, other: GrayIndex, radius: int, at_once: int = 1 << 20) -> list[tuple[int, int]]:
        """Pairs of codes that connect what all pairs within ``radius`` connect: a spanning forest of the links."""
        both, shift = (self.fps, 0) if other is self else (np.concatenate([self.fps, other.fps]), len(self.fps))
        held, n = [], 0
        for i, j in self.near(other, radius):
            held.append((i, j + shift))
            n += len(i)
            if n > at_once:
                held = forest(*_ends(held), len(both))
                n = len(held)
        return [(both[x], both[y]) for x, y in forest(*_ends(held), len(both))]

    def _children(self, a: np.ndarray, b: np.ndarray, n: int, m: int, once: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pairs of children of pairs of nodes (each once, within one index), and the pair above each."""
        f = np.arange(self.fanout)
        x = (a[:, None] * self.fanout + f)[:, :, None]
        y = (b[:, None] * self.fanout + f)[:, None, :]
        ok = (x < n) & (y < m)
        if once:
            ok &= x <= y
        return np.broadcast_to(x, ok.shape)[ok], np.broadcast_to(y, ok.shape)[ok], np.nonzero(ok)[0]


def _apart(mine: tuple, theirs: tuple, a: np.ndarray, b: np.ndarray, known: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits shared by both nodes of each pair, and the differences so far with those in bits not compared before."""
    both = mine[0][a] & theirs[0][b]
    return both, apart + np.bitwise_count((mine[1][a] ^ theirs[1][b]) & both & ~known)


def _ends(links: list) -> tuple[np.ndarray, np.ndarray]:
    """The two sides of links, given as pairs of numbers or of arrays."""
    none = np.zeros(0, dtype=np.int64)
    return tuple(np.concatenate([none, *(np.atleast_1d(x[k]) for x in links)]) for k in (0, 1))


def forest(i: np.ndarray, j: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges (root, node) that connect what the links (i, j) connect."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, root[i], low)
        np.minimum.at(new, root[j], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    at = np.flatnonzero(root != np.arange(n))
    return list(zip(root[at].tolist(), at.tolist(), strict=True))


def _gray_order(df: DataFrame) -> DataFrame:
    """df with ``rank``: the place of fp in the reflected Gray sequence, as a signed long of the same order."""
    out = df.withColumn("rank", F.col("fp"))
    for s in (1, 2, 4, 8, 16, 32):
        out = out.withColumn("rank", F.col("rank").bitwiseXOR(F.shiftrightunsigned("rank", s)))
    return out.withColumn("rank", F.col("rank").bitwiseXOR(F.lit(-(1 << 63))))


def gray_levels(fps: DataFrame, size: int = 1024, fanout: int = 16) -> list[DataFrame]:
    """The upper nodes of one index over all different fingerprints (column fp), lowest level first, each a written table.

    Codes are sorted by Gray rank over all tasks and cut into groups of ``size``, so groups are even however codes lie.
    A level holds (node, parent, mask, value): the bits that all codes below a node share, and what they are; the lowest
    also ``codes``, its group's. ``fanout`` neighbours have one parent; the last level is one node. No rows, no levels.
    """
    placed = ranked(_gray_order(fps.select("fp")), ["rank"], "place")
    count = -(-placed._quire_rows // size)
    ones, zeros = F.bit_and("value").alias("ones"), F.bit_and(F.col("mask").bitwiseAND(F.bitwise_not("value"))).alias("zeros")
    below = placed.select(F.expr(f"(place - 1) div {size}").alias("node"), F.lit(-1).cast("long").alias("mask"), F.col("fp").alias("value"))
    levels = []
    while count:
        more = [] if levels else [F.collect_list("value").alias("codes")]
        nodes = below.groupBy("node").agg(ones, zeros, *more).select(
            "node", F.expr(f"node div {fanout}").alias("parent"), F.col("ones").bitwiseOR(F.col("zeros")).alias("mask"),
            F.col("ones").alias("value"), *(["codes"] if more else []),
        )
        levels.append(materialize(nodes))
        below = levels[-1].select(F.col("parent").alias("node"), "mask", "value")
        count = 0 if count == 1 else -(-count // fanout)
    return levels


def near_groups(levels: list[DataFrame], radius: int) -> DataFrame:
    """(a, b, known, apart, mask, value): pairs a <= b of lowest nodes that the levels above cannot tell apart, with the bits both
    share, in how many they differ (``radius`` at most), and a's own bits.

    From the top, each pair of nodes is replaced by the pairs of their children: two joins by parent a level. Differences
    accumulate: a level adds those in the bits that became shared there, and a pair beyond ``radius`` goes with all below.
    """
    spark = levels[0].sparkSession
    pairs = spark.createDataFrame([(0, 0, 0, 0)], "a long, b long, known long, apart int")
    for nodes in levels[::-1]:
        x = nodes.select(F.col("parent").alias("a"), F.col("node").alias("x"), "mask", "value")
        y = nodes.select(F.col("parent").alias("b"), F.col("node").alias("y"), F.col("mask").alias("mask_y"), F.col("value").alias("value_y"))
        both = F.col("mask").bitwiseAND(F.col("mask_y"))
        new = F.col("value").bitwiseXOR(F.col("value_y")).bitwiseAND(both).bitwiseAND(F.bitwise_not("known"))
        pairs = (
            pairs.select("a", "b", "known", "apart").join(x, "a").join(y, "b").where("x <= y")
            .select(F.col("x").alias("a"), F.col("y").alias("b"), both.alias("known"), (F.col("apart") + F.bit_count(new)).alias("apart"), "mask", "value")
            .where(F.col("apart") <= radius)
        )
    return pairs


def fingerprint_edges(fps: DataFrame, radius: int = 2, size: int = 1024) -> DataFrame:
    """(a, b): links that connect all different fingerprints (column fp) at most ``radius`` bits apart.

    One Gray-ordered index over all codes decides: its upper nodes, in tables, prune pairs of groups (:func:`near_groups`);
    what is left of a pair, the codes of b that a's shared bits allow, meets a's codes in a task, where the search goes on
    through the lower nodes of both. Every group holds ``size`` codes at most, so a task's work on a pair is bounded; of
    its links a spanning forest goes on. Pruning is by bits known to differ, so no link is lost.
    """
    spark = fps.sparkSession
    levels = gray_levels(fps, size)
    if not levels:
        return spark.createDataFrame([], "a long, b long")
    codes = levels[0].select("node", "codes")
    allowed = F.filter("codes", lambda c: F.bit_count(c.bitwiseXOR(F.col("value")).bitwiseAND(F.col("mask"))) <= radius)
    spread = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = (
        near_groups(levels, radius).select("a", "b", "mask", "value").repartition(spread, "a", "b")
        .join(codes.withColumnRenamed("node", "b"), "b").select("a", "b", allowed.alias("theirs")).where("size(theirs) > 0")
        .join(codes.withColumnRenamed("node", "a"), "a").select("a", "b", F.col("codes").alias("mine"), "theirs")
    )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, index = None, None
        for batch in sliced(batches, 100):
            found: list[tuple[int, int]] = []
            for a, b, mine, theirs in zip(*(batch.column(k) for k in range(4)), strict=True):
                if a != last:
                    last, index = a, GrayIndex(_codes(mine))
                found += index.links(index if a == b else GrayIndex(_codes(theirs)), radius)
            got = np.array(found, dtype=U64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(got[:, 0].copy()), pa.array(got[:, 1].copy())], names=["a", "b"])

    return met.mapInArrow(search, "a long, b long").distinct()


def _codes(cell: pa.Scalar) -> np.ndarray:
    return np.asarray(cell.values).view(U64)


def _classes(marked: DataFrame, radius: int) -> DataFrame:
    """(fp, component, component_id) for each fingerprint: component is its smallest fingerprint in signed order."""
    nodes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = settled(lambda: connected_components(fingerprint_edges(nodes, radius)))
    named = nodes.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp")
    )
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    return named.join(names, "component").select("fp", "component", "component_id")


def simhash_components(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs (doc_id, text).

    component_id is the smallest doc_id reachable over links of at most ``radius`` differing bits.
    Equal fingerprints are one node, whatever the number of copies, so groups of copies are never
    expanded; texts without words have fingerprint zero and link like any other. A null doc_id keeps
    its row and never names a component unless all ids of the component are null. Repeated rows are
    kept; other columns are ignored; empty in, empty out.
    """
    marked = materialize(add_fingerprints(docs, words).drop("digest"))
    return marked.join(_classes(marked, radius).drop("component"), "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def _row_key() -> Column:
    """Names a row by its id and its text, for a join in which neither has to be sent along."""
    part = [F.coalesce(x, F.lit("null")) for x in (F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary")))]
    return F.concat_ws("#", *part)


def keep_representatives(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """One row of docs (doc_id, text, ...) for each component of :func:`simhash_components`, all columns kept.

    The row of the smallest doc_id stays (null ids last), of several texts under that id the one of least md5, of rows that agree in
    both the least in the other columns. Components are found by fingerprints, so two that share a doc_id
    by chance each keep a row. Texts are sent once: keys of kept rows meet the rows, and rows that agree in the key
    are already together. Empty in, empty out.
    """
    marked = materialize(add_fingerprints(docs, words))
    best = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("digest")))
    kept = marked.join(_classes(marked, radius), "fp").groupBy("component").agg(best.alias("best"))
    kept = materialize(kept.select(F.col("best.digest").alias("row_key")).distinct())
    found = docs.withColumn("row_key", _row_key()).join(kept, "row_key", "left_semi")
    return found.groupBy("row_key").agg(F.min(F.struct(*[F.col(c) for c in docs.columns])).alias("row")).select("row.*")
