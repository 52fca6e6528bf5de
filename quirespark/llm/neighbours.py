"""Nearest neighbours by a forest of projection trees behind one priority queue."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize
from .vectors import usable

FOUND = "query_id long, vec_id long, score double"


class Forest:
    """Projection trees: complete binary trees. A node's plane stands between two random groups of the sample (two
    points drawn from the node, moved to their halves' means), so that it falls into the gaps of clustered
    vectors; halves that differ too much are cut at the median instead."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.trees, self.depth, self.width = trees, depth, sample.shape[1]
        self.planes, self.cuts = [], []
        for _ in range(trees):
            node = np.zeros(len(sample), dtype=np.int64)
            planes, cuts = [], []
            for d in range(depth):
                made = [self._plane(sample[node == j], rng) for j in range(1 << d)]
                w, cut = np.array([m[0] for m in made]), np.array([m[1] for m in made])
                node = node * 2 + (np.einsum("ij,ij->i", sample, w[node]) > cut[node])
                planes.append(w)
                cuts.append(cut)
            self.planes.append(planes)
            self.cuts.append(cuts)

    def _plane(self, own: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float]:
        normal = rng.normal(size=self.width)
        if len(own) > 3:
            a, b = own[rng.choice(len(own), 2, replace=False)]
            for _ in range(4):
                left = ((own - a) ** 2).sum(axis=1) < ((own - b) ** 2).sum(axis=1)
                if left.all() or not left.any():
                    break
                a, b = own[left].mean(axis=0), own[~left].mean(axis=0)
            normal = b - a if (b - a).any() else normal
        normal = normal / np.linalg.norm(normal)
        if not len(own):
            return normal, 0.0
        p = own @ normal
        cut = float((a + b) @ normal / 2) if len(own) > 3 else float(np.median(p))
        return normal, cut if 0.2 < (p > cut).mean() < 0.8 else float(np.median(p))

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """(vector, tree) -> leaf."""
        out = np.zeros((len(x), self.trees), dtype=np.int64)
        for t in range(self.trees):
            node = np.zeros(len(x), dtype=np.int64)
            for w, cut in zip(self.planes[t], self.cuts[t], strict=True):
                node = node * 2 + (np.einsum("ij,ij->i", x, w[node]) > cut[node])
            out[:, t] = node
        return out

    def order(self, q: np.ndarray) -> Iterator[tuple[int, int]]:
        """The (tree, leaf) in the order in which one priority queue over all trees pops them for a query: nearest
        first by the sum of squared distances to the planes crossed, whatever the tree."""
        margins = [[w @ q - cut for w, cut in zip(self.planes[t], self.cuts[t], strict=True)] for t in range(self.trees)]
        queue = [(0.0, t, 0, 0) for t in range(self.trees)]
        while queue:
            cost, t, d, node = heapq.heappop(queue)
            while d < self.depth:
                m = float(margins[t][d][node])
                heapq.heappush(queue, (cost + m * m, t, d + 1, node * 2 + (m <= 0)))
                d, node = d + 1, node * 2 + (m > 0)
            yield t, node

    def visit(self, q: np.ndarray, number: int, sizes: dict[tuple[int, int], int], least: int) -> list[tuple[int, int]]:
        """The first ``number`` leaves that hold vectors; more, until those of one tree hold ``least``, or none is left."""
        out: list[tuple[int, int]] = []
        held = [0] * self.trees
        for leaf in self.order(q):
            if len(out) >= number and max(held) >= least:
                break
            if leaf in sizes:
                out.append(leaf)
                held[leaf[0]] += sizes[leaf]
        return out

    def calibrate(self, sample: np.ndarray, k: int, recall: float, asked: int = 200, queries: np.ndarray | None = None) -> int:
        """The number of leaves to visit with which a query finds the share ``recall`` of its k nearest in the sample: few
        where vectors are clustered, many where they have no structure. Queries (places in the sample) should have had no
        part in fitting the planes."""
        at = self.leaves(sample)
        squares = (sample**2).sum(axis=1)
        need: list[int] = []
        places = np.arange(len(sample)) if queries is None else queries
        for q in np.random.default_rng(5).permutation(places)[:asked]:
            d = squares - 2 * sample @ sample[q]
            d[q] = np.inf
            near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
            left = {int(i): {(t, int(at[i, t])) for t in range(self.trees)} for i in near}
            for number, leaf in enumerate(self.order(sample[q]), 1):
                hit = [i for i, homes in left.items() if leaf in homes]
                need += [number] * len(hit)
                for i in hit:
                    del left[i]
                if not left:
                    break
        return sorted(need)[min(len(need) - 1, int(recall * len(need)))] if need else 1


def scaled(x: np.ndarray) -> float:
    """What to divide vectors by before squaring, so that nothing overflows or vanishes; 1 for ordinary ones."""
    top = float(np.abs(x).max(initial=0.0))
    return 1.0 if 1e-100 < top < 1e100 else top or 1.0


def distances(base: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision."""
    gap = base - v
    by = scaled(gap)
    return np.sqrt(((gap / by) ** 2).sum(axis=1)) * by


def nearest_to(base: np.ndarray, ids: np.ndarray, leaf: np.ndarray, asked: list, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (id, vector, leaves): the k nearest of the rows of ``base`` in its leaves, by (distance, id).

    Products leaf by leaf choose; distances of those near the k-th are computed again exactly.
    """
    order = np.argsort(leaf, kind="stable")
    base, ids, leaf = base[order], ids[order], leaf[order]
    by = max(scaled(base), *(scaled(np.asarray(x[1])) for x in asked))
    small = base / by
    squares = np.einsum("ij,ij->i", small, small)
    places = {x: (np.searchsorted(leaf, x), np.searchsorted(leaf, x, side="right")) for x in np.unique(leaf).tolist()}
    for at in range(0, len(asked), 128):
        block = asked[at : at + 128]
        q = np.array([x[1] for x in block], dtype=np.float64) / by
        own = np.einsum("ij,ij->i", q, q)
        rough = np.full((len(block), len(base)), np.inf)
        visits: dict[int, list[int]] = {}
        for r, x in enumerate(block):
            for j in x[2]:
                visits.setdefault(int(j), []).append(r)
        for j, rows in visits.items():
            if j in places:
                a, b = places[j]
                rough[rows, a:b] = own[rows][:, None] + squares[a:b] - 2 * q[rows] @ small[a:b].T
        for r, (name, v, _) in enumerate(block):
            d = rough[r]
            d[ids == name] = np.inf
            near = np.flatnonzero(np.isfinite(d))
            if len(near) > k:
                slack = 1e-9 * (own[r] + squares[near].max())
                near = near[d[near] <= np.partition(d[near], k - 1)[k - 1] + slack]
            score = distances(base[near], np.asarray(v, dtype=np.float64))
            best = np.lexsort((ids[near], score))[:k]
            yield name, ids[near][best], score[best]


def _search(good: DataFrame, asked: DataFrame, total: int, width: int, k: int, trees: int, leaf: int, recall: float, sample: int, task: int) -> DataFrame:
    """FOUND rows for vectors and queries of one length."""
    spark = good.sparkSession
    by_copy = Window.partitionBy("v").orderBy("vec_id")
    first = good.distinct().withColumn("copy", F.row_number().over(by_copy)).where(F.col("copy") <= k + 1).drop("copy")
    drawn = good.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()
    x = np.array(drawn["v"].tolist(), dtype=np.float64).reshape(-1, width)
    x = np.unique(x, axis=0)
    depth = max(0, min(int(np.log2(max(1, total / leaf))), int(np.log2(max(1, len(x) / 8)))))
    by = scaled(x)
    x = np.random.default_rng(9).permutation(x)
    fitted = len(x) - len(x) // 4  # the planes see these only; the others ask
    planted = Forest(x[:fitted] / by, trees, depth)
    number = planted.calibrate(x / by, k, recall, queries=np.arange(fitted, len(x)) if fitted < len(x) else None)
    shift = max(0, depth - max(0, int(np.ceil(np.log2(max(1, total / task))))))  # leaves >> shift: units of about ``task`` rows

    def index(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            if len(df):
                at = planted.leaves(np.array(df["v"].tolist(), dtype=np.float64) / by)
                yield pd.DataFrame({"vec_id": np.repeat(df["vec_id"].to_numpy(), trees), "v": np.repeat(df["v"].to_numpy(), trees), "tree": np.tile(np.arange(trees), len(df)), "leaf": at.ravel()})

    indexed = materialize(first.mapInPandas(index, "vec_id long, v array<double>, tree int, leaf int"))
    sizes = {(r["tree"], r["leaf"]): r["n"] for r in indexed.groupBy("tree", "leaf").agg(F.count("*").alias("n")).collect()}  # a row for each leaf at most
    held: dict[tuple[int, int], int] = {}
    for (t, j), n in sizes.items():
        held[t, j >> shift] = held.get((t, j >> shift), 0) + n

    def route(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            rows = []
            for q, v in zip(df["vec_id"], df["v"], strict=True):
                units: dict[tuple[int, int], list[int]] = {}
                for t, j in planted.visit(np.asarray(v, dtype=np.float64) / by, number, sizes, k + 1):
                    units.setdefault((t, j >> shift), []).append(j)
                rows += [(q, v, t, u, leaves) for (t, u), leaves in units.items()]
            yield pd.DataFrame(rows, columns=["query_id", "v", "tree", "unit", "leaves"])

    routed = materialize(
        asked.distinct().repartition(spark.sparkContext.defaultParallelism).mapInPandas(route, "query_id long, v array<double>, tree int, unit int, leaves array<int>")
    )
    calls = {(r["tree"], r["unit"]): r["n"] for r in routed.groupBy("tree", "unit").agg(F.count("*").alias("n")).collect()}
    # Units with many rows or many queries are dealt into parts, each pair of which is a task.
    shape = spark.createDataFrame(
        [(t, u, -(-n // (4 * task)), -(-calls.get((t, u), 0) // task)) for (t, u), n in held.items() if calls.get((t, u))],
        "tree int, unit int, row_parts int, query_parts int",
    )
    unit = F.shiftright("leaf", shift).alias("unit")
    rows = indexed.select("tree", unit, "leaf", "vec_id", "v").join(F.broadcast(shape), ["tree", "unit"]).select(
        "tree", "unit", "leaf", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.col("row_parts").cast("long")).alias("rp"), F.explode(F.sequence(F.lit(0), F.col("query_parts") - 1)).alias("qp")
    )
    calling = routed.join(F.broadcast(shape), ["tree", "unit"]).select(
        "tree", "unit", "leaves", "query_id", "v", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_parts").cast("long") - 1)).alias("rp"), F.pmod(F.xxhash64("query_id"), F.col("query_parts").cast("long")).cast("int").alias("qp")
    )

    def rank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})
        base = np.array(left["v"].tolist(), dtype=np.float64)
        asked = list(zip(right["query_id"].tolist(), right["v"], right["leaves"], strict=True))
        out = [(np.full(len(i), q), i, s) for q, i, s in nearest_to(base, left["vec_id"].to_numpy(), left["leaf"].to_numpy(), asked, k)]
        q, i, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"query_id": q, "vec_id": i, "score": s})

    keys = ("tree", "unit", "rp", "qp")
    return rows.groupBy(*keys).cogroup(calling.groupBy(*keys)).applyInPandas(rank, FOUND).distinct()


def nearest_neighbours(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 10,
    trees: int = 4,
    leaf: int = 100,
    recall: float = 0.95,
    sample: int = 20_000,
    task: int = 8_000,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of vectors found for each row of queries.

    Both have vec_id and embedding; the score is the Euclidean distance in double precision and a
    query's own id is no candidate. The trees' planes are fitted on at most ``sample`` vectors (those of
    least hash); all vectors are indexed. How many leaves a query visits, taken from one priority queue over all
    trees, is calibrated on that sample, so that ``recall`` of the nearest are found: the search is short where vectors
    are clustered and long where they have no structure. Leaf candidates are ranked exactly.

    Of equal vectors only the k + 1 of least id can be answers, so only those are indexed. Leaves are searched in units
    of about ``task`` rows: a query is sent once to each unit that it visits. Vectors that are null, zero
    or have null or non-finite components and null ids take no part. Vectors of different lengths have no distance;
    each length has a forest of its own, and lengths are few. Ties go to the smaller id; a repeated row is a candidate
    once. Empty in, empty out.
    """
    spark = vectors.sparkSession
    good = usable(vectors.select("vec_id", "embedding")).where("vec_id is not null").select("vec_id", "v")
    asked = usable(queries.select("vec_id", "embedding")).where("vec_id is not null").select("vec_id", "v")
    widths = good.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).collect()
    found: DataFrame | None = None
    for r in sorted(widths, key=lambda r: r["d"]):
        same = F.size("v") == r["d"]
        part = _search(good.where(same), asked.where(same), r["n"], r["d"], k, trees, leaf, recall, sample, task)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = spark.createDataFrame([], FOUND)
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

