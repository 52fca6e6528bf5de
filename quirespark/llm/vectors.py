"""Embedding near duplicates: robust-pruned graphs on overlapping shards, searched in bounded cells, with audited recall."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, settled
from .components import connected_components
from .simhash import forest


def usable(vectors: DataFrame) -> DataFrame:
    """Rows whose embedding is not null, not zero and has finite components only, as array<double>."""
    v = F.col("embedding").cast("array<double>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    return vectors.withColumn("v", v).where(F.col("embedding").isNotNull() & ~bad & some)


def centres_of(unit: np.ndarray, k: int, seed: int = 7, rounds: int = 8) -> np.ndarray:
    """k-means centres of unit vectors."""
    centres = unit[np.random.default_rng(seed).choice(len(unit), k, replace=False)]
    for _ in range(rounds if k > 1 else 0):
        near = (unit @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.maximum(size, 1e-12), centres)
    return centres


def homes(unit: np.ndarray, centres: np.ndarray, margin: float) -> np.ndarray:
    """(vector, centre): whether the centre is the nearest, or the border to its region is within ``margin``."""
    sims = unit @ centres.T
    best = sims.argmax(axis=1)
    apart = np.sqrt(np.maximum(2 - 2 * (centres @ centres.T), 1e-12))[best]
    out = sims.max(axis=1, keepdims=True) - sims <= margin * apart
    out[np.arange(len(unit)), best] = True
    return out


def robust_prune(near: np.ndarray, sim: np.ndarray, unit: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Vamana's rule for many nodes at once: of a node's candidates (a row of ``near``, -1 where empty, nearest first,
    with their ``sim``) keep the nearest and drop those that are ``alpha`` times nearer to it than to the node; go on
    until ``degree`` are kept. Returns which are kept."""
    vec = unit[near]
    between = np.sqrt(np.maximum(0, 2 - 2 * np.matmul(vec, vec.transpose(0, 2, 1)))) * alpha
    dist = np.sqrt(np.maximum(0, 2 - 2 * sim))
    alive = near >= 0
    kept = np.zeros(near.shape, dtype=bool)
    left = np.full(len(near), degree)
    for c in range(near.shape[1]):
        now = alive[:, c] & (left > 0)
        kept[:, c] = now
        left -= now
        alive &= ~now[:, None] | (between[:, c] > dist)
    return kept


def padded(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Adjacency (node, width) of the edges i -> j, sorted by i; -1 where empty."""
    count = np.bincount(i, minlength=n)
    out = np.full((n, max(1, int(count.max(initial=0)))), -1, dtype=np.int64)
    out[i, np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)] = j
    return out


def build_graph(unit: np.ndarray, degree: int = 16, candidates: int = 40, alpha: float = 1.2) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) of one shard: each node's nearest candidates and some random ones, robust-pruned, with edges
    back, pruned again where a list overflows."""
    n = len(unit)
    rng = np.random.default_rng(n)
    width = min(candidates, n - 1)
    if not width:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)

    def pruned(rows: np.ndarray, near: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        sim = np.where(near >= 0, np.einsum("nd,ncd->nc", unit[rows], unit[near]), -4.0)
        order = np.argsort(-sim, axis=1, kind="stable")
        near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
        kept = robust_prune(near, sim, unit, alpha, most)
        r, c = np.nonzero(kept)
        return rows[r], near[r, c]

    edges = []
    for at in range(0, n, 256):
        rows = np.arange(at, min(at + 256, n))
        sims = unit[rows] @ unit.T
        sims[np.arange(len(rows)), rows] = -2
        near = np.argpartition(-sims, width - 1, axis=1)[:, :width]
        far = rng.integers(0, n, (len(rows), 8))
        far[(far == rows[:, None]) | (far[:, :, None] == near[:, None]).any(axis=2)] = -1
        edges.append(pruned(rows, np.concatenate((near, far), axis=1), degree))
    i, j = (np.concatenate(x) for x in zip(*edges, strict=True))
    both = np.unique(np.concatenate((i * n + j, j * n + i)))
    i, j = both // n, both % n
    full = np.flatnonzero(np.bincount(i, minlength=n) > 2 * degree)
    if len(full):
        calm = ~np.isin(i, full)
        again = [pruned(rows, padded(*_own(i, j, rows), len(rows)), 2 * degree) for rows in np.array_split(full, -(-len(full) // 64))]
        i, j = (np.concatenate([x, *y]) for x, y in zip((i[calm], j[calm]), zip(*again, strict=True), strict=True))
    return i, j


def _own(i: np.ndarray, j: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = np.isin(i, rows)
    return np.searchsorted(rows, i[own]), j[own]


def cell_graph(unit: np.ndarray, per_shard: int, overlap: int) -> tuple[np.ndarray, np.ndarray]:
    """Adjacency and entry medoids of one cell: its vectors join their ``overlap`` nearest cluster shards, each shard
    builds a graph, and the lists of a vector are united."""
    n = len(unit)
    k = max(1, -(-n // per_shard))
    centres = centres_of(unit, min(k, n))
    near = np.argsort(-(unit @ centres.T), axis=1, kind="stable")[:, :overlap]
    pairs, entries = [], []
    for shard in range(len(centres)):
        own = np.flatnonzero((near == shard).any(axis=1))
        if len(own):
            i, j = build_graph(unit[own])
            pairs.append(own[i] * n + own[j])
            entries.append(own[(unit[own] @ unit[own].sum(axis=0)).argmax()])
    both = np.unique(np.concatenate(pairs))
    return padded(both // n, both % n, n), np.unique(entries)


def range_search(
    unit: np.ndarray, adjacency: np.ndarray, entries: np.ndarray, queries: np.ndarray, least: float, beam: int = 12
) -> Iterator[tuple[int, np.ndarray]]:
    """For each query node (a row of ``unit``): the nodes found with cosine >= ``least``, itself included.

    Greedy search with a beam from the entry medoids first; then all that is in range, the query's own node
    included, is expanded until nothing new in range appears. Queries advance together in blocks; adjacency is
    (node, width), -1 where empty.
    """
    n = len(unit)
    for at in range(0, len(queries), 256):
        block = queries[at : at + 256]
        q = unit[block]
        sims = np.full((len(block), n), -3.0, dtype=np.float64)  # -3: not seen yet
        done = np.zeros((len(block), n), dtype=bool)
        sims[:, entries] = q @ unit[entries].T
        sims[np.arange(len(block)), block] = 1.0

        def expand(rows: np.ndarray, nodes: np.ndarray, sims: np.ndarray = sims, done: np.ndarray = done, q: np.ndarray = q) -> None:
            done[rows, nodes] = True
            nbr = adjacency[nodes]
            r = np.repeat(rows, nbr.shape[1])
            c = nbr.ravel()
            ok = c >= 0
            r, c = r[ok], c[ok]
            new = sims[r, c] == -3.0
            r, c = r[new], c[new]
            for s in range(0, len(r), 65_536):
                x, y = r[s : s + 65_536], c[s : s + 65_536]
                sims[x, y] = np.einsum("ij,ij->i", q[x], unit[y])

        width = min(beam, n)
        active = np.arange(len(block))
        while len(active):
            best = np.argpartition(-sims[active], width - 1, axis=1)[:, :width]
            value = np.take_along_axis(sims[active], best, 1)
            value = np.where(np.take_along_axis(done[active], best, 1) | (value == -3.0), -9.0, value)
            pick = np.argsort(-value, axis=1)[:, :4]
            chosen = np.take_along_axis(best, pick, 1)
            ok = np.take_along_axis(value, pick, 1) > -9.0
            rows = np.repeat(active, pick.shape[1])[ok.ravel()]
            expand(rows, chosen.ravel()[ok.ravel()])
            active = active[ok.any(axis=1)]
        while True:
            rows, nodes = np.nonzero((sims >= least) & ~done)
            if not len(rows):
                break
            expand(rows, nodes)
        for r, i in enumerate(block):
            yield int(i), np.flatnonzero(sims[r] >= least)


def split_into_cells(vectors: DataFrame, cell: int, margin: float, fan: int = 32, sample: int = 4_000, task: int = 50_000) -> DataFrame:
    """(node, weight, u, cell) from vectors (node, weight, u, grp): the groups, split until no cell holds more than ``cell``.

    Cells above that bound are split again and again, each by at most ``fan`` centres fitted in one task on about ``sample`` of
    its vectors (those of least hash); a vector joins each part whose border is within ``margin``. So centres number
    as many as the data need, none of them passes through the driver, and a task assigns at most about ``task``
    vectors of a cell. A cell of which one part would hold over 0.8 is too dense to split; its name ends in "!".
    """
    rows = vectors.select("node", "weight", "u", F.col("grp").alias("cell"))
    first = True
    while True:
        sizes = rows.groupBy("cell").agg(F.count("*").alias("n")).where((F.col("n") > cell) & ~F.col("cell").endswith("!"))
        sizes = materialize(sizes)
        if sizes.isEmpty():
            return rows
        spread = F.pmod(F.xxhash64("node", F.lit(5)), F.lit(1 << 30)) < F.lit(float(sample << 30)) / F.col("n")
        large = rows.join(sizes, "cell")

        def fit(df: pd.DataFrame) -> pd.DataFrame:
            unit = np.array(df["u"].tolist(), dtype=np.float64)
            n = int(df["n"].iloc[0])
            k = max(2, min(fan, -(-2 * n // cell), len(unit) // 4))
            centres = centres_of(unit, k) if len(unit) > 8 else unit[:1]
            if homes(unit, centres, margin).mean(axis=0).max() > 0.8:
                centres = centres[:1]
            return pd.DataFrame({"cell": df["cell"].iloc[:1], "centres": [list(centres.ravel())], "n": [n]})

        def assign(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"node": [], "weight": [], "u": [], "cell": []})
            unit = np.array(left["u"].tolist(), dtype=np.float64)
            centres = np.array(right["centres"].iloc[0], dtype=np.float64).reshape(-1, unit.shape[1])
            i, c = np.nonzero(homes(unit, centres, margin))
            names = [f"{left['cell'].iloc[0]}/{x}" for x in range(len(centres))] if len(centres) > 1 else [f"{left['cell'].iloc[0]}!"]
            own = left.iloc[i]
            return pd.DataFrame({"node": own["node"].to_numpy(), "weight": own["weight"].to_numpy(), "u": own["u"].to_numpy(), "cell": [names[x] for x in c]})

        fitted = large.where(spread).groupBy("cell").applyInPandas(fit, "cell string, centres array<double>, n long")
        lots = F.ceil(F.col("n") / task).cast("int")
        dealt = large.withColumn("lot", F.pmod(F.xxhash64("node"), lots).cast("int")).groupBy("cell", "lot")
        shown = fitted.withColumn("lot", F.explode(F.sequence(F.lit(0), lots - 1))).groupBy("cell", "lot")
        parts = dealt.cogroup(shown).applyInPandas(assign, "node long, weight long, u array<double>, cell string")
        after = materialize(rows.join(sizes, "cell", "left_anti").select("node", "weight", "u", "cell").unionByName(parts))
        if not first:
            discard(rows)
        rows, first = after, False


def _report(node: np.ndarray, count: np.ndarray, edges: list[tuple[int, int]]) -> pd.DataFrame:
    some = count > 0
    a = [*node[some].tolist(), *(int(node[i]) for i, _ in edges)]
    b = pd.array([*[None] * int(some.sum()), *(int(node[j]) for _, j in edges)], dtype="Int64")
    return pd.DataFrame({"a": a, "b": b, "links": [*count[some].tolist(), *[0] * len(edges)]})


def _earlier(cells: list, here: str) -> np.ndarray:
    """(vector, cell) bitmap of memberships in cells before ``here``."""
    lists = [[x for x in c if x < here] if c is not None else [] for c in cells]
    names = {x: k for k, x in enumerate(sorted({x for c in lists for x in c}))}
    out = np.zeros((len(cells), max(1, len(names))), dtype=bool)
    for i, c in enumerate(lists):
        for x in c:
            out[i, names[x]] = True
    return out


def embedding_links(
    vectors: DataFrame,
    least: float = 0.93,
    per_shard: int = 500,
    overlap: int = 2,
    cell: int = 6_000,
    margin: float = 0.06,
    beam: int = 12,
) -> DataFrame:
    """(a, b, links): rows with null b count the links of a; the others are edges that connect what links connect.

    vectors has node (long), grp (string), u (unit array<double>) and weight (copies of that vector), all different within a
    group. Groups are split into overlapping cells of at most ``cell`` vectors (:func:`split_into_cells`). In each
    cell, one task, vectors join their ``overlap`` nearest cluster shards; each shard builds a robust-pruned graph; lists
    are united; each member searches the united graph by range from the medoids. A pair is counted in the first cell
    that both have, so nothing counts twice. A cell too dense to split is dealt by hash into parts, and each pair of parts
    is a task that compares exactly in blocks: there, links themselves grow with the square of the cell.
    """
    placed = split_into_cells(vectors, cell, margin)
    shared = placed.groupBy("node").agg(F.collect_set("cell").alias("cells")).where(F.size("cells") > 1)
    placed = placed.join(shared, "node", "left")
    out = "a long, b long, links long"

    def search(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("node", kind="stable")
        node, weight = df["node"].to_numpy(), df["weight"].to_numpy()
        unit = np.array(df["u"].tolist(), dtype=np.float64)
        adjacency, entries = cell_graph(unit, per_shard, overlap)
        earlier = _earlier(df["cells"].tolist(), df["cell"].iloc[0])
        count = np.zeros(len(node), dtype=np.int64)
        edge_i: list[np.ndarray] = []
        edge_j: list[np.ndarray] = []
        for i, found in range_search(unit, adjacency, entries, np.arange(len(node)), least - 1e-9, beam):
            found = found[(unit[found] @ unit[i] >= least) & (found != i)]
            new = found[~(earlier[found] & earlier[i]).any(axis=1)]
            count[i] += weight[new].sum()
            edge_i.append(np.full(len(found), i))
            edge_j.append(found)
        links = forest(np.concatenate(edge_i), np.concatenate(edge_j), len(node)) if edge_i else []
        return _report(node, count, links)

    def exact(df: pd.DataFrame) -> pd.DataFrame:
        df = df.sort_values("node", kind="stable")
        node, weight, part = df["node"].to_numpy(), df["weight"].to_numpy(), df["part"].to_numpy()
        unit = np.array(df["u"].tolist(), dtype=np.float64)
        earlier = _earlier(df["cells"].tolist(), df["cell"].iloc[0])
        pa_, pb_ = (int(x) for x in df["pair"].iloc[0].split(","))
        rows, columns = np.flatnonzero(part == pa_), np.flatnonzero(part == pb_)
        count = np.zeros(len(node), dtype=np.int64)
        root = np.arange(len(node))
        for at in range(0, len(rows), 512):
            r = rows[at : at + 512]
            hit = unit[r] @ unit[columns].T >= least
            x, y = np.nonzero(hit)
            x, y = r[x], columns[y]
            other = x != y
            x, y = x[other], y[other]
            new = ~(earlier[x] & earlier[y]).any(axis=1)
            np.add.at(count, x[new], weight[y[new]])
            if pa_ != pb_:
                np.add.at(count, y[new], weight[x[new]])
            for i, j in forest(np.append(x, root), np.append(y, np.arange(len(root))), len(node)):
                root[j] = i
        return _report(node, count, forest(root, np.arange(len(root)), len(node)))

    calm = placed.where(~F.col("cell").endswith("!")).groupBy("cell").applyInPandas(search, out)
    dense = placed.where(F.col("cell").endswith("!"))
    sizes = dense.groupBy("cell").agg(F.ceil(F.count("*") / cell).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda p: F.concat_ws(",", F.least(p, F.col("part")).cast("string"), F.greatest(p, F.col("part")).cast("string")),
    )
    crowded = (
        dense.join(sizes, "cell").withColumn("part", part).withColumn("pair", F.explode(pairs))
        .groupBy("cell", "pair")
        .applyInPandas(exact, out)
    )
    return materialize(calm.unionByName(crowded))


def audit(classes: DataFrame, counts: DataFrame, least: float, bound: int = 512) -> tuple[int, int]:
    """(links found, links there are) of at most ``bound`` vectors, those of least hash: their exact links are counted in
    one pass of blocked products over all vectors."""
    drawn = classes.orderBy(F.xxhash64("node", F.lit(3)), "node").limit(bound).select("node", "grp", "u").toPandas()
    asked = {g: (own["node"].to_numpy(), np.array(own["u"].tolist(), dtype=np.float64)) for g, own in drawn.groupby("grp")}

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, int] = {}
        for df in frames:
            for g, own in df.groupby("grp", sort=False):
                if g in asked:
                    node, unit = asked[g]
                    hit = np.array(own["u"].tolist(), dtype=np.float64) @ unit.T >= least
                    hit &= own["node"].to_numpy()[:, None] != node
                    for x, n in zip(node.tolist(), (hit * own["weight"].to_numpy()[:, None]).sum(axis=0).tolist(), strict=True):
                        total[x] = total.get(x, 0) + n
        yield pd.DataFrame({"node": list(total), "links": list(total.values())})

    there = classes.select("node", "grp", "weight", "u").mapInPandas(count, "node long, links long").agg(F.sum("links")).first()[0]
    found = counts.where(F.col("node").isin(drawn["node"].tolist())).agg(F.sum("links")).first()[0] if len(drawn) else 0
    return int(found or 0), int(there or 0)


def near_duplicate_vectors(vectors: DataFrame, least: float = 0.93, recall: float = 0.97, rounds: int = 3, **search: float) -> DataFrame:
    """(vec_id, n_links, component_id, kept, audited_recall) for every row of vectors (vec_id, embedding, label).

    Vectors link if their labels are equal, their lengths too, and their cosine in double precision is at least
    ``least``; every link found is verified so. Equal vectors of a label are searched as one and counted as many: copies
    link with each other and share all links. The search is audited on a bounded sample (:func:`audit`); below ``recall``
    it is repeated with wider margins and beams, at most ``rounds`` times in all, and the last audit is reported.
    Rows with null label, or a vector that is null, zero or has null or non-finite
    components, have no links and are their own component; so is a row with a null vec_id, which is not
    searched. Repeated ids are rows of their own. Empty in, empty out; other columns are ignored.
    """
    rows = vectors.select("vec_id", "embedding", "label")
    good = usable(rows).where("label is not null and vec_id is not null")
    classes = good.groupBy("label", "v").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("weight"))
    grp = F.concat_ws("#", F.col("label").cast("string"), F.size("v").cast("string"))
    by = lambda v, x: F.zip_with(v, F.array_repeat(x, F.size(v)), lambda a, b: a / b)  # noqa: E731 (x is made once)
    # Divided by the largest component first, so that squares neither overflow nor vanish.
    classes = classes.withColumn("u", by(F.col("v"), F.array_max(F.transform("v", F.abs))))
    classes = classes.withColumn("u", by(F.col("u"), F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, x: a + x * x))))
    # Numbers given to rows of a written table stay theirs.
    classes = materialize(classes.withColumns({"node": F.monotonically_increasing_id(), "grp": grp}))
    margin, beam = search.pop("margin", 0.06), int(search.pop("beam", 12))
    for turn in range(rounds):
        both = embedding_links(classes, least, margin=margin, beam=beam, **search)
        counts = both.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("links").alias("links"))
        found, there = audit(classes, counts, least)
        if found >= recall * there or turn == rounds - 1:
            break
        margin, beam = margin * 2, beam * 3
        discard(both)
    parts = settled(lambda: connected_components(both.where("b is not null").select("a", "b")))
    named = classes.join(counts, "node", "left").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least_id").alias("component_id"))
    named = named.join(names, "component").select(
        "label", "v", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id"
    )
    key = rows.withColumn("v", F.col("embedding").cast("array<double>"))
    # -0.0 and 0.0 are one value to grouping and joining alike.
    return key.join(named, ["label", "v"], "left").select(
        "vec_id",
        F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"),
        F.when(F.col("vec_id").isNull(), F.col("vec_id")).otherwise(F.coalesce("component_id", "vec_id")).alias("component_id"),
        F.coalesce(F.col("vec_id") == F.coalesce("component_id", "vec_id"), F.lit(True)).alias("kept"),
        F.lit(found / there if there else 1.0).alias("audited_recall"),
    )
