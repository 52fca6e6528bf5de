"""Placeholder integrity, translation quality, resume and deduplication."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import formula as M
from ..functions import text as X
from .providers import Identity, Provider, translate

KEYS = ("doc_id", "page")


def checked(items: DataFrame, language: str = "en") -> DataFrame:
    """One reason for each item: empty (also null and blank), then placeholders (as multisets), then quality; null if good."""
    both = F.struct(F.sort_array(X.placeholders(F.col("source"))).alias("a"), F.sort_array(X.placeholders(F.col("translated"))).alias("b"))
    reason = F.when(X.blank(F.col("translated")), "empty").when(X.let(both, lambda p: p["a"] != p["b"]), "placeholders")
    return items.withColumn("reason", F.coalesce(reason, X.quality_reason(F.col("source"), F.col("translated"), language)))


def pending(items: DataFrame, done: DataFrame) -> DataFrame:
    """Items without a good stored result: what a resumed run still has to do."""
    return items.join(done, ["doc_id", "pos"], "left_anti")


def dedup_exact(blocks: DataFrame, least: int = 18) -> DataFrame:
    """Of blocks of one page with equal signatures of at least ``least`` characters, the first."""
    sig = X.signature(F.col("kind"), F.col("text"))
    key = F.when(F.length(sig) >= least, sig).otherwise(F.concat(F.lit("#"), F.col("pos").cast("string")))
    return blocks.groupBy("doc_id", "page", key.alias("sig")).agg(F.min("pos").alias("pos"), F.count("*").alias("copies")).select("doc_id", "page", "pos", "copies")


def error_rows(items: DataFrame) -> DataFrame:
    """The faults of each result, a row for each: none, one (an empty result has no other) or two (placeholders that
    differ as multisets, then marks of the formula transport)."""
    a, b = F.sort_array(X.placeholders(F.col("source"))), F.sort_array(X.placeholders(F.col("translated")))
    listed = lambda x: F.concat(F.lit("["), F.array_join(F.transform(x, lambda t: F.concat(F.lit("'"), t, F.lit("'"))), ", "), F.lit("]"))
    out = F.coalesce("translated", F.lit(""))
    changed = F.concat(F.lit("placeholders changed expected="), listed(a), F.lit(" actual="), listed(b))
    marks = M.transport_mark(out) | out.contains("\\math{")
    found = F.when(out == "", F.array(F.lit("empty translation"))).otherwise(
        F.filter(F.array(F.when(a != b, changed), F.when(marks, "internal math transport marker")), lambda x: x.isNotNull())
    )
    return items.select("doc_id", "pos", "item_id", F.explode(found).alias("error"))


def merged(items: DataFrame, stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Results (doc_id, pos, translated) of all items: fresh ones win over stored ones; null where neither has any."""
    keys = ["doc_id", "pos"]
    new = fresh.select(*keys, F.col("translated").alias("new"))
    old = stored.select(*keys, F.col("translated").alias("old"))
    return items.join(new, keys, "left").join(old, keys, "left").withColumn("translated", F.coalesce("new", "old")).drop("new", "old")


def resumed(items: DataFrame, stored: DataFrame, providers: Sequence[Provider] = (Identity(),), language: str = "en") -> DataFrame:
    """(doc_id, pos, translated, again) of all items (doc_id, pos, item_id, source): a stored result that still passes
    stays; all others go to the providers again; what comes back is merged, new before old. ``again``: the item was made anew."""
    keys = ["doc_id", "pos"]
    held = checked(items.join(stored.select(*keys, "translated"), keys), language)
    good = held.where("reason is null").select(*keys, "translated")
    fresh = translate(pending(items, good), providers).where("reason is null").select(*keys, "translated")
    out = merged(items, good, fresh).join(good.select(*keys, F.lit(True).alias("kept")), keys, "left")
    return out.select(*keys, "translated", F.col("kept").isNull().alias("again"))


def missing(results: DataFrame, k: int = 12) -> DataFrame:
    """The first k items of each document without a result: none for a document that is complete."""
    left = results.where(X.blank(F.col("translated")))
    return left.groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("item_id")), 1, k), ",").alias("missing"))


def same_pages(got: DataFrame, expected: DataFrame) -> DataFrame:
    """(doc_id, whole): whether a document's rows in both tables (doc_id, page) lie on the same pages."""
    a = got.select("doc_id", "page").distinct().withColumn("in_got", F.lit(True))
    b = expected.select("doc_id", "page").distinct().withColumn("in_expected", F.lit(True))
    both = a.join(b, ["doc_id", "page"], "full")
    return both.groupBy("doc_id").agg(F.bool_and(F.col("in_got").isNotNull() & F.col("in_expected").isNotNull()).alias("whole"))




def by_page(rows: DataFrame) -> DataFrame:
    """rows by (doc_id, page), in order of pos, with ``at``, their places from 1 on the page. A window asks for rows in that order;
    unlike repartition(), it moves none that lie by page already."""
    return rows.withColumn("at", F.row_number().over(Window.partitionBy(*KEYS).orderBy("pos")))


def dedup_similar(blocks: DataFrame, ratio: float = 0.92, least: int = 18, shared: float = 0.28, inside: int = 30, content: Sequence[str] = (), most: Sequence[str] = (), ordered: bool = False) -> DataFrame:
    """(doc_id, page, pos, text_of, *content): the blocks kept of each page, and the block whose content stands there.

    In order, a block whose signature has ``least`` characters joins the first kept block with the same signature, or
    with a box that shares ``shared`` of the smaller of both and a similar text: a difflib ratio (the later block's
    signature first) of at least ``ratio``, or one signature within the other if both have ``inside`` characters. Of the
    two, an anchored block's content stays (column anchored, if there is one), else the longer text's, else the
    first's; its columns ``content`` come along. For columns ``most`` among them, ``most_`` and the name is the greatest value
    of the page's kept blocks. A page is one group; ``ordered`` blocks are those of :func:`by_page` with no more done to them
    than what goes row by row.
    """
    from difflib import SequenceMatcher

    def alike(a: str, b: str) -> bool:
        if min(len(a), len(b)) >= inside and (a in b or b in a):
            return True
        m = SequenceMatcher(None, a, b)
        return m.real_quick_ratio() >= ratio and m.quick_ratio() >= ratio and m.ratio() >= ratio  # bounds from above first

    def over(p: dict, q: dict) -> bool:
        if any(x[c] is None for x in (p, q) for c in ("x0", "y0", "x1", "y1")):
            return False
        size = lambda x: max(0.0, (x["x1"] - x["x0"]) * (x["y1"] - x["y0"]))
        area = max(0.0, min(p["x1"], q["x1"]) - max(p["x0"], q["x0"])) * max(0.0, min(p["y1"], q["y1"]) - max(p["y0"], q["y0"]))
        return area / max(1.0, min(size(p), size(q))) >= shared

    def page(rows: list[dict]) -> list[list]:
        kept: list[list] = []  # place, the row whose content stands there
        for row in rows:
            fits = lambda k, row=row: len(k[1]["sig"]) >= least and (k[1]["sig"] == row["sig"] or (over(row, k[1]) and alike(row["sig"], k[1]["sig"])))
            match = next(filter(fits, kept), None) if len(row["sig"]) >= least else None
            if match is None:
                kept.append([row["pos"], row])
            elif (row["anchored"], len(row["sig"])) > (match[1]["anchored"], len(match[1]["sig"])):
                match[1] = row
        return kept

    def pages(batches: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The kept rows of whole pages; columns that nothing here asks for are taken by place, without a look into them."""
        table = pa.Table.from_batches(batches).combine_chunks()
        rows = table.select([*KEYS, "pos", "sig", "anchored", "x0", "y0", "x1", "y1", *[f"of_{c}" for c in most]]).to_pylist()
        kept: list[list] = []
        tops: list[list] = []
        for _, same in groupby(enumerate(rows), lambda x: (x[1]["doc_id"], x[1]["page"])):
            stay = page([row | {"row": i} for i, row in same])
            kept += stay
            tops += [[max((r[f"of_{c}"] for _, r in stay if r[f"of_{c}"] is not None), default=None) for c in most]] * len(stay)
        taken = table.take(pa.array([r["row"] for _, r in kept], pa.int64()))
        columns = [*(taken[c] for c in KEYS), pa.array([at for at, _ in kept], pa.int32()), taken["pos"], *(taken[f"of_{c}"] for c in content), *(pa.array(x) for x in zip(*tops, strict=True))]
        yield from pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # the rows of the page that may go on in the next batch
        last = None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in KEYS), strict=True))
            if not keys:
                continue
            cut = next((i + 1 for i in reversed(range(len(keys))) if keys[i] != keys[-1]), 0)
            if cut:
                yield from pages([*held, batch.slice(0, cut)])
            elif held and last != keys[0]:
                yield from pages(held)
            held = [batch.slice(cut)] if cut or last != keys[0] else [*held, batch]
            last = keys[-1]
        if held:
            yield from pages(held)

    anchored = F.col("anchored") if "anchored" in blocks.columns else F.lit(False)
    placed = blocks if ordered else by_page(blocks)
    sig = X.signature(F.col("kind"), F.col("text")).alias("sig")
    rows = placed.select("doc_id", "page", "at", F.col("pos").cast("int").alias("pos"), sig, anchored.alias("anchored"), "x0", "y0", "x1", "y1", *[F.col(c).alias(f"of_{c}") for c in content])
    kinds = dict(blocks.dtypes)
    names = ", ".join([f"doc_id {kinds['doc_id']}, page {kinds['page']}, pos int, text_of int", *(f"{c} {kinds[c]}" for c in content), *(f"most_{c} {kinds[c]}" for c in most)])
    schema = to_arrow_schema(StructType.fromDDL(names))
    return rows.mapInArrow(run, names)
