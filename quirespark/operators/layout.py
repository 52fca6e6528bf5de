"""Blocks against measured layout: spatial joins, style metrics, runs and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import markup as K
from ..functions import text as X

PAGE = ("doc_id", "page")


def overlapping(blocks: DataFrame, hints: DataFrame, how: str = "inner") -> DataFrame:
    """Pairs (b, h) on one page whose boxes overlap: an equi join with a residual condition."""
    b, h = blocks.alias("b"), hints.alias("h")
    on = [F.col(f"b.{c}") == F.col(f"h.{c}") for c in PAGE]
    near = (F.col("b.x0") < F.col("h.x1")) & (F.col("h.x0") < F.col("b.x1")) & (F.col("b.y0") < F.col("h.y1")) & (F.col("h.y0") < F.col("b.y1"))
    return b.join(h, [*on, near], how)


def scored(blocks: DataFrame, hints: DataFrame) -> DataFrame:
    a = G.overlap("b", "h")
    box = lambda t: G.area(*(F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")))
    return overlapping(blocks, hints).select(
        F.col("b.doc_id").alias("doc_id"), F.col("b.page").alias("page"), F.col("b.pos").alias("pos"), "h.hint_ord",
        F.col("h.text").alias("hint_text"), F.col("h.font").alias("font"), F.col("h.size").alias("size"), F.col("h.x0").alias("hint_x0"),
        a.alias("shared"), (a / F.greatest(F.lit(1.0), box("b"))).alias("of_block"), (a / F.greatest(F.lit(1.0), box("h"))).alias("of_hint"),
    )


def best_match(blocks: DataFrame, hints: DataFrame) -> DataFrame:
    """Each block's hint of the highest summed overlap shares; the first hint wins ties."""
    s = scored(blocks, hints)
    return s.groupBy("doc_id", "pos").agg(
        F.max_by(F.struct("hint_ord", "font", "size"), F.struct((F.col("of_block") + F.col("of_hint")).alias("s"), (-F.col("hint_ord")).alias("o"))).alias("m")
    ).select("doc_id", "pos", "m.hint_ord", "m.font", "m.size")


def strong(of_hint: float = 0.78, of_block: float = 0.48) -> Column:
    """Whether a hint and a block of :func:`scored` cover each other well."""
    return (F.col("of_hint") >= of_hint) & (F.col("of_block") >= of_block)


def unique_match(blocks: DataFrame, hints: DataFrame, of_hint: float = 0.78, of_block: float = 0.48) -> DataFrame:
    """Blocks with exactly one strong hint, and that hint."""
    return scored(blocks, hints).where(strong(of_hint, of_block)).groupBy("doc_id", "pos").agg(F.count("*").alias("n"), F.min("hint_ord").alias("hint_ord")).where("n = 1").drop("n")


def uncovered(hints: DataFrame, blocks: DataFrame, share: float = 0.42) -> DataFrame:
    """Hints that no block covers (share of the hint's area, or its centre inside)."""
    h, b = hints.alias("h"), blocks.alias("b")
    cx, cy = (F.col("h.x0") + F.col("h.x1")) / 2, (F.col("h.y0") + F.col("h.y1")) / 2
    inside = (cx >= F.col("b.x0")) & (cx <= F.col("b.x1")) & (cy >= F.col("b.y0")) & (cy <= F.col("b.y1"))
    box = G.area(*(F.col(f"h.{c}") for c in ("x0", "y0", "x1", "y1")))
    covered = (G.overlap("b", "h") >= share * box) | inside
    return h.join(b, [*[F.col(f"h.{c}") == F.col(f"b.{c}") for c in PAGE], covered], "left_anti")


def largest(k: int) -> Column:
    """The numbers of a block's hints of :func:`scored` with the k largest overlaps, largest first."""
    return F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("a"), F.col("hint_ord").alias("o")))), 1, k), lambda x: x["o"])


def top_text(blocks: DataFrame, hints: DataFrame, k: int = 4) -> DataFrame:
    """The texts of each block's k largest overlaps, largest first, joined by blanks."""
    ranked = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("a"), F.col("hint_ord").alias("o"), F.col("hint_text").alias("t")))), 1, k)
    return scored(blocks, hints).groupBy("doc_id", "pos").agg(F.array_join(F.transform(ranked, lambda x: x["t"]), " ").alias("texts"))


def font_mode(hints: DataFrame) -> DataFrame:
    """Each document's font of most characters; the first seen wins ties."""
    by = hints.groupBy("doc_id", "font").agg(F.sum(F.length("text")).alias("n"), F.min("hint_ord").alias("o"))
    return by.groupBy("doc_id").agg(F.max_by("font", F.struct("n", -F.col("o"))).alias("font"))


def nearest_rank(values: Column, q: float) -> Column:
    """The value at half-even rounded (n-1)q of the sorted values."""
    s = F.sort_array(F.collect_list(values))
    return F.element_at(s, (F.bround((F.count(values) - 1) * q) + 1).cast("int"))


def body_size(hints: DataFrame) -> DataFrame:
    """Median size weighted by up to 30 characters for each hint, of sizes 6 to 13.5, clamped to 8..11; 9.4 without any."""
    ok = F.col("size").between(6.0, 13.5) & (F.length("text") > 0)
    m = F.percentile(F.when(ok, F.col("size")), F.lit(0.5), F.when(ok, F.least(F.lit(30), F.length("text"))).otherwise(1))
    return hints.groupBy("doc_id").agg(F.coalesce(G.clamp(m, 8, 11), F.lit(9.4)).alias("body_size"))


def context(blocks: DataFrame) -> DataFrame:
    """Each block's neighbours' text on its page, and whether sentences run across."""
    w = Window.partitionBy(*PAGE).orderBy("pos")
    seen = X.context_text(F.col("kind"), F.col("text"))
    usable = F.when(~F.col("kind").isin("footer", "figure", "table") & (seen != ""), F.struct(seen.alias("t"), F.col("kind").alias("k")))
    prev = F.last(usable, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    nxt = F.first(usable, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    both = blocks.withColumns({"p": prev, "n": nxt})
    pc = F.coalesce(F.right("p.t", F.lit(260)), F.lit(""))
    return both.select(
        "doc_id", "pos", pc.alias("previous_context"), F.coalesce(F.left("n.t", F.lit(260)), F.lit("")).alias("next_context"),
        (F.col("p").isNotNull() & F.coalesce((F.col("p.k") == "equation") | ~X.ends_sentence(pc), F.lit(False))).alias("continues_from_previous"),
        (F.col("n").isNotNull() & F.coalesce((F.col("n.k") == "equation") | ~X.ends_sentence(F.col("text")), F.lit(False))).alias("continues_to_next"),
    )


def captions(blocks: DataFrame) -> DataFrame:
    """Captions with the visual just before them, its fit, and how the caption is set."""
    shown = blocks.where("kind not in ('footer', 'title', 'author', 'affiliation', 'metadata') and (text <> '' or kind in ('figure', 'table'))")
    w = Window.partitionBy("doc_id").orderBy("pos")
    before = F.lag(F.struct("kind", "page", "x0", "y0", "x1", "y1")).over(w)
    c = shown.withColumn("v", before).where("kind = 'caption'").withColumn("v", F.when(F.col("v.kind").isin("figure", "table"), F.col("v")))
    fits = (F.col("page") == F.col("v.page")) & (F.col("y0") >= F.col("v.y0") - 8) & (F.col("y0") - F.col("v.y1") <= 150)
    return c.select(
        "doc_id", "pos", F.col("v.kind").alias("visual"), F.coalesce(fits, F.lit(False)).alias("bound"),
        G.caption_alignment(F.col("x0"), F.col("x1"), F.col("v.x0"), F.col("v.x1")).alias("alignment"),
    )


def runs(blocks: DataFrame, value: Column) -> DataFrame:
    """Maximal runs of equal values in block order (gaps and islands)."""
    w = Window.partitionBy("doc_id").orderBy("pos")
    v = blocks.withColumn("v", value)
    v = v.withColumn("new", (~F.col("v").eqNullSafe(F.lag("v").over(w))).cast("int")).withColumn("run", F.sum("new").over(w))
    return v.groupBy("doc_id", "run").agg(F.first("v").alias("value"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n"))


def insert_by_geometry(blocks: DataFrame, extra: DataFrame, columns: int | DataFrame = 2, share: float | None = None) -> DataFrame:
    """Place on its page of every block (origin 0) and of every extra row (origin 1) that reading order lacks.

    Extra rows come in order of their number. Each goes before the first block of its column that starts
    lower, else after the last one of its column, else to the end; full-width rows and pages of one column
    take all blocks as theirs. ``columns`` is a number for all pages, or a table (doc_id, page, columns); pages that it
    lacks have one. Rows inserted count as blocks for those after them. With ``share``, a row that one inserted before it
    covers (that share of its area, or its centre) stays out. A page is one group, folded in the JVM.
    """
    box = ("x0", "x1", "y0") if share is None else ("x0", "x1", "y0", "y1")
    row = lambda o, n: F.struct(F.lit(o).alias("origin"), F.col(n).cast("long").alias("num"), *[F.col(c).cast("double").alias(c) for c in box])
    every = blocks.select(*PAGE, row(0, "pos").alias("r")).unionByName(extra.select(*PAGE, row(1, "hint_ord").alias("r")))
    pages = every.groupBy(*PAGE).agg(F.array_sort(F.collect_list("r")).alias("rs"))
    if isinstance(columns, DataFrame):
        pages = pages.join(columns.select(*PAGE, "columns"), list(PAGE), "left").withColumn("columns", F.coalesce("columns", F.lit(1)))
    else:
        pages = pages.withColumn("columns", F.lit(columns))
    sided = F.transform("rs", lambda r: r.withField("side", G.column_of(r["x0"], r["x1"], F.col("columns"))))
    pages = pages.withColumn("rs", sided)

    def put(page: Column, new: Column) -> Column:
        own = lambda r: (F.col("columns") <= 1) | (new["side"] == "full") | (r["side"] == new["side"])
        lower = F.array_position(F.transform(page, lambda r: own(r) & (r["y0"] > new["y0"])), F.lit(True))
        from_end = F.array_position(F.reverse(F.transform(page, own)), F.lit(True))
        n = F.size(page)
        before = F.when(lower > 0, lower - 1).when(from_end > 0, n + 1 - from_end).otherwise(n).cast("int")
        put_in = F.concat(F.slice(page, F.lit(1), before), F.array(new), F.slice(page, before + 1, n))
        return put_in if share is None else F.when(F.exists(page, lambda r: (r["origin"] == 1) & covers(r, new)), page).otherwise(put_in)

    def covers(r: Column, new: Column) -> Column:
        w, h = F.least(r["x1"], new["x1"]) - F.greatest(r["x0"], new["x0"]), F.least(r["y1"], new["y1"]) - F.greatest(r["y0"], new["y0"])
        centre = ((new["x0"] + new["x1"]) / 2).between(r["x0"], r["x1"]) & ((new["y0"] + new["y1"]) / 2).between(r["y0"], r["y1"])
        return (F.greatest(F.lit(0.0), w) * F.greatest(F.lit(0.0), h) >= share * G.area(*(new[c] for c in ("x0", "y0", "x1", "y1")))) | centre

    part = lambda o: F.filter("rs", lambda r: r["origin"] == o)
    placed = pages.select(*PAGE, F.posexplode(F.aggregate(part(1), part(0), put)).alias("place", "r"))
    return placed.select(*PAGE, "place", "r.origin", "r.num")


def measured_style(blocks: DataFrame, hints: DataFrame) -> DataFrame:
    """(doc_id, page, pos, style, size, family, em) of each block that hints overlap.

    style is bold, italic or normal where area-weighted shares of bold and italic characters say so (areas clamped to
    1..50000), null between; size (5 to 36) and family are those of the best hint; em is the first-line indent of a
    paragraph, by its best hint whose layout tells one. One spatial join.
    """
    near = overlapping(blocks, hints)
    box = lambda t: G.area(*(F.col(f"{t}.{c}") for c in ("x0", "y0", "x1", "y1")))
    shared = G.overlap("b", "h")
    fit = shared / F.greatest(F.lit(1.0), box("b")) + shared / F.greatest(F.lit(1.0), box("h"))
    rows = near.select(
        *[F.col(f"b.{c}").alias(c) for c in (*PAGE, "pos", "kind")], "h.hint_ord", "h.font", "h.size", "h.bold_ratio", "h.italic_ratio", "h.em",
        F.greatest(F.lit(1.0), F.least(F.lit(50_000.0), shared)).alias("w"), fit.alias("fit"),
    )
    told = (F.col("em") >= 0.32) | (F.col("em") <= 0.16)
    best = F.struct("fit", (-F.col("hint_ord")).alias("o"))
    got = rows.groupBy(*PAGE, "pos", "kind").agg(
        F.bround(F.sum(F.col("w") * F.col("bold_ratio")) / F.sum("w"), 6).alias("bold"),
        F.bround(F.sum(F.col("w") * F.col("italic_ratio")) / F.sum("w"), 6).alias("italic"),
        F.max_by(F.struct("font", "size"), best).alias("m"),
        F.max_by("em", F.when(told, best)).alias("em"),
    )
    prose = ~F.col("kind").isin("equation", "figure", "table", "footer")
    style = F.when(F.col("bold") >= 0.62, "bold").when(F.col("italic") >= 0.62, "italic").when((F.col("bold") <= 0.18) & (F.col("italic") <= 0.18), "normal")
    decision = F.when(F.col("em") >= 0.32, "yes").when(F.col("em") <= 0.16, "no")
    return got.select(
        *PAGE, "pos", F.when(prose, style).alias("style"), F.when(prose & F.col("m.size").between(5.0, 36.0), F.bround("m.size", 2)).alias("size"),
        F.when(prose, K.family(F.col("m.font"))).alias("family"), F.when(F.col("kind") == "paragraph", G.paragraph_indent(decision, F.col("em"))).alias("em"),
    )


def figure_sources(visuals: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page, image, coverage, image_coverage, source) of each visual (with chars and drawings) that images overlap:
    the image that covers most of it, then the one most covered, then the first; and what the visual is taken from."""
    best = scored(visuals, images).groupBy("doc_id", "page", "pos").agg(
        F.max_by(
            F.struct(F.col("hint_ord").alias("image"), F.bround("of_block", 6).alias("coverage"), F.bround("of_hint", 6).alias("image_coverage")),
            F.struct(F.bround("of_block", 6).alias("a"), F.bround("of_hint", 6).alias("b"), (-F.col("hint_ord")).alias("c")),
        ).alias("m")
    )
    full = best.join(visuals.select("doc_id", "pos", "chars", "drawings"), ["doc_id", "pos"])
    return full.select("doc_id", "page", "m.image", "m.coverage", "m.image_coverage", G.figure_source(F.col("m.coverage"), F.col("chars"), F.col("drawings")).alias("source"))


def pair_gap(hints: DataFrame) -> DataFrame:
    """Each page's gap between two columns of long narrow hints, kept between 5 and 200 (else null)."""
    long = (F.length("text") >= 40) & (F.col("x1") - F.col("x0") < 600)
    gap = F.min(F.when(long & (F.col("x0") > 350), F.col("x0"))) - F.max(F.when(long & (F.col("x0") < 350), F.col("x1")))
    return hints.groupBy(*PAGE).agg(gap.alias("gap")).withColumn("gap", F.when((F.col("gap") > 5) & (F.col("gap") < 200), F.col("gap")))


def majority(values: Column, choices: tuple[int, ...] = (1, 2, 3)) -> Column:
    """The choice seen most often; the first of them on a tie, and if none is seen."""
    counts = [F.struct(F.count_if(values == c).alias("n"), F.lit(-i).alias("o"), F.lit(c).alias("c")) for i, c in enumerate(choices)]
    return F.greatest(*counts)["c"]
