"""The span tree of raw pages: blocks of lines of spans, and what measured text (hints) follows from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import markup as K
from ..functions import text as X

#: Tags that end a block of text, those that hold text, the size of each, and the signs of entities.
BOUNDARIES = (
    "html", "head", "title", "style", "script", "body", "nav", "div", "article", "section", "header", "footer", "main", "aside", "ul", "ol", "table",
    "thead", "tbody", "tr", "figure", "form", "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "figcaption", "blockquote", "pre",
)
TEXT_BLOCKS = ("h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "figcaption", "blockquote", "pre")
SIZES = {"h1": 20.0, "h2": 16.0, "h3": 13.0, "h4": 11.0, "figcaption": 9.0, "td": 9.0, "th": 9.0}
BODY_SIZE = 10.0
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))

_EDGE = rf"(?i)<(/?(?:{'|'.join(BOUNDARIES)})(?:[\s/][^>]*)?>)"
_TAG = "(?i)^/?([a-z][a-z0-9]*)"
_SPAN = "text string, font string, size double, flags int"
CUT, MARK = "\u0001", "\u0002"


def _count(tags: tuple[str, ...]) -> Column:
    """1 for an opening, -1 for a closing tag of those, else 0; unclosed ones last to the end of their block."""
    step = F.when(F.col("mark").startswith("/"), -1).otherwise(1)
    return F.when(F.col("tag").isin(*tags), step).otherwise(0)


def page_spans(pages: DataFrame) -> DataFrame:
    """(page_id, block, line, span, tag, text, font, size, flags) of pages (page_id, html), one row for each span.

    A block is what follows the opening tag of a heading, paragraph, list item, cell, caption or quotation, up to the next
    tag of any block; ``br`` starts a line, any other tag a span. Flags: 16 within b, strong or th, 2 within i, em or cite.
    White space collapses to one blank; spans without a sign but blanks stay, null pages and texts outside blocks give none.
    Blocks and tags are counted with windows by block, so that neither a page nor a block is ever an array in one row.
    """
    cut = F.regexp_replace(F.translate("html", CUT + MARK, "  "), _EDGE, CUT + "$1")
    parts = pages.select("page_id", F.posexplode(F.split(cut, CUT, -1)).alias("block", "part"))
    kind = F.lower(F.regexp_extract("part", _TAG, 1))
    # the part before the first tag and those behind closing tags hold no block
    parts = parts.where((F.col("block") > 0) & ~F.col("part").startswith("/")).withColumn("kind", kind).where(F.col("kind").isin(*TEXT_BLOCKS))
    inner = F.regexp_replace("part", "^[^>]*>", "")
    marked = F.regexp_replace(F.regexp_replace(inner, "(?s)<!--.*?-->", ""), "<([^<>]*)>", f"{CUT}$1{MARK}")
    spans = parts.select("page_id", "block", "kind", F.posexplode(F.split(marked, CUT, -1)).alias("span", "s"))
    mark = F.when(F.col("span") > 0, F.substring_index("s", MARK, 1))
    text = F.when(F.col("span") > 0, F.regexp_replace("s", f"(?s)^[^{MARK}]*{MARK}", "")).otherwise(F.col("s"))
    text = F.regexp_replace(text, r"\s+", " ")
    for sign, plain in ENTITIES:
        text = F.replace(text, F.lit(sign), F.lit(plain))
    spans = spans.select("page_id", "block", "kind", "span", mark.alias("mark"), text.alias("text"))
    spans = spans.withColumn("tag", F.coalesce(F.lower(F.regexp_extract("mark", _TAG, 1)), F.lit("")))
    w = Window.partitionBy("page_id", "block").orderBy("span").rowsBetween(Window.unboundedPreceding, 0)
    bold = (F.sum(_count(("b", "strong"))).over(w) > 0) | (F.col("kind") == "th")
    italic = F.sum(_count(("i", "em", "cite"))).over(w) > 0
    typed = F.sum(_count(("code", "tt", "kbd"))).over(w) > 0
    size = F.create_map(*[F.lit(x) for kv in SIZES.items() for x in kv])[F.col("kind")]
    return spans.select(
        "page_id", "block", F.sum((F.col("tag") == "br").cast("int")).over(w).cast("int").alias("line"), "span", F.col("kind").alias("tag"), "text",
        F.when(typed, "Courier").when(F.col("kind").rlike("^h[1-6]$"), "Helvetica-Bold").otherwise("Times").alias("font"),
        F.coalesce(size, F.lit(BODY_SIZE)).alias("size"), (F.when(bold, 16).otherwise(0) + F.when(italic, 2).otherwise(0)).cast("int").alias("flags"),
    )


def span_tree(spans: DataFrame) -> DataFrame:
    """(page_id, block, tag, lines) from spans: lines is array<struct<line, x0, spans: array<struct<span, text, font, size, flags>>>>.

    Lines without a sign go, spans without one stay inside the others. x0 is a line's start in points: 36 in list items, and
    half a size for each blank before the first sign.
    """
    one = F.struct("span", "text", "font", "size", "flags")
    lines = spans.groupBy("page_id", "block", "line").agg(F.first("tag").alias("tag"), F.array_sort(F.collect_list(one)).alias("spans"))
    flat = F.array_join(F.transform("spans", lambda s: s["text"]), "")
    lead = F.length(flat) - F.length(F.ltrim(flat))
    x0 = F.when(F.col("tag") == "li", 36.0).otherwise(0.0) + lead * F.get("spans", F.lit(0))["size"] / 2
    lines = lines.where(F.trim(flat) != "").withColumn("x0", x0)
    whole = F.array_sort(F.collect_list(F.struct("line", "x0", "spans")))
    return lines.groupBy("page_id", "block").agg(F.first("tag").alias("tag"), whole.alias("lines"))


def _median(values: Column) -> Column:
    """The median of a non-empty array, the mean of the middle two for an even number."""
    n = F.size(values)
    return X.let(F.array_sort(values), lambda v: (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2)


def block_hints(tree: DataFrame) -> DataFrame:
    """(page_id, block, tag, text, font, font_size, bold_ratio, italic_ratio, paragraph_indent, first_line_indent_em) of each block.

    Spans that hold a sign weigh their length. font is that of most weight, the first seen of equals; font_size the median of
    their sizes. The indent is the first line's start against the median of the next five, in sizes: yes from 0.32, no up to
    0.16, unknown between and for one line (em null).
    """
    spans = F.filter(F.flatten(F.transform("lines", lambda x: x["spans"])), lambda s: F.trim(s["text"]) != "")
    text = F.array_join(F.transform("lines", lambda x: F.trim(F.array_join(F.transform(x["spans"], lambda s: s["text"]), ""))), "\n")
    t = tree.select("page_id", "block", "tag", F.trim(text).alias("text"), spans.alias("s"), F.transform("lines", lambda x: x["x0"]).alias("starts"))
    weight = lambda part: F.aggregate(part, F.lit(0), lambda a, s: a + F.length(s["text"]))
    share = lambda test: F.bround(weight(F.filter("s", lambda s: test(s["font"], s["flags"]))) / F.greatest(F.lit(1), F.col("weight")), 3)
    fonts = F.array_distinct(F.transform("s", lambda s: s["font"]))
    ranked = F.transform(fonts, lambda f, i: F.struct(weight(F.filter("s", lambda s: s["font"] == f)).alias("w"), (-i).alias("o"), f.alias("font")))
    t = t.withColumns({"weight": weight(F.col("s")), "size": _median(F.transform("s", lambda s: s["size"]))})
    em = (F.get("starts", F.lit(0)) - _median(F.slice("starts", 2, 5))) / F.greatest(F.lit(1.0), F.col("size"))
    t = t.withColumn("em", F.when(F.size("starts") >= 2, em))
    return t.select(
        "page_id", "block", "tag", "text", F.array_max(ranked)["font"].alias("font"), F.bround("size", 2).alias("font_size"),
        share(K.is_bold).alias("bold_ratio"), share(K.is_italic).alias("italic_ratio"),
        F.when(F.col("em") >= 0.32, "yes").when(F.col("em") <= 0.16, "no").otherwise("unknown").alias("paragraph_indent"),
        F.bround("em", 3).alias("first_line_indent_em"),
    )


def page_hints(pages: DataFrame) -> DataFrame:
    """Measured text of raw pages, by way of their span tree."""
    return block_hints(span_tree(page_spans(pages)))
