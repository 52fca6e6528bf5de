"""A document's markup as ordered pieces: environments open and close over a sequence of blocks.

What is open before a block follows from the block before it, so the stack needs no sequential pass: each block states
what it leaves open, and a block's events are the difference to what the last one left. Windows of one partitioning and
order find it: blocks are shuffled and sorted once, and stream through their document's task, neither an array nor a string.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import markup as K
from ..functions import text as X

FRONT = ("title", "author", "affiliation", "metadata")
VISUALS = ("figure", "table")


@dataclass(frozen=True)
class Look:
    """What of a document's measured style its markup depends on."""

    body_size: float = 8.742
    detected_size: float = 9.3
    title_size: float = 20.0
    title_centred: bool = False
    abstract: str = "bold"
    indent: float = 1.0


def _number(value: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", F.bround(value, places))


def _joined(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _front(look: Look) -> Column:
    kind, text = F.col("kind"), F.col("text")
    side = "center" if look.title_centred else "flushleft"
    size = f"\\fontsize{{{look.title_size:.2f}pt}}{{{look.title_size * 1.12:.2f}pt}}"
    title = _joined(f"\\begin{{{side}}}\n{{\\rmfamily\\color{{SourceAccent}}{size}\\selectfont ", text, f"}}\n\\end{{{side}}}\n\n\\vspace{{0.20em}}\n")
    author = _joined("\\begin{center}{\\sffamily\\small ", text, "}\\end{center}\\vspace{0.12em}\n")
    place = _joined("\\noindent{\\sffamily\\fontsize{7.4pt}{8.8pt}\\selectfont ", text, "}\\par\n")
    return F.when(kind == "title", title).when(kind == "author", author).when(kind == "affiliation", place).otherwise(_joined("\\noindent{\\sffamily\\scriptsize ", text, "}\\par\n"))


def _caption(look: Look, text: Column) -> Column:
    v = F.col("visual")
    near = (v["page"] == F.col("page")) & (F.col("y0") >= v["y0"] - 8) & (F.col("y0") - v["y1"] <= 150) & v["kind"].isin(*VISUALS)
    fits = F.coalesce(near, F.lit(False))
    ratio = F.when(fits, G.width_ratio(v["x0"], v["x1"], v["column"], v["flow_columns"])).otherwise(1.0)
    side = G.caption_alignment(F.col("x0"), F.col("x1"), F.when(fits, v["x0"]), F.when(fits, v["x1"]))
    align = F.when(side == "center", "\\centering").when(side == "right", "\\raggedleft").otherwise("\\raggedright")
    size = F.bround(G.caption_size(F.col("size"), look.body_size, look.detected_size), 2)
    font = _joined("\\fontsize{", _number(size, 2), "pt}{", _number(size * 1.18, 2), "pt}\\selectfont ")
    return _joined(
        "\\par\\vspace{0.08em}\n\\noindent\\makebox[\\linewidth][c]{%\n\\begin{minipage}{", _number(ratio, 3), "\\linewidth}\n{\\rmfamily", align, font, text,
        "\\par}\n\\end{minipage}}\n\\par\\vspace{0.32em}\n",
    )


def _body(look: Look) -> Column:
    kind, text = F.col("kind"), F.col("text")
    shown = K.styled(F.col("style"), text)
    command = {"bold": "\\textbf{", "italic": "\\textit{"}.get(look.abstract)
    abstract = shown if command is None else _joined(command, shown, "}")
    em = F.coalesce(F.col("indent"), F.lit(look.indent))
    spaced = F.when(em <= 0.12, _joined("\\noindent ", shown, "\\par\n")).otherwise(_joined("{\\setlength{\\parindent}{", _number(em, 2), "em}\\indent ", shown, "\\par}\n"))
    width = _number(G.width_ratio(F.col("x0"), F.col("x1"), F.col("column"), F.col("flow_columns")), 3)
    return (
        F.when(kind == "list_item", _joined("\\item ", X.strip_list_marker(text), "\n"))
        .when(kind.isin("equation", "table"), text)
        .when(kind == "figure", _joined("\\begin{center}\n\\includegraphics[width=", width, "\\linewidth]{\\detokenize{", text, "}}\n\\end{center}\n"))
        .when(text == "", "")
        .when(kind == "abstract", _joined("\\noindent ", abstract, "\\par\\vspace{0.48em}\n"))
        .when(kind == "section", _joined("\\SourceSection{", shown, "}\n"))
        .when(kind == "subsection", _joined("\\SourceSubsection{", shown, "}\n"))
        .when(kind == "caption", _caption(look, shown))
        .when((kind == "paragraph") & F.col("indent").isNotNull(), spaced)
        .when(kind.isin("reference", "author", "affiliation", "metadata"), _joined("\\noindent{\\small ", shown, "}\\par\n"))
        .otherwise(_joined(shown, "\\par\n"))
    )


def document_pieces(blocks: DataFrame, look: Look = Look()) -> DataFrame:
    """(doc_id, pos, part, text): the pieces of each document's body, to be read in the order of (pos, part).

    ``blocks`` has doc_id, page, pos (one of each in a document), kind, text (set already: prose escaped, tables and equations
    as markup, a figure's path), flow_columns, column, style, indent, size and x0 to y1. Part 0 closes and opens
    environments (columns, lists), part 1 is the block; at pos null, part 2 closes the document. Blocks of the front are
    set apart as long as nothing else was seen; footers go. A full-width block in columns leaves them, and so does the caption
    of a full-width visual on its page. Pieces without text are left out. A null text is empty, a null kind prose,
    null flow_columns are one. Each document with a block ends with ``\\end{document}``.
    """
    flow = F.greatest(F.lit(1), F.least(F.lit(3), F.coalesce(F.col("flow_columns").cast("int"), F.lit(1))))
    rows = blocks.select(
        "doc_id", "page", "pos", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("text", F.lit("")).alias("text"), flow.alias("flow_columns"),
        F.coalesce("column", F.lit("")).alias("column"), F.coalesce("style", F.lit("normal")).alias("style"), "indent", "size", "x0", "y0", "x1", "y1",
    )
    order = Window.partitionBy("doc_id").orderBy("pos")
    so_far, earlier = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("front", F.min(F.col("kind").isin(*FRONT)).over(so_far)).withColumn("last", F.lead(F.lit(False), 1, True).over(order))
    kind = F.col("kind")
    body = ~F.col("front") & (kind != "footer")
    resets = body & (kind.isin(*VISUALS, "list_item", "equation") | (F.col("text") != ""))
    box = F.struct("kind", "page", "column", "flow_columns", "x0", "y0", "x1", "y1")
    rows = rows.withColumn("visual", F.last(F.when(resets, box), ignorenulls=True).over(earlier))
    v = F.col("visual")
    after = (kind == "caption") & v["kind"].isin(*VISUALS) & (v["page"] == F.col("page")) & (v["column"] == "full")
    wide = ((F.col("column") == "full") & (F.col("flow_columns") > 1)) | F.coalesce(after, F.lit(False))
    rows = rows.withColumn("wide", wide).withColumn("n", F.when(F.col("wide"), 1).otherwise(F.col("flow_columns")))
    rows = rows.withColumn("open", F.struct("n", (kind == "list_item").alias("items")))
    rows = rows.withColumn("was", F.last(F.when(body, F.col("open")), ignorenulls=True).over(earlier))
    n, before, listed = F.col("n"), F.coalesce(F.col("was")["n"], F.lit(1)), F.coalesce(F.col("was")["items"], F.lit(False))
    ends = listed & ((n != before) | F.col("wide") | (kind != "list_item"))
    events = F.concat(
        F.when(ends, "\\end{itemize}\n").otherwise(""),
        F.when((n != before) & (before > 1), "\\end{multicols}\n").otherwise(""),
        F.when((n != before) & (n > 1), _joined("\\begin{multicols}{", n.cast("string"), "}\\raggedcolumns\n")).otherwise(""),
        F.when((kind == "list_item") & (~listed | ends), "\\begin{itemize}\n").otherwise(""),
    )
    piece = lambda part, text: F.struct(F.lit(part).alias("part"), text.alias("text"))
    front = F.when(F.col("text") == "", "").otherwise(_front(look))
    left = F.when(body, F.col("open")).otherwise(F.col("was"))
    tail = _joined(F.when(left["items"], "\\end{itemize}\n").otherwise(""), F.when(left["n"] > 1, "\\end{multicols}\n").otherwise(""), "\\end{document}\n")
    made = F.array(
        F.when(body, piece(0, events)), F.when(F.col("front"), piece(1, front)).when(body, piece(1, _body(look))), F.when(F.col("last"), piece(2, tail))
    )
    pieces = rows.select("doc_id", "pos", F.explode(made).alias("p")).where("p.text <> ''")
    return pieces.select("doc_id", F.when(F.col("p.part") < 2, F.col("pos")).alias("pos"), "p.part", "p.text")
