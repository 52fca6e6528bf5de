"""Blocks to TeX: placeholders put back as formulas, styles, tables, display text. All expressions stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X
from .protect import PLACEHOLDER, _joined

#: Styles and their commands, alignments and their letters.
STYLES = {"bold": "textbf", "italic": "textit", "smallcaps": "textsc"}
ALIGNMENTS = {"left": "l", "center": "c", "right": "r"}
#: Parts of font names that tell weight, slant and family.
BOLD = ("bold", "semibold", "demibold", "heavy", "black")
ITALIC = ("italic", "oblique", "slanted")
SANS = ("sans", "helvetica", "arial", "gothic", "grotesk", "univers", "futura", "calibri")
TOKEN = "[[MATH_{}]]"


def assembled(parts: Column) -> Column:
    """Parts (kind, content) as a struct of one text with numbered placeholders and the formulas by placeholder;
    blank formulas are passed over. A null array gives null."""
    before, after = TOKEN.split("{}")
    token = lambda n: F.concat(F.lit(before), n.cast("string"), F.lit(after))
    kept = F.filter(parts, lambda p: (p["kind"] == "text") | (F.trim(p["content"]) != ""))
    formulas = F.transform(F.filter(kept, lambda p: p["kind"] != "text"), lambda p: p["content"])
    start = F.struct(F.lit("").alias("t"), F.lit(0).alias("n"))

    def step(a: Column, p: Column) -> Column:
        prose = p["kind"] == "text"
        more = F.when(prose, X.clean_prose(p["content"])).otherwise(token(a["n"]))
        return F.struct(F.concat(a["t"], more).alias("t"), (a["n"] + F.when(prose, 0).otherwise(1)).alias("n"))

    text = F.trim(F.regexp_replace(F.aggregate(kept, start, step)["t"], "[ \t\r\n]+", " "))
    return F.when(parts.isNotNull(), F.struct(text.alias("text"), F.map_from_arrays(F.transform(formulas, lambda _, i: token(i)), formulas).alias("formulas")))


def rendered(text: Column, formulas: Column) -> Column:
    """Escaped text with its formulas in place; null where a placeholder has no formula."""
    clean = X.clean_prose(text)
    found = F.regexp_extract_all(clean, F.lit(f"({PLACEHOLDER})"), F.lit(0))
    gaps = F.transform(F.split(clean, PLACEHOLDER, -1), X.escape_printable)
    inline = F.transform(found, lambda p: F.concat(F.lit("\\("), F.try_element_at(formulas, p), F.lit("\\)")))
    return F.when(~F.exists(inline, lambda x: x.isNull()), _joined(gaps, inline))


def styled(style: Column, text: Column) -> Column:
    out = text
    for name, command in STYLES.items():
        out = F.when(style == name, F.concat(F.lit(f"\\{command}{{"), text, F.lit("}"))).otherwise(out)
    return out


def hex_color(value: Column) -> Column:
    """Six hexadecimal digits in upper case; a dark grey for anything else."""
    bare = F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "^#+", "")
    return F.when(bare.rlike("^[0-9A-Fa-f]{6}$"), F.upper(bare)).otherwise("333333")


def alignment_letter(alignment: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in ALIGNMENTS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(alignment)), F.lit("l"))


def span(cell: Column) -> Column:
    return F.greatest(F.lit(1), F.coalesce(cell["colspan"], F.lit(1)))


def table_width(rows: Column) -> Column:
    """Columns of a table: the largest sum of spans in a row; 0 without rows."""
    return F.coalesce(F.array_max(F.transform(rows, lambda r: F.aggregate(r["cells"], F.lit(0), lambda a, c: a + span(c)))), F.lit(0))


def table_markup(rows: Column, alignments: Column, header_rows: Column, ratio: Column) -> Column:
    """A table's TeX. Cells are (text, style, colspan, align) with rendered texts; '' without rows or columns."""
    n = table_width(rows)
    sides = F.when(F.size(alignments) == n, alignments).otherwise(F.array_repeat(F.lit("left"), n))

    def line(row: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

        def step(a: Column, c: Column) -> Column:
            text, wide = styled(c["style"], c["text"]), span(c)
            side = alignment_letter(F.coalesce(F.nullif(c["align"], F.lit("")), F.get(sides, a["at"])))
            spread = F.concat(F.lit("\\multicolumn{"), wide.cast("string"), F.lit("}{"), side, F.lit("}{"), text, F.lit("}"))
            cell = F.when(wide > 1, spread).otherwise(text)
            return F.struct((a["at"] + wide).alias("at"), F.concat(a["out"], F.array(cell)).alias("out"))

        return F.concat(F.array_join(F.aggregate(row["cells"], start, step)["out"], " & "), F.lit(" \\\\"))

    heads = F.greatest(F.lit(0), F.least(F.coalesce(header_rows, F.lit(0)), F.size(rows)))
    body = F.transform(rows, lambda r, i: F.concat(line(r), F.when(i + 1 == heads, F.lit("\n\\midrule")).otherwise("")))
    letters = F.array_join(F.transform(sides, lambda s: F.upper(alignment_letter(s))), "")
    head = F.concat(
        F.lit("\\begin{center}\n\\begin{minipage}{"), F.format_string("%.3f", F.greatest(F.lit(0.3), ratio)),
        F.lit("\\linewidth}\n\\begingroup\n\\small\n\\setlength{\\tabcolsep}{3.8pt}\n\\renewcommand{\\arraystretch}{1.12}\n\\begin{tabularx}{\\linewidth}{@{}"),
        letters, F.lit("@{}}\n\\toprule\n"),
    )
    tail = F.lit("\n\\bottomrule\n\\end{tabularx}\n\\endgroup\n\\end{minipage}\n\\end{center}\n")
    return F.when(n > 0, F.concat(head, F.array_join(body, "\n"), tail)).otherwise("")


def overfull(log: Column, least: float = 8.0, k: int = 12) -> Column:
    """The first k widths of at least ``least`` points by which lines of a typesetting log are too wide."""
    found = F.regexp_extract_all(log, F.lit(r"Overfull \\hbox \(([0-9.]+)pt too wide\)"), F.lit(1))
    return F.slice(F.filter(F.transform(found, lambda x: x.try_cast("double")), lambda x: x >= least), 1, k)


def is_bold(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(16) != 0) | X.any_of(F.lower(font), BOLD)


def is_italic(font: Column, flags: Column) -> Column:
    return (flags.bitwiseAND(2) != 0) | X.any_of(F.lower(font), ITALIC)


def family(font: Column) -> Column:
    return F.when(X.any_of(F.lower(font), SANS), "sans").otherwise("serif")


def lines_text(lines: Column) -> Column:
    """Lines of spans (arrays of strings) as text: spans joined, lines trimmed, blank ones dropped."""
    return F.array_join(F.filter(F.transform(lines, lambda s: F.trim(F.array_join(s, ""))), lambda t: t != ""), "\n")
