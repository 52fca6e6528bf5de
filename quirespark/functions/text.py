"""Text rules as Column expressions; all stay in the JVM."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Single characters and their TeX escapes.
TEX_ESCAPES = {
    "\\": r"\textbackslash{}", "&": r"\&", "%": r"\%", "$": r"\$", "#": r"\#", "_": r"\_", "{": r"\{", "}": r"\}",
    "~": r"\textasciitilde{}", "^": r"\textasciicircum{}",
}
#: Lower-case letters that case folding changes further.
FOLDS = {"ß": "ss", "ς": "σ", "ſ": "s", "ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
#: Substrings (lower case) of messages that stand for a passing fault.
TRANSIENT = (
    "transient_gemini_error:", "transient_google_translate_error:", "cloud translation api http 429",
    "cloud translation api http 500", "cloud translation api http 502", "cloud translation api http 503",
    "cloud translation api http 504", "temporarily unavailable", "high demand", "resource_exhausted", "quota exceeded",
    "all configured vision models", "all configured translation models",
)
#: Marks of a daily quota, in text stripped to a-z and 0-9.
DAILY = ("generaterequestsperday", "requestsperday", "perdayperprojectpermodel", "perdayperproject", "requestsperdayperproject")
#: Marks of a request whose format was refused.
FORMAT_400 = ("response_format", "responseformat", "mime_type", "mimetype", "responsemimetype", "responsejsonschema", "invalid_argument")
#: Strings that a translation must not hold.
FORBIDDEN = ("§math{", "§mathcal", "§gamma", "§rho", "§Pi", "§Sigma", "\\math{", "�", "￾", "￿")
#: Characters that count as mathematics, and font names that do.
MATH_CHARS = "=+-−×÷*/^_{}[]()<>|∫∑∏√∞≤≥≠≈∼⊗⊕⊙∂∇†‡→←↔⇒⇔"
MATH_FONTS = ("math", "cmmi", "cmsy", "cmex", "msam", "msbm", "symbol", "stmary", "wasy", "eufm", "eufb", "rsfs", "txsy", "pxsy")


def any_of(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for m in marks:
        out = out | F.contains(text, F.lit(m))
    return out


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition, by Arrow batch: Spark has no expression for it. Nulls stay null."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def composed(text: Column) -> Column:
    """NFC of a text; texts of Latin-1 and common punctuation only are so already and take no normalisation."""
    return F.when(text.rlike("[^\\x{00}-\\x{FF}\\x{2010}-\\x{2027}]"), nfc(text)).otherwise(text)


def printable(text: Column) -> Column:
    """NFC without control, format, private or unassigned characters, but for line ends and tabs."""
    return F.regexp_replace(composed(text), r"[\p{C}&&[^\n\t]]", "")


def clean_prose(text: Column) -> Column:
    """Line ends, tabs and no-break spaces to blanks; other control characters and soft hyphens dropped;
    blanks collapsed; ends kept. Text is taken as composed; :func:`composed` makes it so."""
    spaced = F.regexp_replace(text, r"[\n\t\r\x{A0}]", " ")
    return F.regexp_replace(F.regexp_replace(spaced, r"\p{C}", ""), r" +", " ")


#: Unicode's white space.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def stripped(text: Column) -> Column:
    """A text without white space at its ends, in one pass over them."""
    return F.btrim(text, F.lit(WHITE))


def sanitised(text: Column) -> Column:
    """A provider's text as it is kept: composed, clean, without white space at its ends; null is empty."""
    return F.regexp_replace(clean_prose(composed(F.coalesce(text, F.lit("")))), r"(?U)^\s+|\s+$", "")


def shortened(error: Column, message: Column, stage: Column) -> tuple[Column, Column, Column]:
    """An error's last 6000 characters, a message's first 500, a stage's first 80: what a job row holds of them."""
    return F.right(error, F.lit(6000)), F.left(message, F.lit(500)), F.left(stage, F.lit(80))


def letters(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}]", ""))


def latin(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", ""))


def hangul(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^가-힣]", ""))


def alnum(text: Column) -> Column:
    return F.length(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def ends_sentence(text: Column) -> Column:
    return text.rlike(r"[.!?。！？]\s*$")


def context_text(kind: Column, text: Column) -> Column:
    """What a neighbour sees of a block: its trimmed text, or a mark with the start of an equation, if it has a formula."""
    flat = stripped(F.coalesce(text, F.lit("")))
    shown = F.when(flat == "", "[DISPLAY EQUATION]").otherwise(F.concat(F.lit("[DISPLAY EQUATION: "), F.left(flat, F.lit(260)), F.lit("]")))
    return F.when(kind == "equation", shown).otherwise(flat)


def folded(text: Column) -> Column:
    """Case folding for comparison: lower case, with the letters of FOLDS spelt out."""
    out = F.lower(text)
    for letter, spelt in FOLDS.items():
        out = F.replace(out, F.lit(letter), F.lit(spelt))
    return out


def signature(kind: Column, text: Column) -> Column:
    """Case-folded words with single blanks, then without marks; empty for equations, figures and tables. Blanks beside
    a mark that goes stay, so two may follow each other."""
    flat = F.trim(F.regexp_replace(folded(text), r"(?U)\s+", " "))
    plain = F.trim(F.regexp_replace(flat, r"[^\p{L}\p{N}_\s]", ""))
    return F.when(kind.isin("equation", "figure", "table"), "").otherwise(plain)


def blank(text: Column) -> Column:
    """Whether a text is null, empty or white space."""
    return F.coalesce(text, F.lit("")).rlike(r"(?U)^\s*$")


def escape_tex(text: Column) -> Column:
    """The printable text, escaped."""
    return escape_printable(printable(text))


def escape_printable(text: Column) -> Column:
    """All special characters mapped at once: those whose escape holds special characters become noncharacters first (a
    printable text has none), so no escape is escaped again."""
    long = [c for c, e in TEX_ESCAPES.items() if len(e) > 2]
    marks = [chr(0xFDD0 + i) for i in range(len(long))]
    short = "".join("\\" + c for c, e in TEX_ESCAPES.items() if len(e) == 2)
    out = F.regexp_replace(F.translate(text, "".join(long), "".join(marks)), f"([{short}])", r"\\$1")
    for c, mark in zip(long, marks, strict=True):
        out = F.replace(out, F.lit(mark), F.lit(TEX_ESCAPES[c]))
    return out


def strip_list_marker(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s*(?:(?:[•◦▪‣●○◆■□✓✔➢➤]\s*)|(?:[-–—*+]\s+))+", "")


def equation_number(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.trim(text), r"^\(\s*([^()]*)\s*\)$", "$1"))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often it is named."""
    return F.get(F.transform(F.array(value), lambda x: then(x)), F.lit(0))


def is_footer(text: Column, y0: Column) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return let(flat, lambda t: (t == "") | F.lower(t).rlike(r"^(page\s*)?[0-9]+$") | ((y0 >= 955) & (F.length(t) <= 140)))


def likely_math(text: Column, font: Column) -> Column:
    named = F.lower(font).rlike("|".join(MATH_FONTS))
    signs = lambda c: F.length(c) - F.length(F.translate(c, MATH_CHARS, ""))
    few = lambda c, n: let(letters(c), lambda abc: ((n >= 3) & (abc <= 45)) | (c.rlike("[=∫∑]") & (abc <= 90)))
    many = lambda c, n: (n >= 5) & (n / F.greatest(F.lit(1), F.length(c)) >= 0.075)
    rest = lambda n: let(F.regexp_replace(text, r"\s", ""), lambda c: many(c, n) | few(c, n))
    found = let(signs(text), lambda n: F.when(n < 2, False).otherwise(rest(n)))  # no sign is white space
    return (text != "") & F.when(named, True).otherwise(found)


def prose_candidate(text: Column, font: Column, y0: Column) -> Column:
    """No footer, not likely mathematics, and eight letters at least: more than a page's number has, so of the footers only short
    texts at the foot are left."""
    foot = (y0 >= 955) & (F.length(F.trim(F.regexp_replace(text, r"\s+", " "))) <= 140)
    return text.rlike(r"(?:\p{L}\P{L}*+){8}") & ~foot & ~likely_math(text, font)


def quality_reason(source: Column, out: Column, language: str) -> Column:
    """The first rule that a translation breaks, or null."""
    reason = F.when(any_of(out, FORBIDDEN), "marker")
    if language == "ko":
        untranslated = (
            (latin(source) >= 60) & (F.length(out) >= 80) & (latin(out) >= 45)
            & (hangul(out) < F.greatest(F.lit(8), F.floor(latin(out) * 0.18)))
        )
        reason = reason.when(out.rlike(r"([가-힣]\s+){5,}[가-힣]"), "spaced").when(untranslated, "untranslated")
    return reason


def placeholders(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(\[\[MATH_[0-9]+\]\])"))


def implausible(source: Column, out: Column) -> Column:
    """Whether an output of ``out`` characters is too long for a source of ``source``."""
    return (source >= 3) & (out > F.greatest(2.4 * source, source + 12))


def retry_delay(text: Column, default: float = 60.0) -> Column:
    patterns = (r"(?i)retry\s+in\s+([0-9]+(?:\.[0-9]+)?)s", r'(?i)"retryDelay"\s*:\s*"([0-9]+(?:\.[0-9]+)?)s"', r'(?i)"retry_after"\s*:\s*([0-9]+(?:\.[0-9]+)?)')
    found = [F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("double") for p in patterns]
    return F.greatest(F.lit(1.0), F.coalesce(*found, F.lit(default)))


def passing_fault(message: Column) -> Column:
    """Whether a message tells of a fault that may pass, so that its job is tried again: quotas by the day among them."""
    return any_of(F.lower(F.coalesce(message, F.lit(""))), TRANSIENT)


def error_class(message: Column) -> Column:
    low = F.lower(message)
    return (
        F.when(any_of(F.regexp_replace(low, "[^a-z0-9]+", ""), DAILY), "daily_quota")
        .when(any_of(low, FORMAT_400), "format")
        .when(any_of(low, TRANSIENT), "transient")
        .otherwise("other")
    )


def elapsed(ms: Column) -> Column:
    s = F.greatest(F.lit(0), F.floor(ms / 1000))
    m, r = F.floor(s / 60), s % 60
    return F.when(m > 0, F.concat(m.cast("string"), F.lit("분 "), F.lpad(r.cast("string"), 2, "0"), F.lit("초"))).otherwise(
        F.concat(r.cast("string"), F.lit("초"))
    )
