"""Queries on the structure of texts: spans of raw pages, checked formulas, documents as markup; each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import validate as C
from ..operators import flow
from ..sources import entities as E
from ..sources import spans as S
from .registry import SQL, register


def _listed(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _entities(sql: str) -> str:
    for sign, plain in S.ENTITIES:
        sql = f"""replace({sql}, '{sign}', '{plain.replace("'", "''")}')"""
    return sql


def _depth(tags: str) -> str:
    return f"sum(CASE WHEN tag IN ({tags}) THEN CASE WHEN starts_with(mark, '/') THEN -1 ELSE 1 END ELSE 0 END) OVER w"


_SPANS_SQL = rf"""parts AS (
  SELECT page_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS block
  FROM (SELECT page_id, string_split(regexp_replace(translate(html, chr(1) || chr(2), '  '), '(?i)<(/?(?:{"|".join(S.BOUNDARIES)})(?:[\s/][^>]*)?>)', chr(1) || '\1', 'g'), chr(1)) AS p FROM pages)
), texts AS (
  SELECT page_id, block, lower(regexp_extract(part, '^([a-zA-Z0-9]+)', 1)) AS kind,
    string_split(regexp_replace(regexp_replace(regexp_replace(part, '^[^>]*>', ''), '(?s)<!--.*?-->', '', 'g'), '<([^<>]*)>', chr(1) || '\1' || chr(2), 'g'), chr(1)) AS p
  FROM parts WHERE block > 0 AND NOT starts_with(part, '/')
), cut AS (
  SELECT page_id, block, kind, unnest(p) AS s, generate_subscripts(p, 1) - 1 AS span FROM texts WHERE kind IN ({_listed(S.TEXT_BLOCKS)})
), marked AS (
  SELECT page_id, block, kind, span, CASE WHEN span > 0 THEN split_part(s, chr(2), 1) END AS mark,
    {_entities(r"regexp_replace(CASE WHEN span > 0 THEN substr(s, strpos(s, chr(2)) + 1) ELSE s END, '\s+', ' ', 'g')")} AS text FROM cut
), tagged AS (SELECT *, coalesce(lower(regexp_extract(mark, '^/?([a-zA-Z][a-zA-Z0-9]*)', 1)), '') AS tag FROM marked),
spans AS (
  SELECT page_id, block, kind AS tag, span, text, CAST(sum(CASE WHEN tag = 'br' THEN 1 ELSE 0 END) OVER w AS INTEGER) AS line,
    CASE WHEN {_depth("'code', 'tt', 'kbd'")} > 0 THEN 'Courier' WHEN regexp_matches(kind, '^h[1-6]$') THEN 'Helvetica-Bold' ELSE 'Times' END AS font,
    CASE kind {" ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in S.SIZES.items())} ELSE {S.BODY_SIZE}::DOUBLE END AS size,
    CASE WHEN {_depth("'b', 'strong'")} > 0 OR kind = 'th' THEN 16 ELSE 0 END + CASE WHEN {_depth("'i', 'em', 'cite'")} > 0 THEN 2 ELSE 0 END AS flags
  FROM tagged WINDOW w AS (PARTITION BY page_id, block ORDER BY span)
)"""


@register("SELECT page_id, block, line, span, tag, text, font, size, flags FROM spans", _SPANS_SQL)
def page_span_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every span of every page with its block, line, font, size and flags."""
    return S.page_spans(E.read(spark, sf, "pages"))


@register("""SELECT b.page_id, b.block, tag, trim(text) AS text, font, round_even(size, 2) AS font_size, round_even(bold / CAST(greatest(1, w) AS DOUBLE), 3) AS bold_ratio,
    round_even(italic / CAST(greatest(1, w) AS DOUBLE), 3) AS italic_ratio, CASE WHEN em >= 0.32 THEN 'yes' WHEN em <= 0.16 THEN 'no' ELSE 'unknown' END AS paragraph_indent, round_even(em, 3) AS first_line_indent_em
  FROM (SELECT l.*, f.font, v.size, v.bold, v.italic, v.w, CASE WHEN n >= 2 THEN (starts[1] - list_aggregate(starts[2:6], 'median')) / greatest(1.0::DOUBLE, v.size) END AS em
    FROM blocks_of l JOIN weighed v USING (page_id, block) JOIN fonts f USING (page_id, block) WHERE f.place = 1) b""",
  _SPANS_SQL, """lines_of AS (
    SELECT page_id, block, line, any_value(tag) AS tag, string_agg(text, '' ORDER BY span) AS flat, arg_min(size, span) AS size FROM spans GROUP BY page_id, block, line
  ), full_lines AS (
    SELECT *, CASE WHEN tag = 'li' THEN 36.0::DOUBLE ELSE 0 END + (length(flat) - length(ltrim(flat, ' '))) * size / 2 AS x0 FROM lines_of WHERE trim(flat, ' ') <> ''
  ), blocks_of AS (
    SELECT page_id, block, any_value(tag) AS tag, string_agg(trim(flat, ' '), chr(10) ORDER BY line) AS text, list(x0 ORDER BY line) AS starts, count(*) AS n FROM full_lines GROUP BY page_id, block
  ), signs AS (
    SELECT *, length(text) AS w, flags >= 16 OR contains(lower(font), 'bold') AS bold, flags % 16 >= 2 AS italic FROM spans WHERE trim(text, ' ') <> ''
  ), weighed AS (
    SELECT page_id, block, sum(w) AS w, coalesce(sum(w) FILTER (bold), 0) AS bold, coalesce(sum(w) FILTER (italic), 0) AS italic, median(size) AS size FROM signs GROUP BY page_id, block
  ), fonts AS (
    SELECT page_id, block, font, row_number() OVER (PARTITION BY page_id, block ORDER BY sum(w) DESC, min(span)) AS place FROM signs GROUP BY page_id, block, font
  )""")  # fmt: skip
def page_text_hints(spark: SparkSession, sf: str) -> DataFrame:
    """Measured text of raw pages by way of the span tree: font, size, shares of bold and italic, first indent."""
    return S.page_hints(E.read(spark, sf, "pages"))


# Formulas of words: what each becomes is told by its letters, so that faults of all kinds arise from the texts.
_WORDS = (
    (0, r"'\alpha'"), (1, "w"), (2, r"'\d' || w[1]"), (3, r"'^{\' || left(w, 4) || '}'"), (4, r"'\frac{a}{' || w || '}'"),
    (5, "'{' || w || '}'"), (6, r"'\begin{matrix}' || w || '\end{matrix}'"), (7, r"'\sum_{' || w || '}'"), (8, "w || '+'"), (9, "w"),
)
_ODD = (("zz", r"'\begin{tabular}'"), ("onn", "'}'"), ("ebl", "'{'"), ("rth", r"'\end{cases}'"))
_KIND = "(length(w) * 3 + ascii(w)) % 10"


def _formula_of(word_list: str) -> str:
    cases = " ".join([f"WHEN contains(w, '{x}') THEN {t}" for x, t in _ODD] + [f"WHEN {_KIND} = {n} THEN {t}" for n, t in _WORDS])
    return f"array_to_string([CASE {cases} END FOR w IN {word_list}], ' ')"


_FORMULAS_SQL = rf"""formulas AS (
  SELECT doc_id, pos, {_formula_of(r"[CASE WHEN v = '' THEN 'z' ELSE v END FOR v IN [regexp_replace(lower(u), '[^a-z]', '', 'g') FOR u IN string_split(text, ' ')]]")} AS formula
  FROM blocks WHERE kind IN ('equation', 'abstract')
)"""


def formulas(spark: SparkSession, sf: str) -> DataFrame:
    words = F.transform(F.split("text", " ", -1), lambda u: F.regexp_replace(F.lower(u), "[^a-z]", ""))
    words = F.transform(words, lambda w: F.when(w == "", "z").otherwise(w))
    lit = F.lit

    def word(w):
        kind = (F.length(w) * 3 + F.ascii(w)) % 10
        out = F.when(w.contains("zz"), "\\begin{tabular}").when(w.contains("onn"), "}").when(w.contains("ebl"), "{").when(w.contains("rth"), "\\end{cases}")
        forms = (
            lit("\\alpha"), w, F.concat(lit("\\d"), F.left(w, lit(1))), F.concat(lit("^{\\"), F.left(w, lit(4)), lit("}")), F.concat(lit("\\frac{a}{"), w, lit("}")),
            F.concat(lit("{"), w, lit("}")), F.concat(lit("\\begin{matrix}"), w, lit("\\end{matrix}")), F.concat(lit("\\sum_{"), w, lit("}")), F.concat(w, lit("+")), w,
        )
        for n, form in enumerate(forms):
            out = out.when(kind == n, form)
        return out

    b = E.blocks(spark, sf).where("kind in ('equation', 'abstract')")
    return b.select("doc_id", "pos", F.array_join(F.transform(words, word), " ").alias("formula"))


def _checked_sql(source: str, n: int) -> str:
    """CTEs that walk the tokens of ``source`` one by one; faults{n} (doc_id, pos, kind, name) at the end."""
    known = _listed(C.LETTERS + C.SIGNS + C.FORMS)
    return rf"""t{n} AS (SELECT doc_id, pos, regexp_extract_all(formula, '{C.TOKEN}') AS t FROM {source}),
  s{n} AS (
    SELECT doc_id, pos, t, 1 AS i, []::VARCHAR[] AS stack, NULL::VARCHAR AS kind, NULL::VARCHAR AS name FROM t{n}
    UNION ALL
    SELECT doc_id, pos, t, i + 1,
      CASE WHEN x = '{{' THEN list_append(stack, '{{') WHEN e = 'begin' THEN list_append(stack, n) WHEN x = '}}' OR e = 'end' THEN stack[1:len(stack) - 1] ELSE stack END,
      CASE WHEN x = '}}' AND coalesce(stack[-1], '') <> '{{' THEN 'mismatch' WHEN e = 'begin' AND n NOT IN ({_listed(C.ENVIRONMENTS)}) THEN 'environment'
        WHEN e = 'end' AND (n = '' OR coalesce(stack[-1], '') <> n) THEN 'mismatch' WHEN e = '' AND c <> '' AND c NOT IN ({known}) THEN 'undefined' END,
      CASE WHEN x = '}}' THEN '}}' WHEN e <> '' THEN n ELSE c END
    FROM (SELECT *, t[i] AS x, regexp_extract(t[i], '^\\(begin|end)\{{', 1) AS e, regexp_extract(t[i], '\{{([A-Za-z*]*)\}}', 1) AS n, regexp_extract(t[i], '^\\([A-Za-z]+)$', 1) AS c FROM s{n} WHERE kind IS NULL AND i <= len(t))
  ), faults{n} AS (
    SELECT doc_id, pos, CASE WHEN kind IS NOT NULL THEN kind WHEN len(stack) > 0 THEN 'unclosed' END AS kind, CASE WHEN kind IS NOT NULL THEN name WHEN len(stack) > 0 THEN stack[-1] END AS name
    FROM s{n} WHERE kind IS NOT NULL OR i > len(t)
  )"""


def _repaired_sql(source: str, n: int) -> str:
    from ..functions.formula import DIFFERENTIALS

    return rf"""r{n} AS (
    SELECT doc_id, pos, formula AS old, repairs, CASE WHEN kind = 'undefined' THEN coalesce(
      CASE WHEN name IN ({_listed(DIFFERENTIALS)}) THEN nullif(regexp_replace(formula, '\\' || name || '\b', '\\,\\mathrm{{d}}' || CASE WHEN length(name) = 2 THEN name[2] ELSE '\\' || name[2:] END, 'g'), formula) END,
      CASE WHEN length(name) <= 5 THEN nullif(regexp_replace(formula, '([_^])\{{\\' || name || '\}}', '\1{{\\mathrm{{' || name || '}}}}', 'g'), formula) END) END AS better
    FROM {source} JOIN faults{n} USING (doc_id, pos)
  ), f{n + 1} AS (SELECT doc_id, pos, coalesce(better, old) AS formula, repairs + CASE WHEN better IS NULL THEN 0 ELSE 1 END AS repairs FROM r{n})"""


@register()
def formula_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas checked token by token and repaired in two rounds at most, with the fault that is left."""
    out = C.repaired_by_check(F.col("formula"))
    return formulas(spark, sf).select("doc_id", "pos", out.alias("r")).select("doc_id", "pos", "r.formula", "r.repairs", "r.kind", "r.name")


SQL["formula_checks"] = f"""WITH RECURSIVE {E.BLOCKS_SQL}, {_FORMULAS_SQL}, f0 AS (SELECT doc_id, pos, formula, 0 AS repairs FROM formulas),
  {_checked_sql("f0", 0)}, {_repaired_sql("f0", 0)}, {_checked_sql("f1", 1)}, {_repaired_sql("f1", 1)}, {_checked_sql("f2", 2)}
  SELECT doc_id, pos, formula, repairs, kind, name FROM f2 JOIN faults2 USING (doc_id, pos)"""


# Documents as markup

_STYLES = ("normal", "bold", "italic", "normal")


def flowing_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Blocks with columns, width, style and measured indent, all from place and text."""
    n = F.length("text")
    return E.blocks(spark, sf).withColumns(
        {
            "flow_columns": ((F.col("doc_id") + F.col("page")) % 3 + 1).cast("int"),
            "column": F.when((F.col("doc_id") + F.col("pos")) % 4 == 0, "full").otherwise(F.concat(F.lit("column"), (F.col("pos") % 2 + 1).cast("string"))),
            "style": F.element_at(F.array(*map(F.lit, _STYLES)), (n % 4 + 1).cast("int")),
            "indent": F.when(n % 3 == 0, (n % 17) / 10.0),
            "size": (n % 5 + 6).cast("double"),
            "x1": F.col("x0") + n % 380 + 1,
        }
    )


@register()
def document_markup(spark: SparkSession, sf: str) -> DataFrame:
    """Each document's body as ordered pieces of markup: environments that open and close, and blocks."""
    return flow.document_pieces(flowing_blocks(spark, sf))


def _ratio_sql(x0: str, x1: str, column: str, columns: str) -> str:
    room = f"CASE WHEN {column} = 'full' OR {columns} = 1 THEN 502.0::DOUBLE ELSE (502.0::DOUBLE - 18.0 * ({columns} - 1)) / {columns} END"
    return f"printf('%.3f', round_even(greatest(0.16::DOUBLE, least(0.995::DOUBLE, 612.0::DOUBLE * greatest(0.0, {x1} - {x0}) / 1000 / ({room}))), 3))"


# Names between @ stand for the expressions below; ~ for a line end.
_BODY_SQL = r"""CASE WHEN kind = 'list_item' THEN '\item ' || regexp_replace(text, '^\s*(?:(?:[•◦▪‣●○◆■□✓✔➢➤]\s*)|(?:[-–—*+]\s+))+', '') || '~'
  WHEN kind IN ('equation', 'table') THEN text
  WHEN kind = 'figure' THEN '\begin{center}~\includegraphics[width=' || @own@ || '\linewidth]{\detokenize{' || text || '}}~\end{center}~'
  WHEN text = '' THEN '' WHEN kind = 'abstract' THEN '\noindent \textbf{' || shown || '}\par\vspace{0.48em}~'
  WHEN kind = 'section' THEN '\SourceSection{' || shown || '}~' WHEN kind = 'subsection' THEN '\SourceSubsection{' || shown || '}~'
  WHEN kind = 'caption' THEN '\par\vspace{0.08em}~\noindent\makebox[\linewidth][c]{%~\begin{minipage}{' || CASE WHEN fits THEN @visual@ ELSE '1.000' END || '\linewidth}~{\rmfamily\' || side
    || '\fontsize{' || printf('%.2f', fit) || 'pt}{' || printf('%.2f', round_even(fit * 1.18, 2)) || 'pt}\selectfont ' || shown || '\par}~\end{minipage}}~\par\vspace{0.32em}~'
  WHEN kind = 'paragraph' AND indent <= 0.12 THEN '\noindent ' || shown || '\par~'
  WHEN kind = 'paragraph' AND indent IS NOT NULL THEN '{\setlength{\parindent}{' || printf('%.2f', round_even(indent, 2)) || 'em}\indent ' || shown || '\par}~'
  WHEN kind IN ('reference', 'author', 'affiliation', 'metadata') THEN '\noindent{\small ' || shown || '}\par~' ELSE shown || '\par~' END"""
_FRONT_SQL = r"""CASE WHEN text = '' THEN '' WHEN kind = 'title' THEN '\begin{flushleft}~{\rmfamily\color{SourceAccent}\fontsize{20.00pt}{22.40pt}\selectfont ' || text || '}~\end{flushleft}~~\vspace{0.20em}~'
  WHEN kind = 'author' THEN '\begin{center}{\sffamily\small ' || text || '}\end{center}\vspace{0.12em}~' WHEN kind = 'affiliation' THEN '\noindent{\sffamily\fontsize{7.4pt}{8.8pt}\selectfont ' || text || '}\par~'
  ELSE '\noindent{\sffamily\scriptsize ' || text || '}\par~' END"""
_CAP, _VIS = "greatest(1.0::DOUBLE, x1 - x0)", "greatest(1.0::DOUBLE, v.x1 - v.x0)"
_TOLERANCE = f"greatest(14.0::DOUBLE, least(34.0::DOUBLE, {_VIS} * 0.055::DOUBLE))"


def _lined(sql: str) -> str:
    made = sql.replace("@own@", _ratio_sql("x0", "x1", "c", "f")).replace("@visual@", _ratio_sql("v.x0", "v.x1", "v.c", "v.f"))
    return made.replace("~'", "' || chr(10)").replace("~", "' || chr(10) || '").replace("' || chr(10) || '' || chr(10)", "' || chr(10) || chr(10)")


SQL["document_markup"] = rf"""WITH RECURSIVE {E.BLOCKS_SQL}, given AS (
    SELECT doc_id, page, pos, kind, text, CAST((doc_id + page) % 3 + 1 AS INTEGER) AS f, CASE WHEN (doc_id + pos) % 4 = 0 THEN 'full' ELSE 'column' || (pos % 2 + 1) END AS c,
      CASE length(text) % 4 WHEN 1 THEN '\textbf{{' || text || '}}' WHEN 2 THEN '\textit{{' || text || '}}' ELSE text END AS shown,
      CASE WHEN length(text) % 3 = 0 THEN (length(text) % 17) / 10.0::DOUBLE END AS indent, round_even(greatest(6.2::DOUBLE, least(8.742::DOUBLE * 1.06::DOUBLE, (length(text) % 5 + 6) * 8.742::DOUBLE / 9.3::DOUBLE)), 2) AS fit,
      x0, y0, x0 + length(text) % 380 + 1 AS x1, y1, coalesce(pos < min(pos) FILTER (kind NOT IN ('title', 'author', 'affiliation', 'metadata')) OVER (PARTITION BY doc_id), true) AS front FROM blocks
  ), kept AS (SELECT * FROM given WHERE kind <> 'footer'),
  seen AS (
    SELECT *, last_value(CASE WHEN NOT front AND (kind IN ('figure', 'table', 'list_item', 'equation') OR text <> '') THEN {{'kind': kind, 'page': page, 'c': c, 'f': f, 'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}} END IGNORE NULLS)
      OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM kept
  ), told AS (
    SELECT *, coalesce((c = 'full' AND f > 1) OR (kind = 'caption' AND v.kind IN ('figure', 'table') AND v.page = page AND v.c = 'full'), false) AS wide,
      coalesce(v.kind IN ('figure', 'table') AND v.page = page AND y0 >= v.y0 - 8 AND y0 - v.y1 <= 150, false) AS fits,
      CASE WHEN NOT fits THEN 'raggedright' WHEN {_CAP} <= {_VIS} * 0.88::DOUBLE AND abs((x0 + x1) / 2 - (v.x0 + v.x1) / 2) <= {_TOLERANCE} THEN 'centering'
        WHEN abs(x0 - v.x0) <= {_TOLERANCE} THEN 'raggedright' WHEN abs(x1 - v.x1) <= {_TOLERANCE} THEN 'raggedleft' ELSE 'raggedright' END AS side FROM seen
  ), opened AS (SELECT *, CASE WHEN wide THEN 1 ELSE f END AS n, kind = 'list_item' AS item FROM told),
  body AS (SELECT *, lag(n, 1, 1) OVER w AS b, lag(item, 1, false) OVER w AS l FROM opened WHERE NOT front WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  moves AS (SELECT *, l AND (n <> b OR wide OR NOT item) AS ends FROM body),
  pieces AS (
    SELECT doc_id, pos, 0 AS part, CASE WHEN ends THEN '\end{{itemize}}' || chr(10) ELSE '' END || CASE WHEN n <> b AND b > 1 THEN '\end{{multicols}}' || chr(10) ELSE '' END
      || CASE WHEN n <> b AND n > 1 THEN '\begin{{multicols}}{{' || n || '}}\raggedcolumns' || chr(10) ELSE '' END || CASE WHEN item AND (NOT l OR ends) THEN '\begin{{itemize}}' || chr(10) ELSE '' END AS text FROM moves
    UNION ALL SELECT doc_id, pos, 1, {_lined(_BODY_SQL)} FROM moves
    UNION ALL SELECT doc_id, pos, 1, {_lined(_FRONT_SQL)} FROM kept WHERE front
    UNION ALL SELECT doc_id, NULL, 2, CASE WHEN coalesce(arg_max(item, pos) FILTER (NOT front AND kind <> 'footer'), false) THEN '\end{{itemize}}' || chr(10) ELSE '' END
      || CASE WHEN coalesce(arg_max(n, pos) FILTER (NOT front AND kind <> 'footer'), 1) > 1 THEN '\end{{multicols}}' || chr(10) ELSE '' END || '\end{{document}}' || chr(10)
      FROM given LEFT JOIN (SELECT doc_id, pos, n, item FROM opened) USING (doc_id, pos) GROUP BY doc_id
  ) SELECT doc_id, pos, part, text FROM pieces WHERE text <> ''"""
