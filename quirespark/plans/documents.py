"""Queries on formulas, markup, page structure and provider messages, each beside its SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import formula as M
from ..functions import markup as K
from ..functions import provider as V
from ..functions import text as X
from ..operators import integrity, stabilise
from ..sources import entities as E
from .catalog import FOOTER, LETTERS, MATH
from .registry import register

CLEAN = r"trim(regexp_replace(regexp_replace(regexp_replace(replace({0}, chr(173), ''), '[\n\t\r\x{{A0}}]', ' ', 'g'), '\p{{C}}', '', 'g'), ' +', ' ', 'g'))"


# Formulas

_RAW = "replace(replace(replace(text, ' of ', chr(9) || 'heta '), ' the ', ' §gamma' || chr(9)), 'er ', chr(10) || 'eq ')"
_TAILS = {c: t for c, (_, t) in M.CONTROL_TAILS.items()}


@register(
    rf"""SELECT doc_id, pos, replace(regexp_replace(replace(regexp_replace(replace({_RAW}, '§', chr(92)), '\t({_TAILS[chr(9)]})', '\\t\1', 'g'), chr(9), ' '),
  '\n({_TAILS[chr(10)]})', '\\n\1', 'g'), chr(10), ' ') AS decoded FROM blocks""", E.BLOCKS_SQL,
)
def formula_decode(spark: SparkSession, sf: str) -> DataFrame:
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    raw = swap(swap(swap(F.col("text"), " of ", "\theta "), " the ", " §gamma\t"), "er ", "\neq ")
    return E.blocks(spark, sf).select("doc_id", "pos", M.decode_transport(raw).alias("decoded"))


@register(r"""SELECT doc_id, pos, CASE pos % 6 WHEN 0 THEN 'a_' || k || ' \leq  b' WHEN 1 THEN '\mathrel{:=} x_' || k WHEN 2 THEN '\int f \,\mathrm{d}t + \,\mathrm{d}\theta ' || k
    WHEN 3 THEN '' WHEN 4 THEN '{C_A}_' || k ELSE 'x \\ & y_' || k END AS formula, pos % 6 = 3 AS unsafe FROM (SELECT *, pos % 10 AS k FROM blocks)""", E.BLOCKS_SQL)
def formula_clean(spark: SparkSession, sf: str) -> DataFrame:
    forms = ["$$a_{} ≤ b$$", "\\coloneqq x_{}", "§int f §dt + §dtheta {}", "\\input{{f{}}}", "\\[C_A_{}\\]", "x \\ & y_{}"]
    k = (F.col("pos") % 10).cast("string")
    form = F.element_at(F.array(*[F.concat(F.lit(f.replace("{{", "{").split("{}")[0]), k, F.lit(f.replace("}}", "}").split("{}")[1])) for f in forms]), (F.col("pos") % 6 + 1).cast("int"))
    return E.blocks(spark, sf).withColumn("c", M.clean_formula(form)).select("doc_id", "pos", "c.formula", "c.unsafe")


@register()
def equation_display(spark: SparkSession, sf: str) -> DataFrame:
    """Display markup of equations whose terms are the words of a block."""
    words = F.regexp_extract_all("text", F.lit("([A-Za-z]+)"))
    body = F.concat(F.lit("a = "), F.array_join(F.transform(words, lambda w: F.concat(F.lit("x_{"), w, F.lit("}"))), " + "))
    b = E.blocks(spark, sf).where("kind = 'equation'")
    number = X.equation_number(F.concat(F.lit("("), F.col("pos").cast("string"), F.lit(")")))
    return b.select("doc_id", "pos", M.equation_markup(body, F.array().cast("array<string>"), number, F.col("pos") % 3 + 1, F.lit(False)).alias("markup"))


@register()
def equation_lines(spark: SparkSession, sf: str) -> DataFrame:
    body = F.concat(F.lit("a = "), F.regexp_replace(F.regexp_replace("text", "[^A-Za-z ]", ""), " +", " + "))
    rows = E.blocks(spark, sf).where("kind = 'equation'").withColumn("line", M.broken_lines(body, F.lit(70)))
    return rows.select("doc_id", "pos", F.posexplode("line").alias("n", "line"))


@register(r"""SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN 'dx' WHEN 1 THEN 'fn' WHEN 2 THEN 'other' END AS command,
  CASE pos % 4 WHEN 0 THEN '\int \,\mathrm{d}x ' || pos WHEN 1 THEN 'A^{\mathrm{fn}}_' || pos END AS repaired FROM blocks""", E.BLOCKS_SQL)
def undefined_command_repair(spark: SparkSession, sf: str) -> DataFrame:
    n, p = F.col("pos").cast("string"), F.col("pos") % 4
    formula = F.when(p == 0, F.concat(F.lit("\\int \\dx "), n)).when(p == 1, F.concat(F.lit("A^{\\fn}_"), n)).otherwise(F.concat(F.lit("\\other "), n))
    log = F.concat(F.lit("! Undefined control sequence.\nl.12 "), F.regexp_extract(formula, r"(.*\\[a-z]+)", 1), F.lit("\n"))
    name = M.undefined_command(F.when(p < 3, log).otherwise("Output written"))
    b = E.blocks(spark, sf).select("doc_id", "pos", formula.alias("formula"), name.alias("command"))
    return b.select("doc_id", "pos", "command", M.repaired(F.col("formula"), F.col("command")).alias("repaired"))


_TERMS = r"'\mathrm{' || replace(regexp_replace(text, '[^A-Za-z ]', '', 'g'), ' ', '}\alpha_{') || '}'"


@register(rf"""SELECT doc_id, pos, 1 * length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) + length(regexp_replace(text, '[^ ]', '', 'g')) AS width,
  length({_TERMS}) <= floor(70 * 0.92::DOUBLE) OR length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) + length(regexp_replace(text, '[^ ]', '', 'g')) <= floor(70 * 0.6::DOUBLE) AS single FROM blocks""", E.BLOCKS_SQL)
def formula_width(spark: SparkSession, sf: str) -> DataFrame:
    """Visible widths of formulas whose terms are the words of a block, and whether they stay on one line."""
    plain = F.regexp_replace("text", "[^A-Za-z ]", "")
    t = F.concat(F.lit("\\mathrm{"), F.replace(plain, F.lit(" "), F.lit("}\\alpha_{")), F.lit("}"))
    return E.blocks(spark, sf).select("doc_id", "pos", M.visual_widths(t).alias("width"), M.stays_single(t, F.lit(70)).alias("single"))


@register(rf"""SELECT doc_id, pos, len(p) - 1 AS n_math, trim(regexp_replace(array_to_string([{CLEAN.format("'|' || p[i] || '|'")}[2:-2] || CASE WHEN i < len(p) THEN ' [[MATH_' || (i - 1) || ']], ' ELSE '' END FOR i IN range(1, len(p) + 1)], ''), ' +', ' ', 'g')) AS source
  FROM (SELECT doc_id, pos, string_split(text, ' of ') AS p FROM blocks)""", E.BLOCKS_SQL)
def source_assembly(spark: SparkSession, sf: str) -> DataFrame:
    """Prose with bare commands as text with placeholders."""
    parts = M.recover_parts(F.replace("text", F.lit(" of "), F.lit(" §gamma, ")))
    b = E.blocks(spark, sf).withColumn("parts", parts).withColumn("s", K.assembled(F.col("parts")))
    return b.select("doc_id", "pos", F.size("s.formulas").cast("long").alias("n_math"), F.col("s.text").alias("source"))


_ESCAPED = "array_to_string([CASE c " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TEX_ESCAPES.items()) + " ELSE c END FOR c IN string_split(t, '')], '')"


@register(rf"""SELECT doc_id, pos, CASE WHEN NOT contains(e, '[[MATH\_7]]') THEN replace(replace(e, '[[MATH\_0]]', '\(x_0\)'), '[[MATH\_1]]', '\(y^1\)') END AS shown
  FROM (SELECT doc_id, pos, {_ESCAPED} AS e FROM (SELECT doc_id, pos, {CLEAN.format("'|' || translated || '|'")}[2:-2] AS t FROM items))""", E.BLOCKS_SQL, E.ITEMS_SQL)
def translated_markup(spark: SparkSession, sf: str) -> DataFrame:
    formulas = F.create_map(F.lit("[[MATH_0]]"), F.lit("x_0"), F.lit("[[MATH_1]]"), F.lit("y^1"))
    return E.items(spark, sf).select("doc_id", "pos", K.rendered(F.col("translated"), formulas).alias("shown"))


@register(r"""SELECT doc_id, pos, CASE pos % 4 WHEN 0 THEN '\textbf{w}' WHEN 1 THEN '\textit{w}' WHEN 2 THEN '\textsc{w}' ELSE 'w' END AS styled,
  CASE pos % 3 WHEN 0 THEN '00AB' || lpad(CAST(pos % 100 AS VARCHAR), 2, '0') ELSE '333333' END AS color FROM blocks""", E.BLOCKS_SQL)
def style_and_color(spark: SparkSession, sf: str) -> DataFrame:
    style = F.element_at(F.array(*map(F.lit, ("bold", "italic", "smallcaps", "normal"))), (F.col("pos") % 4 + 1).cast("int"))
    color = F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" #00ab"), F.lpad((F.col("pos") % 100).cast("string"), 2, "0"))).when(F.col("pos") % 3 == 1, "red")
    return E.blocks(spark, sf).select("doc_id", "pos", K.styled(style, F.lit("w")).alias("styled"), K.hex_color(color).alias("color"))


@register(r"""SELECT doc_id, pos, '\begin{center}' || chr(10) || '\begin{minipage}{0.500\linewidth}' || chr(10) || '\begingroup' || chr(10) || '\small' || chr(10) || '\setlength{\tabcolsep}{3.8pt}' || chr(10)
    || '\renewcommand{\arraystretch}{1.12}' || chr(10) || '\begin{tabularx}{\linewidth}{@{}LR@{}}' || chr(10) || '\toprule' || chr(10)
    || '\textbf{' || w[1] || '} & ' || w[2] || ' \\' || chr(10) || '\midrule' || chr(10) || '\multicolumn{2}{c}{' || w[3] || '} \\' || chr(10)
    || '\bottomrule' || chr(10) || '\end{tabularx}' || chr(10) || '\endgroup' || chr(10) || '\end{minipage}' || chr(10) || '\end{center}' || chr(10) AS markup
  FROM (SELECT doc_id, pos, regexp_extract_all(text, '[A-Za-z]+') AS w FROM blocks WHERE kind = 'table') WHERE len(w) >= 3""", E.BLOCKS_SQL)
def table_markup(spark: SparkSession, sf: str) -> DataFrame:
    cell = lambda i, style, span, side: F.struct(
        F.get("w", F.lit(i)).alias("text"), F.lit(style).alias("style"), F.lit(span).alias("colspan"), F.lit(side).cast("string").alias("align"))
    row = lambda *cells: F.struct(F.array(*cells).alias("cells"))
    rows = F.array(row(cell(0, "bold", 1, None), cell(1, "normal", 1, None)), row(cell(2, "normal", 2, "center")))
    b = E.blocks(spark, sf).where("kind = 'table'").select("doc_id", "pos", F.regexp_extract_all("text", F.lit("([A-Za-z]+)")).alias("w")).where("size(w) >= 3")
    return b.select("doc_id", "pos", K.table_markup(rows, F.array(F.lit("left"), F.lit("right")), F.lit(1), F.lit(0.5)).alias("markup"))


@register("""SELECT doc_id, pos, CASE WHEN pos % 4 = 0 THEN [8.5::DOUBLE + pos] WHEN pos % 4 = 1 THEN [12.25::DOUBLE, 8.0::DOUBLE] ELSE [] END::VARCHAR AS widths FROM blocks""", E.BLOCKS_SQL)
def overfull_boxes(spark: SparkSession, sf: str) -> DataFrame:
    line = lambda w: F.concat(F.lit("Overfull \\hbox ("), w, F.lit("pt too wide) in paragraph\n"))
    log = F.when(F.col("pos") % 4 == 0, line((F.lit(8.5) + F.col("pos")).cast("string"))).when(F.col("pos") % 4 == 1, F.concat(line(F.lit("12.25")), line(F.lit("7.99")), line(F.lit("8")))).otherwise("fine")
    return E.blocks(spark, sf).select("doc_id", "pos", K.overfull(log).cast("string").alias("widths"))


# Page structure


@register("""SELECT doc_id, pos, CASE WHEN pos % 7 = 0 THEN 'box' WHEN kind = 'equation' AND text = '' THEN 'no formula' WHEN kind = 'table' AND pos % 7 = 1 THEN 'no rows'
    WHEN kind = 'table' AND pos % 7 = 2 THEN 'uneven rows' WHEN kind = 'table' AND pos % 7 = 3 THEN 'alignments' WHEN kind = 'table' AND pos % 7 = 4 THEN 'header rows' END AS first_fault FROM blocks""", E.BLOCKS_SQL)
def block_faults(spark: SparkSession, sf: str) -> DataFrame:
    p = F.col("pos") % 7
    row = lambda *spans: F.struct(F.array(*[F.struct(F.lit(s).alias("colspan")) for s in spans]).alias("cells"))
    good, bad = F.array(row(1, 1), row(2)), F.array(row(1, 1), row(1))
    rows = F.when(p == 1, F.filter(good, lambda r: F.lit(False))).when(p == 2, bad).otherwise(good)
    sides = F.when(p == 3, F.array(F.lit("left"))).otherwise(F.array(F.lit("left"), F.lit("left")))
    box = F.when(p == 0, F.array("x0", "y0")).otherwise(F.array("x0", "y0", "x1", "y1"))
    parts = F.array(F.struct(F.lit("text").alias("kind"), F.col("text").alias("content")))
    found = stabilise.faults(box, F.col("kind"), F.when(F.col("kind") == "equation", F.col("text")), rows, sides, F.when(p == 4, 3).otherwise(1), parts)
    return E.blocks(spark, sf).select("doc_id", "pos", F.get(found, F.lit(0)).alias("first_fault"))


@register("""SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN 1 ELSE 2 END AS n_parts, pos % 3 = 1 AS repair FROM blocks""", E.BLOCKS_SQL)
def softened_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("content"))
    math = F.element_at(F.array(F.lit("  "), F.lit("{x"), F.lit("{x}_1")), (F.col("pos") % 3 + 1).cast("int"))
    b = E.blocks(spark, sf).withColumn("s", stabilise.soften(F.array(part("text", F.col("text")), part("math", math))))
    return b.select("doc_id", "pos", F.size("s.parts").alias("n_parts"), "s.repair")


_FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@register(rf"""SELECT doc_id, hint_ord, CASE WHEN page = 0 AND y0 < 260 AND size >= body * 1.55 AND n <= 240 THEN 'title' WHEN size >= body * 1.18 AND n <= 180 THEN 'section' ELSE 'paragraph' END AS kind
  FROM (SELECT *, length({_FLAT}) AS n, coalesce(median(size) FILTER (NOT {FOOTER} AND NOT {MATH} AND {LETTERS.format('text')} >= 8) OVER (PARTITION BY doc_id, page), 10.0::DOUBLE) AS body FROM hints)""", E.BLOCKS_SQL, E.HINTS_SQL)
def heading_kinds_by_size(spark: SparkSession, sf: str) -> DataFrame:
    """Kinds of measured texts by their size against the page's prose."""
    return stabilise.heading_kinds(E.hints(spark, sf)).select("doc_id", "hint_ord", "kind")


@register(f"""o AS (SELECT doc_id, page, x0, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0) AS i FROM hints WHERE {LETTERS.format('text')} >= 60),
  g AS (SELECT doc_id, page, i, 1::BIGINT AS k, x0 AS s, 1::BIGINT AS n FROM o WHERE i = 1 UNION ALL
    SELECT o.doc_id, o.page, o.i, g.k + CAST(NOT f AS BIGINT), CASE WHEN f THEN g.s + o.x0 ELSE o.x0 END, CASE WHEN f THEN g.n + 1 ELSE 1 END
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.page = g.page AND o.i = g.i + 1, LATERAL (SELECT abs(o.x0 - g.s / g.n) <= 105 AS f)),
  c AS (SELECT doc_id, page, count(*) AS c FROM (SELECT doc_id, page, k FROM g GROUP BY doc_id, page, k HAVING count(*) >= 2) GROUP BY doc_id, page)
  SELECT DISTINCT h.doc_id, h.page, CAST(greatest(1, least(3, coalesce(c, 1))) AS INTEGER) AS columns FROM hints h LEFT JOIN c ON h.doc_id = c.doc_id AND h.page = c.page""".replace("o AS (", ", o AS (", 1), E.BLOCKS_SQL, E.HINTS_SQL)
def column_hint(spark: SparkSession, sf: str) -> DataFrame:
    return stabilise.column_hint(E.hints(spark, sf))


@register("""SELECT doc_id, page, CASE WHEN em >= 0.32 THEN 'yes' WHEN em <= 0.16 THEN 'no' ELSE 'unknown' END AS indented, round(em, 6) AS em FROM (
  SELECT doc_id, page, CASE WHEN len(e) >= 2 THEN (e[1] - list_aggregate(e[2:6], 'median')) / greatest(1.0::DOUBLE, list_aggregate(s, 'median')) END AS em
  FROM (SELECT doc_id, page, list(x0 ORDER BY hint_ord) AS e, list(size) AS s FROM hints GROUP BY doc_id, page))""", E.BLOCKS_SQL, E.HINTS_SQL)
def first_line_indent(spark: SparkSession, sf: str) -> DataFrame:
    edges = F.transform(F.array_sort(F.collect_list(F.struct("hint_ord", "x0"))), lambda x: x["x0"])
    h = E.hints(spark, sf).groupBy("doc_id", "page").agg(edges.alias("e"), F.collect_list("size").alias("s"))
    h = h.select("doc_id", "page", stabilise.first_indent(F.col("e"), F.col("s")).alias("em"))
    return h.select("doc_id", "page", stabilise.indent_class(F.col("em")).alias("indented"), F.round("em", 6).alias("em"))


@register(rf"""SELECT p.doc_id, left(p.opening || chr(10) || chr(10) || chr(10) || 'LIKELY HEADINGS:' || chr(10) || coalesce(heads, ''), 15000) AS preview FROM
  (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY page) AS opening FROM (SELECT doc_id, page, left(string_agg(text, chr(10) ORDER BY pos), 6500) AS t FROM blocks WHERE page < 2 GROUP BY doc_id, page) GROUP BY doc_id) p
  LEFT JOIN (SELECT doc_id, array_to_string(list(flat ORDER BY o)[1:80], chr(10)) AS heads FROM (SELECT doc_id, flat, min(hint_ord) AS o FROM (
    SELECT *, {_FLAT} AS flat, median(size) OVER (PARTITION BY doc_id, page) AS body FROM hints) WHERE length(flat) BETWEEN 3 AND 140 AND size >= body * 1.13 GROUP BY doc_id, flat) GROUP BY doc_id) h ON p.doc_id = h.doc_id""", E.BLOCKS_SQL, E.HINTS_SQL)
def document_preview(spark: SparkSession, sf: str) -> DataFrame:
    return stabilise.previews(E.blocks(spark, sf), E.hints(spark, sf))


@register("""SELECT doc_id, hint_ord, (hint_ord // 16) % 2 = 1 OR contains(lower(font), 'bold') AS bold, (hint_ord // 2) % 2 = 1 OR contains(lower(font), 'italic') AS italic,
  CASE WHEN contains(lower(font), 'arial') THEN 'sans' ELSE 'serif' END AS family FROM hints""", E.BLOCKS_SQL, E.HINTS_SQL)
def font_classes(spark: SparkSession, sf: str) -> DataFrame:
    flags, font = F.col("hint_ord").cast("int"), F.col("font")
    return E.hints(spark, sf).select("doc_id", "hint_ord", K.is_bold(font, flags).alias("bold"), K.is_italic(font, flags).alias("italic"), K.family(font).alias("family"))


@register("SELECT font, CAST(sum(length(text)) AS BIGINT) AS chars FROM hints GROUP BY font ORDER BY chars DESC, font LIMIT 12", E.BLOCKS_SQL, E.HINTS_SQL)
def font_summary(spark: SparkSession, sf: str) -> DataFrame:
    return E.hints(spark, sf).groupBy("font").agg(F.sum(F.length("text")).alias("chars")).orderBy(F.desc("chars"), "font").limit(12)


@register("""SELECT doc_id, page, hint_ord FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY (x1 - x0) * (y1 - y0) DESC, ((x0 + x1) / 2 - 500) ** 2 + ((y0 + y1) / 2 - 500) ** 2, hint_ord) AS r FROM hints) WHERE r = 1""", E.BLOCKS_SQL, E.HINTS_SQL)
def largest_near_centre(spark: SparkSession, sf: str) -> DataFrame:
    """Each page's hint of largest area; the nearest to the centre wins ties."""
    square = lambda a, b: F.pow((F.col(a) + F.col(b)) / 2 - 500, F.lit(2.0))
    order = F.struct(-(F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")), square("x0", "x1") + square("y0", "y1"), F.col("hint_ord"))
    return E.hints(spark, sf).groupBy("doc_id", "page").agg(F.min_by("hint_ord", order).alias("hint_ord"))


@register("""SELECT coalesce(b.doc_id, h.doc_id) AS doc_id, bool_and(b.page IS NOT NULL AND h.page IS NOT NULL) AS whole
  FROM (SELECT DISTINCT doc_id, page FROM blocks WHERE NOT (page = 1 AND doc_id % 3 = 0)) b FULL JOIN (SELECT DISTINCT doc_id, page FROM hints) h ON b.doc_id = h.doc_id AND b.page = h.page GROUP BY 1""", E.BLOCKS_SQL, E.HINTS_SQL)
def page_sets_equal(spark: SparkSession, sf: str) -> DataFrame:
    """Whether the pages that a document has blocks on are those that it was measured on."""
    got = E.blocks(spark, sf).where("not (page = 1 and doc_id % 3 = 0)")
    return integrity.same_pages(got, E.hints(spark, sf))


@register()
def stabilised_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return stabilise.stabilised(E.blocks(spark, sf), E.hints(spark, sf))


@register()
def stabilised_coverage(spark: SparkSession, sf: str) -> DataFrame:
    h = E.hints(spark, sf)
    read = stabilise.read_once(h, texts=False)
    return stabilise.coverage(stabilise.stabilised(E.blocks(spark, sf), h, read), read)


# Messages and records


@register("""SELECT doc_id, pos, CASE WHEN pos % 3 > 0 THEN text || '|' || kind || CASE WHEN pos % 3 = 2 THEN '|' ELSE '' END END AS translations FROM blocks""", E.BLOCKS_SQL)
def response_translations(spark: SparkSession, sf: str) -> DataFrame:
    """Translations of a JSON answer made from a block; null unless it holds exactly as many as were asked for."""
    k = F.col("pos") % 3
    texts = F.when(k == 2, F.array("text", "kind", F.lit(""))).otherwise(F.array("text", "kind"))
    answer = F.to_json(F.struct(texts.alias("translations")))
    asked = F.when(k == 0, 3).when(k == 1, 2).otherwise(3)
    return E.blocks(spark, sf).select("doc_id", "pos", F.array_join(V.answer_translations(answer, asked), "|").alias("translations"))


@register("""SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN text || kind WHEN 1 THEN text ELSE '' END AS text FROM blocks""", E.BLOCKS_SQL)
def response_text_parts(spark: SparkSession, sf: str) -> DataFrame:
    """The text parts of a nested answer's first candidate, joined."""
    k = F.col("pos") % 3
    parts = lambda *names: F.array(*[F.struct((F.col(n) if n else F.lit(None).cast("string")).alias("text"), F.lit(1).alias("other")) for n in names])
    chosen = F.when(k == 0, parts("text", None, "kind")).when(k == 1, parts("text")).otherwise(parts(None))
    first = F.struct(F.struct(chosen.alias("parts")).alias("content"))
    second = F.struct(F.struct(parts("kind").alias("parts")).alias("content"))
    answer = F.to_json(F.struct(F.array(first, second).alias("candidates")))
    return E.blocks(spark, sf).select("doc_id", "pos", V.answer_text(answer).alias("text"))


@register("""SELECT job_id, '{"ref":"main","inputs":{"job_id":"' || job_id || '"}}' AS payload FROM jobs""", E.JOBS_SQL)
def dispatch_payload(spark: SparkSession, sf: str) -> DataFrame:
    inputs = F.struct(F.col("job_id").cast("string").alias("job_id")).alias("inputs")
    return E.jobs(spark, sf).select("job_id", F.to_json(F.struct(F.lit("main").alias("ref"), inputs)).alias("payload"))


@register("""SELECT job_id, status FROM jobs WHERE job_id = (SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY created_at DESC, job_id DESC LIMIT 1)""", E.JOBS_SQL)
def latest_queued(spark: SparkSession, sf: str) -> DataFrame:
    return E.jobs(spark, sf).where("status = 'queued'").orderBy(F.desc("created_at"), F.desc("job_id")).limit(1).select("job_id", "status")


@register("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE date_trunc('second', ts) END AS at,
  event_id % 4 = 3 OR date_trunc('second', ts) < TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 45 SECOND AS stale FROM events""")
def iso_staleness(spark: SparkSession, sf: str) -> DataFrame:
    """Moments from ISO texts (with Z, with an offset, or without a zone as UTC; bad ones null), and whether they are too old."""
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(plain, F.lit("+00:00"))).when(k == 2, plain).otherwise("soon")
    at = F.try_to_timestamp(text)
    stale = at.isNull() | (F.unix_micros(F.to_timestamp(F.lit("2024-01-15 00:00:00"))) - F.unix_micros(at) > 45_000_000)
    e = E.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select("event_id", at.alias("at"), stale.alias("stale"))


@register(f"""SELECT job_id, epoch_us(TIMESTAMP '{E.AS_OF}') - epoch_us(created_at) AS age_us FROM jobs WHERE status = 'queued' ORDER BY created_at DESC, job_id LIMIT 10""", E.JOBS_SQL)
def queue_age(spark: SparkSession, sf: str) -> DataFrame:
    j = E.jobs(spark, sf).where("status = 'queued'").orderBy(F.desc("created_at"), "job_id").limit(10)
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return j.select("job_id", (micros(F.lit(E.AS_OF)) - micros(F.col("created_at"))).alias("age_us"))


@register("""SELECT user_id, event_id, max(action = 'disconnect') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS locked FROM heartbeats""", E.HEARTBEATS_SQL)
def sticky_lock(spark: SparkSession, sf: str) -> DataFrame:
    """A lock that stays once it is set."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return E.heartbeats(spark, sf).select("user_id", "event_id", F.max(F.col("action") == "disconnect").over(w).alias("locked"))


@register("""SELECT doc_id, array_to_string(list_sort(list(item_id) FILTER (translated = ''))[1:8], ',') AS missing FROM items GROUP BY doc_id HAVING count(*) FILTER (translated = '') > 0""", E.BLOCKS_SQL, E.ITEMS_SQL)
def missing_report(spark: SparkSession, sf: str) -> DataFrame:
    """The first eight items of a document without a result."""
    empty = E.items(spark, sf).where("translated = ''")
    return empty.groupBy("doc_id").agg(F.array_join(F.slice(F.array_sort(F.collect_list("item_id")), 1, 8), ",").alias("missing"))


@register("""SELECT doc_id, pos, array_to_string([w[i] FOR i IN range(1, len(w) + 1) IF list_position(w, w[i]) = i], ' ') AS words FROM (SELECT doc_id, pos, string_split(text, ' ') AS w FROM blocks)""", E.BLOCKS_SQL)
def ordered_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Words of a block, each once, in order of first sight."""
    return E.blocks(spark, sf).select("doc_id", "pos", F.array_join(F.array_distinct(F.split("text", " ", -1)), " ").alias("words"))


@register("""SELECT job_id, CASE WHEN job_id % 10 = 0 THEN 'fallback' WHEN job_id % 10 = 1 THEN 'skip' WHEN s IS NULL THEN 'next' WHEN s BETWEEN 200 AND 299 THEN 'accept' WHEN s = 429 THEN 'lock'
    WHEN s = 404 OR s >= 500 THEN 'next' ELSE 'raise' END AS step FROM (SELECT job_id, [200, 429, 404, 503, 400, NULL][CAST(job_id % 6 AS INTEGER) + 1] AS s FROM jobs)""", E.JOBS_SQL)
def provider_steps(spark: SparkSession, sf: str) -> DataFrame:
    status = F.element_at(F.array(*[F.lit(x).cast("int") for x in (200, 429, 404, 503, 400, None)]), (F.col("job_id") % 6 + 1).cast("int"))
    k = F.col("job_id") % 10
    return E.jobs(spark, sf).select("job_id", V.next_step(k == 0, k == 1, status).alias("step"))


@register("""SELECT p_brand, string_agg('- ' || p_name || ' => ' || CASE WHEN p_size % 3 = 0 THEN 'KEEP ENGLISH EXACTLY AS: ' || p_name ELSE p_type END || CASE WHEN p_size % 2 = 0 THEN ' (size ' || p_size || ')' ELSE '' END, chr(10)
  ORDER BY p_partkey) AS glossary FROM part GROUP BY p_brand""")
def glossary_request(spark: SparkSession, sf: str) -> DataFrame:
    """The glossary lines of a request, a glossary for each brand."""
    policy = F.when(F.col("p_size") % 3 == 0, "keep_english").otherwise("translate")
    note = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("size "), F.col("p_size").cast("string")))
    term = F.struct(F.col("p_partkey").alias("n"), F.col("p_name").alias("source"), F.col("p_type").alias("target"), policy.alias("policy"), note.alias("note"))
    g = E.read(spark, sf, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(term)).alias("terms"))
    return g.select("p_brand", V.glossary_lines(F.col("terms")).alias("glossary"))


@register("""SELECT job_id, '[{"kind":"figure","page":' || job_id || '}]' AS blocks, lower(status) AS code FROM jobs""", E.JOBS_SQL)
def checkpoint_without_assets(spark: SparkSession, sf: str) -> DataFrame:
    block = F.struct(F.lit("figure").alias("kind"), F.col("job_id").alias("page"), F.lit("f.png").alias("asset"))
    shouted = F.concat(F.lit(" "), F.upper("status"))
    return E.jobs(spark, sf).select("job_id", F.to_json(V.without_assets(F.array(block))).alias("blocks"), V.target_code(shouted).alias("code"))
