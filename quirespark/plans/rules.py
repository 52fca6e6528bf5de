"""Queries on jobs' lives, results' faults, page geometry, measured style and single rules, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import formula as M
from ..functions import geometry as G
from ..functions import text as X
from ..operators import integrity, layout, lifecycle, queue, stabilise, tables
from ..sources import entities as E
from ..sources import pages as P
from .catalog import LETTERS
from .registry import SQL, register

SILENT = 28_800  # seconds without a heartbeat after which the synthetic clients count as gone

# Jobs

#: Events of jobs from the event table: one job for each user.
JOB_EVENTS_SQL = """job_events AS (
  SELECT user_id AS job_id, ts, event_id, CASE WHEN event_type = 'signup' THEN 'resume' ELSE ['dispatch', 'start', 'heartbeat', 'poll', 'done', 'error', 'disconnect', 'start'][CAST(event_id % 8 AS INTEGER) + 1] END AS action,
    CASE WHEN event_id % 3 = 0 THEN 'RESOURCE_EXHAUSTED: try later' WHEN event_id % 3 = 1 AND event_id % 2 = 0 THEN '429 RESOURCE_EXHAUSTED: Quota exceeded for metric GenerateRequestsPerDay' ELSE 'disk full ' || event_id END AS message FROM events
)"""


def job_events(spark: SparkSession, sf: str) -> DataFrame:
    names = F.array(*map(F.lit, ("dispatch", "start", "heartbeat", "poll", "done", "error", "disconnect", "start")))
    action = F.when(F.col("event_type") == "signup", "resume").otherwise(F.element_at(names, (F.col("event_id") % 8 + 1).cast("int")))
    daily = "429 RESOURCE_EXHAUSTED: Quota exceeded for metric GenerateRequestsPerDay"
    passing = F.when(F.col("event_id") % 3 == 0, "RESOURCE_EXHAUSTED: try later").when((F.col("event_id") % 3 == 1) & (F.col("event_id") % 2 == 0), daily)
    message = passing.otherwise(F.concat(F.lit("disk full "), F.col("event_id").cast("string")))
    e = E.read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return e.select(F.col("user_id").alias("job_id"), "ts", "event_id", action.alias("action"), message.alias("message"))


@register()
def job_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Each job's state after its events: queued, processing, paused, done or failed, attempts, moments and error."""
    return lifecycle.current_states(job_events(spark, sf), silent=SILENT).drop("heartbeat_at")


SQL["job_lifecycle"] = f"""WITH RECURSIVE {JOB_EVENTS_SQL}, o AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM job_events),
  s AS (SELECT job_id, 0::BIGINT AS i, 'queued' AS status, true AS active, min(ts) AS heartbeat_at, 0 AS attempts, NULL::TIMESTAMP AS last_dispatch, 0 AS progress,
      NULL::TIMESTAMP AS paused_at, NULL::TIMESTAMP AS started_at, NULL::TIMESTAMP AS finished_at, NULL::VARCHAR AS error FROM o GROUP BY job_id
    UNION ALL
    SELECT s.job_id, o.i,
      CASE k WHEN 'pause' THEN 'paused' WHEN 'pause_work' THEN 'paused' WHEN 'start' THEN 'processing' WHEN 'back' THEN 'queued' WHEN 'done' THEN 'done' WHEN 'again' THEN 'queued' WHEN 'fail' THEN 'failed' ELSE status END,
      CASE WHEN k IN ('pause', 'pause_work', 'off') THEN false WHEN k IN ('back', 'seen') THEN true ELSE active END,
      CASE WHEN k IN ('back', 'seen') THEN o.ts ELSE heartbeat_at END,
      CASE WHEN k = 'count' THEN attempts + 1 ELSE attempts END,
      CASE k WHEN 'count' THEN o.ts WHEN 'back' THEN NULL ELSE last_dispatch END,
      CASE k WHEN 'count' THEN greatest(progress, 2) WHEN 'done' THEN 100 ELSE progress END,
      CASE WHEN k IN ('pause', 'pause_work') THEN o.ts WHEN k = 'back' THEN NULL ELSE paused_at END,
      CASE WHEN k = 'start' THEN o.ts WHEN k IN ('pause_work', 'back', 'again') THEN NULL ELSE started_at END,
      CASE WHEN k IN ('done', 'fail') THEN o.ts WHEN k IN ('pause_work', 'back', 'again') THEN NULL ELSE finished_at END,
      CASE WHEN k = 'fail' THEN right(o.message, 6000) WHEN k IN ('start', 'pause_work', 'back', 'again', 'done') THEN NULL ELSE error END
    FROM s JOIN o ON o.job_id = s.job_id AND o.i = s.i + 1, LATERAL (SELECT coalesce(NOT s.active OR o.ts - s.heartbeat_at > INTERVAL {SILENT} SECOND, true) AS gone) g,
      LATERAL (SELECT CASE WHEN o.action IN ('dispatch', 'start') AND s.status = 'queued' THEN CASE WHEN gone THEN 'pause' WHEN o.action = 'start' THEN 'start' ELSE 'count' END
        WHEN o.action IN ('heartbeat', 'resume') THEN CASE WHEN s.status = 'paused' THEN 'back' ELSE 'seen' END WHEN o.action = 'disconnect' THEN 'off'
        WHEN o.action = 'poll' AND s.status = 'processing' AND gone THEN 'pause_work' WHEN o.action = 'done' AND s.status = 'processing' THEN 'done'
        WHEN o.action = 'error' AND s.status = 'processing' THEN CASE WHEN contains(lower(o.message), 'resource_exhausted') THEN 'again' ELSE 'fail' END ELSE 'none' END AS k) t)
  SELECT job_id, status, active, attempts, last_dispatch, progress, paused_at, started_at, finished_at, error FROM s QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY i DESC) = 1"""

#: The moment up to which clients are watched.
WATCHED = "2024-01-20 00:00:00"


@register()
def watched_lifecycle(spark: SparkSession, sf: str) -> DataFrame:
    """Each job's state if whoever is silent for 45 seconds is paused then: the whole-table twin of the keyed stream."""
    return lifecycle.watched_states(job_events(spark, sf), WATCHED).drop("heartbeat_at")


_POLLS = f"""own AS (SELECT * FROM job_events WHERE ts <= TIMESTAMP '{WATCHED}'),
  polls AS (SELECT job_id, ts + INTERVAL 45 SECOND + INTERVAL 1 MILLISECOND AS ts, -1 AS event_id, 'poll' AS action, NULL AS message FROM (
    SELECT *, lead(ts) OVER (PARTITION BY job_id ORDER BY ts, event_id) AS next FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS r FROM own) WHERE r = 1 OR action IN ('heartbeat', 'resume'))
    WHERE (next IS NULL OR next > ts + INTERVAL 45 SECOND) AND ts + INTERVAL 45 SECOND + INTERVAL 1 MILLISECOND <= TIMESTAMP '{WATCHED}'),
  watched AS (SELECT * FROM own UNION ALL SELECT * FROM polls)"""
SQL["watched_lifecycle"] = (
    SQL["job_lifecycle"].replace(", o AS (", f", {_POLLS}, o AS (", 1).replace("AS i FROM job_events)", "AS i FROM watched)", 1)
    .replace(f"INTERVAL {SILENT} SECOND", "INTERVAL 45 SECOND")
)

TICKS = ("1998-06-15 00:00:00", "1998-06-15 00:00:30", "1998-06-15 00:01:00")


@register()
def dispatch_three_ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Jobs whose attempts three ticks, 30 seconds apart, have raised: a job is not chosen again within its cooldown."""
    jobs = E.jobs(spark, sf)
    after = jobs
    for at in TICKS:
        after = lifecycle.dispatched(after, at, live=20 * 86_400)
    before = jobs.select("job_id", F.col("attempts").alias("before"))
    return after.join(before, "job_id").where("attempts > before").select("job_id", "attempts", "last_dispatch", "progress")


def _ticks_sql() -> str:
    steps, last = [], "jobs"
    for n, at in enumerate(TICKS):
        now = f"TIMESTAMP '{at}'"
        steps.append(
            f"p{n} AS (SELECT job_id FROM {last} WHERE status = 'queued' AND active AND heartbeat_at >= {now} - INTERVAL 20 DAY AND created_at < {now} - INTERVAL 20 SECOND "
            f"AND attempts < 8 AND (last_dispatch IS NULL OR last_dispatch < {now} - INTERVAL 45 SECOND) ORDER BY created_at, job_id LIMIT 3)"
        )
        hit = f"job_id IN (SELECT job_id FROM p{n})"
        steps.append(
            f"t{n} AS (SELECT * REPLACE (CASE WHEN {hit} THEN attempts + 1 ELSE attempts END AS attempts, CASE WHEN {hit} THEN {now} ELSE last_dispatch END AS last_dispatch, "
            f"CASE WHEN {hit} THEN greatest(progress, 2) ELSE progress END AS progress) FROM {last})"
        )
        last = f"t{n}"
    return f"WITH {E.JOBS_SQL}, {', '.join(steps)} SELECT a.job_id, a.attempts, a.last_dispatch, a.progress FROM {last} a JOIN jobs b USING (job_id) WHERE a.attempts > b.attempts"


SQL["dispatch_three_ticks"] = _ticks_sql()


@register("""SELECT event_type AS model, event_id, max(until) OVER w AS until_ms, max(daily) OVER w AS exhausted FROM (
  SELECT *, epoch_us(ts) // 1000 AS ts_ms, CASE WHEN event_id % 5 = 0 THEN epoch_us(ts) // 1000 + CAST(greatest(1, event_id % 40) * 1000 AS BIGINT) END AS until, event_id % 997 = 0 AS daily FROM events)
  WINDOW w AS (PARTITION BY event_type ORDER BY ts_ms, event_id ROWS UNBOUNDED PRECEDING)""")
def provider_cooldowns(spark: SparkSession, sf: str) -> DataFrame:
    """Until when each provider rests after each of its answers, and whether its day's quota is gone."""
    e = E.read(spark, sf, "events").select(
        F.col("event_type").alias("model"), "event_id", F.expr("unix_millis(cast(ts as timestamp))").alias("ts_ms"),
        F.when(F.col("event_id") % 5 == 0, (F.col("event_id") % 40).cast("double")).alias("delay_s"), (F.col("event_id") % 997 == 0).alias("daily"),
    )
    return lifecycle.cooldowns(e)


@register("""SELECT job_id, right(repeat(message || '|', 900), 6000) AS error, left(repeat(message || '|', 90), 500) AS message, left(repeat(status || '_', 20), 80) AS stage,
  CASE status WHEN 'queued' THEN 'waiting' WHEN 'processing' THEN 'running' ELSE status END AS shown, status ILIKE '%UEU%' OR message ILIKE 'WORKER%' AS matched, job_id / 1048576.0::DOUBLE AS mib FROM jobs""", E.JOBS_SQL)
def job_texts(spark: SparkSession, sf: str) -> DataFrame:
    """What a job row holds of long texts; a simple CASE; patterns without regard to case; bytes as MiB."""
    long = lambda c, sep, n: F.repeat(F.concat(F.col(c), F.lit(sep)), F.lit(n))
    error, message, stage = X.shortened(long("message", "|", 900), long("message", "|", 90), long("status", "_", 20))
    shown = F.when(F.col("status") == "queued", "waiting").when(F.col("status") == "processing", "running").otherwise(F.col("status"))
    matched = F.col("status").ilike("%UEU%") | F.col("message").ilike("WORKER%")
    return E.jobs(spark, sf).select("job_id", error.alias("error"), message.alias("message"), stage.alias("stage"), shown.alias("shown"), matched.alias("matched"), G.mebibytes(F.col("job_id")).alias("mib"))


@register("""SELECT job_id, least(55, 15 + CAST(round_even(40 * (progress / 90.0::DOUBLE), 0) AS INTEGER)) AS vision, least(90, 58 + CAST(round_even(32 * least(1.0::DOUBLE, progress / 90.0::DOUBLE), 0) AS INTEGER)) AS texts FROM jobs""", E.JOBS_SQL)
def stage_percent(spark: SparkSession, sf: str) -> DataFrame:
    part = F.col("progress") / 90.0
    return E.jobs(spark, sf).select("job_id", G.scaled_percent(15, 40, 55, part).alias("vision"), G.scaled_percent(58, 32, 90, F.least(F.lit(1.0), part)).alias("texts"))


# Results

_PH = r"list_sort(regexp_extract_all({0}, '\[\[MATH_[0-9]+\]\]'))"
_LIST = "'[' || array_to_string(['''' || x || '''' FOR x IN {0}], ', ') || ']'"
_MARKS = f"(regexp_matches(translated, '§({'|'.join(M.MARKS)})([^A-Za-z0-9_]|$)') OR contains(translated, '\\math{{'))"


@register(f"""SELECT doc_id, pos, item_id, unnest(list_filter(CASE WHEN coalesce(translated, '') = '' THEN ['empty translation'] ELSE [CASE WHEN a <> b THEN 'placeholders changed expected=' || {_LIST.format('a')} || ' actual=' || {_LIST.format('b')} END,
    CASE WHEN {_MARKS} THEN 'internal math transport marker' END] END, lambda x: x IS NOT NULL)) AS error
  FROM (SELECT *, {_PH.format('source')} AS a, {_PH.format('translated')} AS b FROM items)""", E.BLOCKS_SQL, E.ITEMS_SQL)
def translation_errors(spark: SparkSession, sf: str) -> DataFrame:
    """No, one or two rows for each result."""
    return integrity.error_rows(E.items(spark, sf))


KOREAN_SQL = """korean AS (SELECT doc_id, pos, item_id, source, CASE k % 6 WHEN 0 THEN source WHEN 1 THEN '번역된 문장 ' || source WHEN 2 THEN '가 나 다 라 마 바 ' || source
    WHEN 3 THEN source || repeat(' 번역된문장입니다', 8) WHEN 4 THEN repeat('번역된 문장입니다. ', 3) ELSE '가 나 다 라 ' || source || ' §gamma' END AS translated FROM (SELECT *, doc_id * 5 + pos AS k FROM items))"""


def korean(spark: SparkSession, sf: str) -> DataFrame:
    """Items with results in the manner of another language: good, untranslated, spaced, marked."""
    k, s = (F.col("doc_id") * 5 + F.col("pos")) % 6, F.col("source")
    forms = (s, F.concat(F.lit("번역된 문장 "), s), F.concat(F.lit("가 나 다 라 마 바 "), s), F.concat(s, F.repeat(F.lit(" 번역된문장입니다"), F.lit(8))), F.repeat(F.lit("번역된 문장입니다. "), F.lit(3)), F.concat(F.lit("가 나 다 라 "), s, F.lit(" §gamma")))
    out = forms[5]
    for n in range(4, -1, -1):
        out = F.when(k == n, forms[n]).otherwise(out)
    return E.items(spark, sf).withColumn("translated", out)


_LATIN, _HANGUL = "length(regexp_replace({0}, '[^A-Za-z]', '', 'g'))", "length(regexp_replace({0}, '[^가-힣]', '', 'g'))"


@register(rf"""SELECT doc_id, pos, CASE WHEN translated = '' THEN 'empty' WHEN {_PH.format('source')} <> {_PH.format('translated')} THEN 'placeholders' WHEN contains(translated, '§gamma') THEN 'marker'
    WHEN regexp_matches(translated, '([가-힣]\s+){{5,}}[가-힣]') THEN 'spaced'
    WHEN {_LATIN.format('source')} >= 60 AND length(translated) >= 80 AND {_LATIN.format('translated')} >= 45 AND {_HANGUL.format('translated')} < greatest(8, CAST(floor({_LATIN.format('translated')} * 0.18::DOUBLE) AS BIGINT)) THEN 'untranslated' END AS reason
  FROM korean""", E.BLOCKS_SQL, E.ITEMS_SQL, KOREAN_SQL)
def korean_quality(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.checked(korean(spark, sf), "ko").select("doc_id", "pos", "reason")


_BAD = f"(trim(coalesce(translated, '')) = '' OR {_PH.format('source')} <> {_PH.format('translated')} OR contains(translated, '§math{{'))"


@register(f"""SELECT doc_id, pos, CASE WHEN NOT {_BAD} THEN translated ELSE source END AS translated, {_BAD} AS again FROM items""", E.BLOCKS_SQL, E.ITEMS_SQL)
def resumed_translation(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results are checked, the bad ones made again by the provider that ships, and both are merged."""
    items = E.items(spark, sf)
    return integrity.resumed(items.drop("translated"), items.select("doc_id", "pos", "translated"))


@register("""SELECT doc_id, array_to_string(list_sort(list(item_id))[1:12], ',') AS missing FROM items WHERE trim(coalesce(translated, '')) = '' GROUP BY doc_id""", E.BLOCKS_SQL, E.ITEMS_SQL)
def completeness(spark: SparkSession, sf: str) -> DataFrame:
    """The first twelve items without a result, of documents that are not complete."""
    return integrity.missing(E.items(spark, sf))


# Text


@register(r"""SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(t), chr(173), ''), '[\n\t\r\x{A0}]', ' ', 'g'), '\p{C}', '', 'g'), ' +', ' ', 'g') AS cleaned,
  regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(nfc_normalize(t), chr(173), ''), '[\n\t\r\x{A0}]', ' ', 'g'), '\p{C}', '', 'g'), ' +', ' ', 'g'), '^\s+|\s+$', '', 'g') AS sanitised,
  regexp_replace(nfc_normalize(t), '[\x{0}-\x{8}\x{B}-\x{1F}\x{7F}-\x{9F}\x{AD}\x{200B}]', '', 'g') AS printable
  FROM (SELECT doc_id, pos, ' ' || replace(replace(text, 'e ', 'e' || chr(769) || chr(8203) || ' '), ' a', chr(9) || ' a' || chr(7) || chr(776)) || chr(10) AS t FROM blocks)""", E.BLOCKS_SQL)
def composed_text(spark: SparkSession, sf: str) -> DataFrame:
    """Texts with accents of their own, control characters and blanks at their ends, as they are kept."""
    swap = lambda c, a, b: F.replace(c, F.lit(a), F.lit(b))
    t = F.concat(F.lit(" "), swap(swap(F.col("text"), "e ", "e\u0301\u200b "), " a", "\t a\x07\u0308"), F.lit("\n"))
    b = E.blocks(spark, sf).select("doc_id", "pos", t.alias("t"))
    return b.select("doc_id", "pos", X.clean_prose(X.composed(F.col("t"))).alias("cleaned"), X.sanitised(F.col("t")).alias("sanitised"), X.printable(F.col("t")).alias("printable"))


@register(r"""SELECT page_id, generate_subscripts(parts, 1) - 1 AS ord, lower(regexp_extract(unnest(parts), '(?i)^<(h[1-6]|p|li|td)', 1)) AS tag,
  trim(regexp_replace(regexp_replace(unnest(parts), '^<[^>]*>', ''), '\s+', ' ', 'g')) AS text
  FROM (SELECT page_id, regexp_extract_all(html, '(?i)<(?:h[1-6]|p|li|td)(?:\s[^>]*)?>[^<]+') AS parts FROM pages)""")
def parsed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Text boxes of raw web pages, in order."""
    return P.page_texts(E.read(spark, sf, "pages"))


@register("SELECT doc_id, pos, id, kind, source FROM cells", E.BLOCKS_SQL, r"""cells AS (SELECT doc_id, pos, 'p' || page || '_b' || ord || '__r' || (k // 4) || 'c' || (k % 4) AS id, 'table_cell' AS kind, CASE WHEN k % 5 = 4 THEN w || ' [[MATH_0]]' ELSE w END AS source
  FROM (SELECT *, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS k FROM blocks WHERE kind = 'table') WHERE w <> '' OR k % 5 = 4)""")
def table_items(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of tables as items: rows of four words, with a formula in every fifth cell."""
    words = F.split("text", " ", -1)
    part = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("content"))
    cell = lambda w, k: F.struct(F.when(k % 5 == 4, F.array(part("text", F.concat(w, F.lit(" "))), part("math", F.lit("x_1")))).otherwise(F.array(part("text", w))).alias("parts"))
    rows = lambda cells: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(cells) - 1) / 4).cast("int")), lambda i: F.struct(F.slice(cells, i * 4 + 1, F.lit(4)).alias("cells"))
    )
    # Cells are made once for a block: a lambda that named their making would make all of them again for every row.
    b = E.blocks(spark, sf).where("kind = 'table'").withColumn("rows", X.let(F.transform(words, cell), rows))
    return tables.table_items(b).select("doc_id", "pos", "id", "kind", F.trim("source").alias("source"))


SQL["table_items"] = SQL["table_items"].replace("CASE WHEN k % 5 = 4 THEN w || ' [[MATH_0]]' ELSE w END AS source", "trim(CASE WHEN k % 5 = 4 THEN w || ' [[MATH_0]]' ELSE w END) AS source")


# Geometry

_BOX = "least(1000, greatest(0, {0}))"


@register("""SELECT doc_id, pos, CASE WHEN pos % 9 <> 0 THEN 612.0::DOUBLE * x0 / 1000 END AS px0, CASE WHEN pos % 9 <> 0 THEN 792.0::DOUBLE * y1 / 1000 END AS py1,
  round_even(1000 * greatest(0, least(x1, 612)) / 612, 3) AS nx1, round_even(1000 * greatest(0, least(y0, 792)) / 792, 3) AS ny0,
  greatest(0, (x0 + x1) / 2 - greatest(x1 - x0, 171.36::DOUBLE) / 2) AS left_, least(792, (y0 + y1) / 2 + greatest(y1 - y0, 158.4::DOUBLE) / 2) AS bottom FROM blocks""", E.BLOCKS_SQL)
def page_geometry(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes to points and back, and where a figure is looked for; a box that is not a number has none."""
    box = tuple(F.col(c) for c in ("x0", "y0", "x1", "y1"))
    odd = (F.when(F.col("pos") % 9 == 0, F.lit(float("nan"))).otherwise(F.col("x0")), *box[1:])
    wide, tall = F.lit(612.0), F.lit(792.0)
    a, b, c = G.to_page(odd, wide, tall), G.from_page(box, wide, tall), G.probe(box, wide, tall)
    return E.blocks(spark, sf).select("doc_id", "pos", a[0].alias("px0"), a[3].alias("py1"), b[2].alias("nx1"), b[1].alias("ny0"), c[0].alias("left_"), c[3].alias("bottom"))


@register("""SELECT doc_id, page, hint_ord AS image, coverage, image_coverage, CASE WHEN coverage >= 0.86 AND chars <= 3 AND drawings <= 1 THEN 'raster' ELSE 'vector_or_mixed' END AS source FROM (
  SELECT b.doc_id, b.page, b.pos, hint_ord, round_even(shared / block_area, 6) AS coverage, round_even(shared / hint_area, 6) AS image_coverage, length(b.text) % 5 AS chars, b.pos % 3 AS drawings,
    row_number() OVER (PARTITION BY b.doc_id, b.pos ORDER BY round_even(shared / block_area, 6) DESC, round_even(shared / hint_area, 6) DESC, hint_ord) AS r
  FROM bh JOIN blocks b ON b.doc_id = bh.doc_id AND b.pos = bh.pos) WHERE r = 1""", E.BLOCKS_SQL, E.HINTS_SQL, """bh AS (
  SELECT b.doc_id, b.page, b.pos, h.hint_ord, greatest(0.0::DOUBLE, least(b.x1, h.x1) - greatest(b.x0, h.x0)) * greatest(0.0::DOUBLE, least(b.y1, h.y1) - greatest(b.y0, h.y0)) AS shared,
    greatest(1.0::DOUBLE, (b.x1 - b.x0) * (b.y1 - b.y0)) AS block_area, greatest(1.0::DOUBLE, (h.x1 - h.x0) * (h.y1 - h.y0)) AS hint_area
  FROM blocks b JOIN hints h ON b.doc_id = h.doc_id AND b.page = h.page AND b.x0 < h.x1 AND h.x0 < b.x1 AND b.y0 < h.y1 AND h.y0 < b.y1)""")
def figure_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Each visual's image of highest coverage (then of highest own coverage), and what the visual is taken from."""
    return layout.figure_sources(E.blocks(spark, sf).withColumns({"chars": F.length("text") % 5, "drawings": F.col("pos") % 3}), E.hints(spark, sf))


@register("""SELECT doc_id, hint_ord, CASE WHEN bold_ratio >= 0.62 THEN 'bold' WHEN italic_ratio >= 0.62 THEN 'italic' ELSE 'normal' END AS style,
  CASE WHEN em >= 0.32 THEN round_even(greatest(0.45::DOUBLE, least(1.8::DOUBLE, em)), 2) WHEN em <= 0.16 THEN 0.0::DOUBLE END AS indent,
  CASE WHEN x1 - x0 >= 720 THEN 'full' WHEN (x0 + x1) / 2 < 333 THEN 'column1' WHEN (x0 + x1) / 2 < 667 THEN 'column2' ELSE 'column3' END AS side,
  CASE WHEN size > 8 THEN greatest(6.2::DOUBLE, least(10.0 * 1.06::DOUBLE, size * 10.0 / 9.5::DOUBLE)) ELSE 9.0::DOUBLE END AS caption FROM hints""", E.BLOCKS_SQL, E.HINTS_SQL)
def recovered_style(spark: SparkSession, sf: str) -> DataFrame:
    """Style, indent, column of three and caption size of measured texts."""
    em = F.col("em")
    decision = F.when(em >= 0.32, "yes").when(em <= 0.16, "no")
    return E.hints(spark, sf).select(
        "doc_id", "hint_ord", G.style_of(F.col("bold_ratio"), F.col("italic_ratio")).alias("style"), G.paragraph_indent(decision, em).alias("indent"),
        G.column_of(F.col("x0"), F.col("x1"), F.lit(3)).alias("side"), G.caption_size(F.when(F.col("size") > 8, F.col("size")), 10.0, 9.5).alias("caption"),
    )


@register("""SELECT doc_id, page, CASE WHEN gap > 5 AND gap < 200 THEN gap END AS gap FROM (
  SELECT doc_id, page, min(x0) FILTER (n AND x0 > 350) - max(x1) FILTER (n AND x0 < 350) AS gap FROM (SELECT *, length(text) >= 40 AND x1 - x0 < 600 AS n FROM hints) GROUP BY doc_id, page)""", E.BLOCKS_SQL, E.HINTS_SQL)
def column_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return layout.pair_gap(E.hints(spark, sf))


@register(f"""SELECT doc_id, round_even(sum(greatest(1, length(text)) * CASE WHEN contains(lower(font), 'bold') THEN 1 ELSE 0 END) / CAST(greatest(1, sum(greatest(1, length(text)))) AS DOUBLE), 3) AS bold,
  round_even(sum(greatest(1, length(text)) * CASE WHEN contains(lower(font), 'italic') THEN 1 ELSE 0 END) / CAST(greatest(1, sum(greatest(1, length(text)))) AS DOUBLE), 3) AS italic,
  CASE WHEN count(*) FILTER (c = 1) >= greatest(count(*) FILTER (c = 2), count(*) FILTER (c = 3)) THEN 1 WHEN count(*) FILTER (c = 2) >= count(*) FILTER (c = 3) THEN 2 ELSE 3 END AS columns,
  array_to_string(list_sort(list(DISTINCT c)), ',') AS flows FROM (SELECT *, CAST(length(text) % 3 + 1 AS INTEGER) AS c FROM hints) GROUP BY doc_id""", E.BLOCKS_SQL, E.HINTS_SQL)
def document_style(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of bold and italic characters, the number of columns seen most often, and the different numbers."""
    n, c = F.greatest(F.lit(1), F.length("text")), (F.length("text") % 3 + 1).cast("int")
    share = lambda part: F.bround(F.sum(n * F.lower("font").contains(part).cast("int")) / F.greatest(F.lit(1), F.sum(n)).cast("double"), 3)
    flows = F.array_join(F.transform(F.array_sort(F.collect_set(c)), lambda x: x.cast("string")), ",")
    return E.hints(spark, sf).groupBy("doc_id").agg(share("bold").alias("bold"), share("italic").alias("italic"), layout.majority(c).alias("columns"), flows.alias("flows"))


@register("""SELECT p_brand, len(t[1:30]) AS terms, array_to_string(t[1:12], '|') AS principles, array_to_string(t[1:20], '|') AS kept FROM (SELECT p_brand, list(p_name ORDER BY p_partkey) AS t FROM part GROUP BY p_brand)""")
def strategy_caps(spark: SparkSession, sf: str) -> DataFrame:
    """What a strategy keeps of its lists: 30 terms, 12 principles, 20 names that stay."""
    names = F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_name"))), lambda x: x["p_name"])
    g = E.read(spark, sf, "part").groupBy("p_brand").agg(names.alias("t"))
    cut = lambda k: F.slice("t", 1, k)
    return g.select("p_brand", F.size(cut(30)).alias("terms"), F.array_join(cut(12), "|").alias("principles"), F.array_join(cut(20), "|").alias("kept"))


@register(rf"""SELECT doc_id, pos, CASE WHEN pos % 3 = 0 THEN trim(text) ELSE trim(regexp_replace(kind || ' ' || text, '\s+$', '')) END AS formula FROM blocks WHERE kind = 'equation' AND {LETTERS.format('text')} > 0""", E.BLOCKS_SQL)
def equation_from_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Formulas of equations; where none is given, their hinted lines joined."""
    own = F.when(F.col("pos") % 3 == 0, F.concat(F.lit(" "), F.col("text")))
    b = E.blocks(spark, sf).where((F.col("kind") == "equation") & (X.letters(F.col("text")) > 0))
    return b.select("doc_id", "pos", stabilise.blank_lines(own, F.array("kind", F.lit("  "), "text")).alias("formula"))


@register(r"""SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN '\int \,\mathrm{d}x \,\mathrm{d}y ' || pos WHEN 1 THEN 'A^{\mathrm{fn}}_' || pos || ' \dz' ELSE '\other ' || pos END AS formula FROM blocks""", E.BLOCKS_SQL)
def repair_rounds(spark: SparkSession, sf: str) -> DataFrame:
    """Two rounds of repair at most: a third fault stays."""
    n, k = F.col("pos").cast("string"), F.col("pos") % 3
    log = lambda name: F.lit(f"! Undefined control sequence.\nl.3 \\{name}\n")
    formula = F.when(k == 0, F.concat(F.lit("\\int \\dx \\dy "), n)).when(k == 1, F.concat(F.lit("A^{\\fn}_"), n, F.lit(" \\dz"))).otherwise(F.concat(F.lit("\\other "), n))
    logs = F.when(k == 0, F.array(log("dx"), log("dy"))).when(k == 1, F.array(log("none"), log("fn"), log("dz"))).otherwise(F.array(log("other")))
    return E.blocks(spark, sf).select("doc_id", "pos", M.repaired_rounds(formula, logs).alias("formula"))


@register("SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 1", E.JOBS_SQL)
def oldest_job(spark: SparkSession, sf: str) -> DataFrame:
    """A limit below one is one."""
    return queue.oldest_queued(E.jobs(spark, sf), limit=0).select("job_id")
