"""All queries over the driver's tables, each beside the SQL that states it for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import glyphs
from ..functions import markup as K
from ..functions import protect as P
from ..functions import tex as T
from ..functions import text as X
from ..operators import batching, glossary, integrity, layout, providers, queue, stabilise
from ..sources import entities as E
from .registry import QUERIES, SQL, register

LETTERS = r"length(regexp_replace({0}, '[^\p{{L}}]', '', 'g'))"
FLAT = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
FOOTER = f"({FLAT} = '' OR regexp_matches(lower({FLAT}), '^(page\\s*)?[0-9]+$') OR (y0 >= 955 AND length({FLAT}) <= 140))".format("text")
COMPACT = r"regexp_replace(text, '\s', '', 'g')"
MATH_N = f"(length({COMPACT}) - length(translate({COMPACT}, '{X.MATH_CHARS}', '')))"
MATH = (
    f"(text <> '' AND (regexp_matches(lower(font), '{'|'.join(X.MATH_FONTS)}') OR ({COMPACT} <> '' AND ("
    f"({MATH_N} >= 5 AND {MATH_N} / greatest(1, length({COMPACT})) >= 0.075) OR ({MATH_N} >= 3 AND {LETTERS.format(COMPACT)} <= 45)"
    f" OR (regexp_matches({COMPACT}, '[=∫∑]') AND {MATH_N} >= 2 AND {LETTERS.format(COMPACT)} <= 90)))))"
)
FOLD = "lower({0})"
for _letter, _spelt in X.FOLDS.items():
    FOLD = f"replace({FOLD}, '{_letter}', '{_spelt}')"
SIG = rf"""CASE WHEN kind IN ('equation', 'figure', 'table') THEN '' ELSE trim(regexp_replace(trim(regexp_replace({FOLD.format('text')}, '\s+', ' ', 'g')), '[^\p{{L}}\p{{N}}_\s]', '', 'g')) END"""
BH = """bh AS (
  SELECT b.doc_id, b.page, b.pos, h.hint_ord, h.text AS hint_text, h.font, h.size,
    greatest(0.0::DOUBLE, least(b.x1, h.x1) - greatest(b.x0, h.x0)) * greatest(0.0::DOUBLE, least(b.y1, h.y1) - greatest(b.y0, h.y0)) AS shared,
    greatest(1.0::DOUBLE, (b.x1 - b.x0) * (b.y1 - b.y0)) AS block_area, greatest(1.0::DOUBLE, (h.x1 - h.x0) * (h.y1 - h.y0)) AS hint_area
  FROM blocks b JOIN hints h ON b.doc_id = h.doc_id AND b.page = h.page AND b.x0 < h.x1 AND h.x0 < b.x1 AND b.y0 < h.y1 AND h.y0 < b.y1
)"""


# Text and blocks


@register(
    f"""SELECT d.lang, d.source, count(*) AS n_blocks, count(*) FILTER (prose) AS n_prose, CAST(sum(n) AS BIGINT) AS letters,
      CAST(coalesce(sum(n) FILTER (prose), 0) AS BIGINT) AS prose_letters,
      coalesce(sum(n) FILTER (prose), 0) / greatest(1, sum(n)) AS coverage
    FROM (SELECT doc_id, {LETTERS.format('text')} AS n, NOT {FOOTER} AND NOT {MATH} AND {LETTERS.format('text')} >= 8 AS prose
      FROM (SELECT *, 'Times' AS font FROM blocks)) b JOIN documents d USING (doc_id) GROUP BY d.lang, d.source""",
    E.BLOCKS_SQL,
)
def prose_coverage_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    b = E.blocks(spark, sf)
    prose = X.prose_candidate(F.col("text"), F.lit("Times"), F.col("y0"))
    n = b.select("doc_id", X.letters(F.col("text")).alias("n"), prose.alias("prose"))
    kept = F.when(F.col("prose"), F.col("n"))
    by_doc = n.groupBy("doc_id").agg(F.count("*").alias("b"), F.count_if("prose").alias("p"), F.sum("n").alias("l"), F.coalesce(F.sum(kept), F.lit(0)).alias("pl"))
    docs = E.read(spark, sf, "documents").select("doc_id", "lang", "source")
    return by_doc.join(docs, "doc_id").groupBy("lang", "source").agg(
        F.sum("b").alias("n_blocks"), F.sum("p").alias("n_prose"), F.sum("l").alias("letters"), F.sum("pl").alias("prose_letters"),
        (F.sum("pl") / F.greatest(F.lit(1), F.sum("l"))).alias("coverage"),
    )


@register(f"""SELECT doc_id, page, min(pos) AS pos, count(*) AS copies FROM (SELECT *, {SIG} AS sig FROM blocks)
  GROUP BY doc_id, page, CASE WHEN length(sig) >= 18 THEN sig ELSE '#' || pos END""", E.BLOCKS_SQL)
def block_dedup_exact(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.dedup_exact(E.blocks(spark, sf))


@register()
def dedup_similar(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.dedup_similar(E.blocks(spark, sf))


@register(rf"""SELECT doc_id, pos, {LETTERS.format('text')} AS letters, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
  length(regexp_replace(text, '[^가-힣]', '', 'g')) AS hangul, length(regexp_replace(text, '[^\p{{L}}\p{{N}}]', '', 'g')) AS alnum,
  regexp_matches(text, '[.!?。！？]\s*$') AS complete FROM blocks""", E.BLOCKS_SQL)
def letter_counts(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("text")
    return E.blocks(spark, sf).select("doc_id", "pos", X.letters(t).alias("letters"), X.latin(t).alias("latin"), X.hangul(t).alias("hangul"), X.alnum(t).alias("alnum"), X.ends_sentence(t).alias("complete"))


@register(r"""SELECT doc_id, pos, regexp_replace(regexp_replace(regexp_replace(replace(t, chr(173), ''), '[\n\t\r\x{A0}]', ' ', 'g'), '\p{C}', '', 'g'), ' +', ' ', 'g') AS cleaned,
  regexp_replace(t, '^\s*(?:(?:[•◦▪‣●○◆■□✓✔➢➤]\s*)|(?:[-–—*+]\s+))+', '') AS unmarked
  FROM (SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN '• ' ELSE '- ' END || replace(text, ' the ', chr(9) || chr(160) || 'the' || chr(173) || ' ') AS t FROM blocks)""", E.BLOCKS_SQL)
def clean_and_unmark(spark: SparkSession, sf: str) -> DataFrame:
    dirty = F.concat(F.when(F.col("pos") % 3 == 0, "• ").otherwise("- "), F.replace("text", F.lit(" the "), F.lit("\t the­ ")))
    return E.blocks(spark, sf).select("doc_id", "pos", dirty.alias("t")).select("doc_id", "pos", X.clean_prose(F.col("t")).alias("cleaned"), X.strip_list_marker(F.col("t")).alias("unmarked"))


_ESCAPE_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in X.TEX_ESCAPES.items())


@register(f"""SELECT doc_id, pos, array_to_string([CASE c {_ESCAPE_CASE} ELSE c END FOR c IN string_split(t, '')], '') AS escaped,
  trim(regexp_replace(trim('(' || pos || ')'), '^\\(\\s*([^()]*)\\s*\\)$', '\\1')) AS equation_number
  FROM (SELECT doc_id, pos, replace(replace(text, ' of ', ' & '), ',', '_%$#~^') || chr(92) || '{{}}' AS t FROM blocks)""".replace("{{}}", "{}"), E.BLOCKS_SQL)
def latex_escape(spark: SparkSession, sf: str) -> DataFrame:
    t = F.concat(F.replace(F.replace("text", F.lit(" of "), F.lit(" & ")), F.lit(","), F.lit("_%$#~^")), F.lit("\\{}"))
    number = F.concat(F.lit("("), F.col("pos").cast("string"), F.lit(")"))
    return E.blocks(spark, sf).select("doc_id", "pos", X.escape_tex(t).alias("escaped"), X.equation_number(number).alias("equation_number"))


# Queue


@register(f"""SELECT job_id, created_at, attempts FROM jobs WHERE status = 'queued' AND active AND heartbeat_at >= TIMESTAMP '{E.AS_OF}' - INTERVAL 20 DAY
  AND created_at < TIMESTAMP '{E.AS_OF}' - INTERVAL 20 SECOND AND attempts < 8
  AND (last_dispatch IS NULL OR last_dispatch < TIMESTAMP '{E.AS_OF}' - INTERVAL 45 SECOND) ORDER BY created_at, job_id LIMIT 3""", E.JOBS_SQL)
def queue_recovery_topk(spark: SparkSession, sf: str) -> DataFrame:
    return queue.recoverable(E.jobs(spark, sf), E.AS_OF, live=20 * 86_400).select("job_id", "created_at", "attempts")


@register(f"""SELECT status, count(*) AS n FROM jobs WHERE NOT active OR heartbeat_at IS NULL OR heartbeat_at < TIMESTAMP '{E.AS_OF}' - INTERVAL 45 SECOND GROUP BY status""", E.JOBS_SQL)
def stale_clients(spark: SparkSession, sf: str) -> DataFrame:
    return queue.stale(E.jobs(spark, sf), E.AS_OF).groupBy("status").agg(F.count("*").alias("n"))


@register("SELECT job_id FROM jobs WHERE status = 'queued' ORDER BY created_at, job_id LIMIT 10", E.JOBS_SQL)
def queue_pending(spark: SparkSession, sf: str) -> DataFrame:
    return queue.oldest_queued(E.jobs(spark, sf), limit=50).select("job_id")


@register("SELECT job_id, user_id, status FROM jobs WHERE job_id = 7", E.JOBS_SQL)
def job_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return E.jobs(spark, sf).where("job_id = 7").select("job_id", "user_id", "status")


@register("SELECT EXISTS(SELECT 1 FROM jobs WHERE status = 'queued') AS has_queued", E.JOBS_SQL)
def queue_has_work(spark: SparkSession, sf: str) -> DataFrame:
    return E.jobs(spark, sf).where("status = 'queued'").limit(1).agg((F.count("*") > 0).alias("has_queued"))


@register("SELECT job_id, status, status_code, error_msg FROM jobs LEFT JOIN responses ON job_id = request_id", E.JOBS_SQL, E.RESPONSES_SQL)
def dispatch_left_join(spark: SparkSession, sf: str) -> DataFrame:
    j, r = E.jobs(spark, sf), E.responses(spark, sf)
    return j.join(r, j.job_id == r.request_id, "left").select("job_id", "status", "status_code", "error_msg")


@register("""SELECT job_id, status, CASE WHEN request_id IS NULL THEN 'unchanged' WHEN status_code IN (200, 204) THEN CASE WHEN progress >= 4 THEN 'resuming' ELSE 'starting' END
    WHEN status_code IN (401, 403, 404) THEN 'refused' WHEN status_code IS NOT NULL THEN 'retrying' ELSE 'network' END AS outcome,
  CASE WHEN status_code IN (200, 204) THEN greatest(progress, 3) ELSE progress END AS progress
  FROM jobs LEFT JOIN (SELECT * FROM responses WHERE status_code IS NOT NULL OR error_msg IS NOT NULL) ON job_id = request_id AND status = 'queued'""", E.JOBS_SQL, E.RESPONSES_SQL)
def dispatch_response_merge(spark: SparkSession, sf: str) -> DataFrame:
    return queue.merge_responses(E.jobs(spark, sf), E.responses(spark, sf))


@register("SELECT job_id FROM jobs WHERE NOT EXISTS (SELECT 1 FROM responses WHERE request_id = job_id)", E.JOBS_SQL, E.RESPONSES_SQL)
def jobs_without_response(spark: SparkSession, sf: str) -> DataFrame:
    r = E.responses(spark, sf).select(F.col("request_id").alias("job_id"))
    return E.jobs(spark, sf).join(r, "job_id", "left_anti").select("job_id")


@register("SELECT job_id, status FROM jobs WHERE job_id NOT IN (SELECT request_id FROM responses) UNION ALL SELECT request_id, 'answered' FROM responses", E.JOBS_SQL, E.RESPONSES_SQL)
def job_upsert(spark: SparkSession, sf: str) -> DataFrame:
    new = E.responses(spark, sf).select(F.col("request_id").alias("job_id"), F.lit("answered").alias("status"))
    return queue.upsert(E.jobs(spark, sf).select("job_id", "status"), new, "job_id")


@register("""SELECT job_id, user_id FROM jobs WHERE user_id = 42""", E.JOBS_SQL)
def owner_filter(spark: SparkSession, sf: str) -> DataFrame:
    return E.jobs(spark, sf).where("user_id = 42").select("job_id", "user_id")


@register("""SELECT job_id, string_split(path, '/')[1] = CAST(user_id AS VARCHAR) AND path = user_id || '/' || job_id || '/original.pdf' AND progress = 0 AND attempts BETWEEN 0 AND 8
    AND result_path IS NULL AND pages IS NULL AND started_at IS NULL AND error IS NULL AS valid
  FROM (SELECT *, CASE WHEN job_id % 3 = 0 THEN 0 ELSE user_id END || '/' || job_id || '/original.pdf' AS path, CASE WHEN job_id % 13 = 0 THEN 'r' END AS result_path,
    CASE WHEN job_id % 17 = 0 THEN 3 END AS pages, CASE WHEN job_id % 19 = 0 THEN created_at END AS started_at, CASE WHEN job_id % 23 = 0 THEN 'e' END AS error FROM jobs)""", E.JOBS_SQL)
def insert_shape_check(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a row may be inserted: its path is the owner's, nothing is done yet, and no result is given."""
    owner = F.when(F.col("job_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id")).cast("string")
    j = E.jobs(spark, sf).withColumn("path", F.concat_ws("/", owner, F.col("job_id").cast("string"), F.lit("original.pdf")))
    part = lambda n, v: F.when(F.col("job_id") % n == 0, v)
    j = j.withColumns({"result_path": part(13, F.lit("r")), "pages": part(17, F.lit(3)), "started_at": part(19, F.col("created_at")), "error": part(23, F.lit("e"))})
    return j.select("job_id", queue.insertable(("result_path", "pages", "started_at", "error")).alias("valid"))


@register("""SELECT job_id, CASE WHEN trim(message) = '' THEN 'waiting' WHEN regexp_matches(lower(trim(message)), 'worker|runner|workflow|vault|token')
  THEN CASE WHEN progress >= 4 THEN 'resuming' ELSE 'starting' END ELSE trim(message) END AS shown FROM jobs""", E.JOBS_SQL)
def message_masking(spark: SparkSession, sf: str) -> DataFrame:
    m = F.trim("message")
    shown = F.when(m == "", "waiting").when(F.lower(m).rlike("worker|runner|workflow|vault|token"), F.when(F.col("progress") >= 4, "resuming").otherwise("starting")).otherwise(m)
    return E.jobs(spark, sf).select("job_id", shown.alias("shown"))


@register("""SELECT user_id, event_id, ts, max(CAST(trunc(CASE WHEN isnan(v) THEN 0 ELSE greatest(0, least(100, v)) END) AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS progress, message
  FROM (SELECT *, CASE WHEN event_id % 101 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 103 = 0 THEN 1e12::DOUBLE WHEN event_id % 107 = 0 THEN '-Infinity'::DOUBLE ELSE value END AS v FROM heartbeats)""", E.HEARTBEATS_SQL)
def progress_running_max(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("event_id")
    odd = F.when(n % 101 == 0, float("nan")).when(n % 103 == 0, 1e12).when(n % 107 == 0, float("-inf")).otherwise(F.col("value"))
    return queue.running_progress(E.heartbeats(spark, sf).withColumn("value", odd))


@register("""SELECT user_id, event_id, ts, progress, message FROM (SELECT *, lag(progress) OVER w AS b, lag(message) OVER w AS m FROM (
  SELECT user_id, event_id, ts, max(greatest(0, least(100, CAST(trunc(value) AS INTEGER)))) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS progress, message FROM heartbeats) WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) WHERE progress IS DISTINCT FROM b OR message IS DISTINCT FROM m""", E.HEARTBEATS_SQL)
def progress_change_only(spark: SparkSession, sf: str) -> DataFrame:
    return queue.progress_changes(E.heartbeats(spark, sf))


@register("SELECT user_id, ts, event_id, action, value, message FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM heartbeats) WHERE r = 1", E.HEARTBEATS_SQL)
def latest_job_state(spark: SparkSession, sf: str) -> DataFrame:
    return queue.latest(E.heartbeats(spark, sf), "user_id", "ts", "event_id")


@register("""SELECT user_id, count(*) AS beats, min(ts) AS first, max(ts) AS last FROM (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 6 HOUR THEN 0 ELSE 1 END AS n FROM heartbeats)) GROUP BY user_id, s""", E.HEARTBEATS_SQL)
def heartbeat_sessions(spark: SparkSession, sf: str) -> DataFrame:
    return queue.sessions(E.heartbeats(spark, sf))


@register("""SELECT user_id, event_id, action, action <> 'disconnect' AS active,
  coalesce((action <> 'disconnect') <> lag(action <> 'disconnect') OVER w, action <> 'disconnect') AS changed,
  CAST(sum(CAST(action = 'resume' AS INTEGER)) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS resumes
  FROM heartbeats WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""", E.HEARTBEATS_SQL)
def client_state_machine(spark: SparkSession, sf: str) -> DataFrame:
    return queue.client_states(E.heartbeats(spark, sf))


# Layout


@register("""SELECT doc_id, pos, hint_ord, font, size FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY shared / block_area + shared / hint_area DESC, hint_ord) AS r FROM bh) WHERE r = 1""", E.BLOCKS_SQL, E.HINTS_SQL, BH)
def bbox_overlap_best(spark: SparkSession, sf: str) -> DataFrame:
    return layout.best_match(E.blocks(spark, sf), E.hints(spark, sf))


@register("""SELECT doc_id, pos, min(hint_ord) AS hint_ord FROM bh WHERE shared / hint_area >= 0.78 AND shared / block_area >= 0.48 GROUP BY doc_id, pos HAVING count(*) = 1""", E.BLOCKS_SQL, E.HINTS_SQL, BH)
def anchor_unique_match(spark: SparkSession, sf: str) -> DataFrame:
    return layout.unique_match(E.blocks(spark, sf), E.hints(spark, sf))


@register("""SELECT doc_id, hint_ord, text FROM hints h WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = h.doc_id AND b.page = h.page AND (
  greatest(0.0::DOUBLE, least(b.x1, h.x1) - greatest(b.x0, h.x0)) * greatest(0.0::DOUBLE, least(b.y1, h.y1) - greatest(b.y0, h.y0)) >= 0.42 * ((h.x1 - h.x0) * (h.y1 - h.y0))
  OR ((h.x0 + h.x1) / 2 BETWEEN b.x0 AND b.x1 AND (h.y0 + h.y1) / 2 BETWEEN b.y0 AND b.y1)))""", E.BLOCKS_SQL, E.HINTS_SQL)
def uncovered_hints(spark: SparkSession, sf: str) -> DataFrame:
    return layout.uncovered(E.hints(spark, sf), E.blocks(spark, sf)).select("doc_id", "hint_ord", "text")


@register("""SELECT doc_id, pos, string_agg(hint_text, ' ' ORDER BY r) AS texts FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pos ORDER BY shared DESC, hint_ord) AS r FROM bh) WHERE r <= 4 GROUP BY doc_id, pos""", E.BLOCKS_SQL, E.HINTS_SQL, BH)
def overlap_top4_text(spark: SparkSession, sf: str) -> DataFrame:
    return layout.top_text(E.blocks(spark, sf), E.hints(spark, sf))


_FIT = "shared / block_area + shared / hint_area"


@register(f"""SELECT g.doc_id, g.page, g.pos, CASE WHEN kind NOT IN ('equation', 'figure', 'table', 'footer') THEN CASE WHEN bold >= 0.62 THEN 'bold' WHEN italic >= 0.62 THEN 'italic' WHEN bold <= 0.18 AND italic <= 0.18 THEN 'normal' END END AS style,
  CASE WHEN kind NOT IN ('equation', 'figure', 'table', 'footer') AND m.size BETWEEN 5 AND 36 THEN round_even(m.size, 2) END AS size,
  CASE WHEN kind NOT IN ('equation', 'figure', 'table', 'footer') THEN CASE WHEN contains(lower(m.font), 'arial') THEN 'sans' ELSE 'serif' END END AS family,
  CASE WHEN kind = 'paragraph' THEN CASE WHEN t.em >= 0.32 THEN round_even(greatest(0.45::DOUBLE, least(1.8::DOUBLE, t.em)), 2) WHEN t.em <= 0.16 THEN 0.0::DOUBLE END END AS em
  FROM (SELECT doc_id, page, pos, round_even(sum(w * bold_ratio) / sum(w), 6) AS bold, round_even(sum(w * italic_ratio) / sum(w), 6) AS italic FROM wide GROUP BY doc_id, page, pos) g
  JOIN blocks b ON b.doc_id = g.doc_id AND b.pos = g.pos
  JOIN (SELECT * FROM wide QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY {_FIT} DESC, hint_ord) = 1) m ON m.doc_id = g.doc_id AND m.pos = g.pos
  LEFT JOIN (SELECT * FROM wide WHERE em >= 0.32 OR em <= 0.16 QUALIFY row_number() OVER (PARTITION BY doc_id, pos ORDER BY {_FIT} DESC, hint_ord) = 1) t ON t.doc_id = g.doc_id AND t.pos = g.pos""",
  E.BLOCKS_SQL, E.HINTS_SQL, BH, """wide AS (SELECT bh.*, h.bold_ratio, h.italic_ratio, h.em, greatest(1.0::DOUBLE, least(50000.0::DOUBLE, shared)) AS w FROM bh JOIN hints h ON h.doc_id = bh.doc_id AND h.hint_ord = bh.hint_ord)""")
def measured_style(spark: SparkSession, sf: str) -> DataFrame:
    return layout.measured_style(E.blocks(spark, sf), E.hints(spark, sf))


@register("""SELECT doc_id, font FROM (SELECT doc_id, font, row_number() OVER (PARTITION BY doc_id ORDER BY sum(length(text)) DESC, min(hint_ord)) AS r FROM hints GROUP BY doc_id, font) WHERE r = 1""", E.BLOCKS_SQL, E.HINTS_SQL)
def font_mode(spark: SparkSession, sf: str) -> DataFrame:
    return layout.font_mode(E.hints(spark, sf))


@register("""SELECT doc_id, list_sort(list(x0))[CAST(round_even((count(*) - 1) * 0.08::DOUBLE, 0) AS INTEGER) + 1] AS left_margin,
  list_sort(list(y0))[CAST(round_even((count(*) - 1) * 0.08::DOUBLE, 0) AS INTEGER) + 1] AS top_margin, median(size) AS median_size FROM hints GROUP BY doc_id""", E.BLOCKS_SQL, E.HINTS_SQL)
def style_percentile(spark: SparkSession, sf: str) -> DataFrame:
    return E.hints(spark, sf).groupBy("doc_id").agg(
        layout.nearest_rank(F.col("x0"), 0.08).alias("left_margin"), layout.nearest_rank(F.col("y0"), 0.08).alias("top_margin"), F.median("size").alias("median_size")
    )


@register("""SELECT doc_id, coalesce(greatest(8.0::DOUBLE, least(11.0::DOUBLE, median(s))), 9.4::DOUBLE) AS body_size FROM (
  SELECT doc_id, CASE WHEN size BETWEEN 6.0 AND 13.5 AND length(text) > 0 THEN size END AS s, unnest(range(CASE WHEN size BETWEEN 6.0 AND 13.5 AND length(text) > 0 THEN least(30, length(text)) ELSE 1 END)) FROM hints) GROUP BY doc_id""", E.BLOCKS_SQL, E.HINTS_SQL)
def body_median_weighted(spark: SparkSession, sf: str) -> DataFrame:
    return layout.body_size(E.hints(spark, sf))


_TRIMMED = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_SEEN = f"CASE WHEN kind <> 'equation' THEN {_TRIMMED} WHEN {_TRIMMED} = '' THEN '[DISPLAY EQUATION]' ELSE '[DISPLAY EQUATION: ' || left({_TRIMMED}, 260) || ']' END"


@register(rf"""SELECT doc_id, pos, coalesce(right(p.t, 260), '') AS previous_context, coalesce(left(n.t, 260), '') AS next_context,
  p IS NOT NULL AND coalesce(p.k = 'equation' OR NOT regexp_matches(right(p.t, 260), '[.!?。！？]\s*$'), false) AS continues_from_previous,
  n IS NOT NULL AND coalesce(n.k = 'equation' OR NOT regexp_matches(text, '[.!?。！？]\s*$'), false) AS continues_to_next FROM (
  SELECT doc_id, pos, text, last_value(u IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
    first_value(u IGNORE NULLS) OVER (PARTITION BY doc_id, page ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n
  FROM (SELECT *, CASE WHEN kind NOT IN ('footer', 'figure', 'table') AND {_SEEN} <> '' THEN {{'t': {_SEEN}, 'k': kind}} END AS u FROM blocks))""", E.BLOCKS_SQL)
def context_prev_next(spark: SparkSession, sf: str) -> DataFrame:
    return layout.context(E.blocks(spark, sf))


@register("""SELECT doc_id, pos, CASE WHEN vk IN ('figure', 'table') THEN vk END AS visual,
  coalesce(vk IN ('figure', 'table') AND page = vp AND y0 >= vy0 - 8 AND y0 - vy1 <= 150, false) AS bound,
  CASE WHEN vk IS NULL OR vk NOT IN ('figure', 'table') THEN 'left' WHEN x1 - x0 <= (vx1 - vx0) * 0.88 AND abs((x0 + x1) / 2 - (vx0 + vx1) / 2) <= greatest(14, least(34, (vx1 - vx0) * 0.055)) THEN 'center'
    WHEN abs(x0 - vx0) <= greatest(14, least(34, (vx1 - vx0) * 0.055)) THEN 'left' WHEN abs(x1 - vx1) <= greatest(14, least(34, (vx1 - vx0) * 0.055)) THEN 'right' ELSE 'left' END AS alignment
  FROM (SELECT *, lag(kind) OVER w AS vk, lag(page) OVER w AS vp, lag(x0) OVER w AS vx0, lag(x1) OVER w AS vx1, lag(y0) OVER w AS vy0, lag(y1) OVER w AS vy1 FROM blocks
    WHERE kind NOT IN ('footer', 'title', 'author', 'affiliation', 'metadata') AND (text <> '' OR kind IN ('figure', 'table')) WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) WHERE kind = 'caption'""", E.BLOCKS_SQL)
def caption_binding(spark: SparkSession, sf: str) -> DataFrame:
    return layout.captions(E.blocks(spark, sf))


_RUNS = """SELECT doc_id, run, min(v) AS value, min(pos) AS first, max(pos) AS last, count(*) AS n FROM (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY pos) AS BIGINT) AS run FROM (
  SELECT doc_id, pos, v, CAST(v IS DISTINCT FROM lag(v) OVER (PARTITION BY doc_id ORDER BY pos) OR row_number() OVER (PARTITION BY doc_id ORDER BY pos) = 1 AS INTEGER) AS new FROM ({0}))) GROUP BY doc_id, run"""


@register(_RUNS.format("SELECT doc_id, pos, CASE WHEN kind IN ('figure', 'table') THEN 'full' WHEN (x0 + x1) / 2 < 500 THEN 'column1' ELSE 'column2' END AS v FROM blocks"), E.BLOCKS_SQL)
def column_runs(spark: SparkSession, sf: str) -> DataFrame:
    value = F.when(F.col("kind").isin("figure", "table"), "full").otherwise(G.column_of(F.col("x0"), F.col("x1"), F.lit(2)))
    return layout.runs(E.blocks(spark, sf), value)


@register(_RUNS.format("SELECT doc_id, pos, kind = 'list_item' AS v FROM blocks"), E.BLOCKS_SQL)
def list_runs(spark: SparkSession, sf: str) -> DataFrame:
    return layout.runs(E.blocks(spark, sf), F.col("kind") == "list_item")


@register("""SELECT doc_id, pos, least(greatest(0, least(1000, x0)), greatest(0, least(1000, x1)))::DOUBLE AS nx0, greatest(0, least(1000, y1))::DOUBLE AS ny1,
  greatest(0.16::DOUBLE, least(0.995::DOUBLE, 612 * greatest(0, x1 - x0) / 1000 / CASE WHEN kind IN ('figure', 'table') THEN 502.0::DOUBLE ELSE 242.0::DOUBLE END)) AS ratio FROM blocks""", E.BLOCKS_SQL)
def visual_geometry(spark: SparkSession, sf: str) -> DataFrame:
    x0, _, _, y1 = G.normalise(*(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    column = F.when(F.col("kind").isin("figure", "table"), "full").otherwise("column1")
    return E.blocks(spark, sf).select("doc_id", "pos", x0.alias("nx0"), y1.alias("ny1"), G.width_ratio(F.col("x0"), F.col("x1"), column, F.lit(2)).alias("ratio"))


# Batches, resume, integrity


@register("""o AS (SELECT doc_id, pos, length(source) AS len, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM items),
  g AS (SELECT doc_id, pos, i, 0::BIGINT AS batch, 1::BIGINT AS n, len::BIGINT AS c FROM o WHERE i = 1 UNION ALL
    SELECT o.doc_id, o.pos, o.i, g.batch + CAST(f AS BIGINT), CASE WHEN f THEN 1 ELSE g.n + 1 END, CASE WHEN f THEN o.len ELSE g.c + o.len END
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.i = g.i + 1, LATERAL (SELECT g.n >= 10 OR g.c + o.len > 4200 AS f))
  SELECT doc_id, pos, batch FROM g""", E.BLOCKS_SQL, E.ITEMS_SQL)
def greedy_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batching.greedy_batches(E.items(spark, sf))


SQL["greedy_batches"] = SQL["greedy_batches"].replace(") o AS (", "), o AS (", 1)


@register("SELECT doc_id, page, (row_number() OVER (PARTITION BY doc_id ORDER BY page) - 1) // 2 AS batch FROM (SELECT DISTINCT doc_id, page FROM blocks)", E.BLOCKS_SQL)
def page_batches(spark: SparkSession, sf: str) -> DataFrame:
    return batching.page_batches(E.blocks(spark, sf).select("doc_id", "page").distinct())


@register("""o AS (SELECT doc_id, page, x0, row_number() OVER (PARTITION BY doc_id, page ORDER BY x0) AS i FROM hints),
  g AS (SELECT doc_id, page, i, 1::BIGINT AS k, x0 AS s, 1::BIGINT AS n FROM o WHERE i = 1 UNION ALL
    SELECT o.doc_id, o.page, o.i, g.k + CAST(NOT f AS BIGINT), CASE WHEN f THEN g.s + o.x0 ELSE o.x0 END, CASE WHEN f THEN g.n + 1 ELSE 1 END
    FROM g JOIN o ON o.doc_id = g.doc_id AND o.page = g.page AND o.i = g.i + 1, LATERAL (SELECT abs(o.x0 - g.s / g.n) <= 105 AS f))
  SELECT doc_id, page, max(k) AS n_clusters FROM g GROUP BY doc_id, page""", E.BLOCKS_SQL, E.HINTS_SQL)
def cluster_columns(spark: SparkSession, sf: str) -> DataFrame:
    return batching.clusters(E.hints(spark, sf))


SQL["cluster_columns"] = SQL["cluster_columns"].replace(") o AS (", "), o AS (", 1)


@register("""SELECT doc_id, min(s) AS s, max(e) AS e FROM (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY s, e, pos) AS g FROM (
  SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY doc_id ORDER BY s, e, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) OR row_number() OVER (PARTITION BY doc_id ORDER BY s, e, pos) = 1 THEN 1 ELSE 0 END AS n
  FROM (SELECT doc_id, pos, (pos * 37) % 400 AS s, (pos * 37) % 400 + length(text) % 13 AS e FROM blocks))) GROUP BY doc_id, g""", E.BLOCKS_SQL)
def span_merge(spark: SparkSession, sf: str) -> DataFrame:
    s = (F.col("pos") * 37) % 400
    return batching.merge_spans(E.blocks(spark, sf).select("doc_id", s.alias("s"), (s + F.length("text") % 13).alias("e")))


_PH = r"regexp_extract_all({0}, '\[\[MATH_[0-9]+\]\]')"
_REASON = rf"""CASE WHEN trim(coalesce(translated, '')) = '' THEN 'empty' WHEN list_sort({_PH.format('source')}) <> list_sort({_PH.format('translated')}) THEN 'placeholders'
  WHEN contains(translated, '§math{{') THEN 'marker' END"""


@register(f"SELECT doc_id, pos, item_id, {_REASON} AS reason FROM items", E.BLOCKS_SQL, E.ITEMS_SQL)
def placeholder_integrity(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.checked(E.items(spark, sf)).select("doc_id", "pos", "item_id", "reason")


@register(f"SELECT kind, coalesce({_REASON}, 'good') AS reason, count(*) AS n FROM items GROUP BY ALL", E.BLOCKS_SQL, E.ITEMS_SQL)
def translation_quality_reasons(spark: SparkSession, sf: str) -> DataFrame:
    return integrity.checked(E.items(spark, sf)).groupBy("kind", F.coalesce("reason", F.lit("good")).alias("reason")).agg(F.count("*").alias("n"))


@register("SELECT DISTINCT doc_id, page FROM blocks WHERE page % 3 <> 1", E.BLOCKS_SQL)
def pending_pages_anti(spark: SparkSession, sf: str) -> DataFrame:
    pages = E.blocks(spark, sf).select("doc_id", "page").distinct()
    return pages.join(pages.where("page % 3 = 1"), ["doc_id", "page"], "left_anti")


@register(f"SELECT doc_id, pos, source FROM items WHERE {_REASON} IS NOT NULL", E.BLOCKS_SQL, E.ITEMS_SQL)
def untranslated_items_anti(spark: SparkSession, sf: str) -> DataFrame:
    items = E.items(spark, sf)
    good = integrity.checked(items).where("reason is null").select("doc_id", "pos")
    return integrity.pending(items, good).select("doc_id", "pos", "source")


@register(f"SELECT doc_id, pos, CASE WHEN {_REASON} IS NULL THEN translated ELSE source END AS text FROM items", E.BLOCKS_SQL, E.ITEMS_SQL)
def checkpoint_resume(spark: SparkSession, sf: str) -> DataFrame:
    """Stored results that still pass, else the source: what a resumed document shows."""
    items = E.items(spark, sf)
    good = integrity.checked(items).where("reason is null").select("doc_id", "pos", "translated")
    return items.drop("translated").join(good, ["doc_id", "pos"], "left").select("doc_id", "pos", F.coalesce("translated", "source").alias("text"))


_MSG = "CASE job_id % 5 WHEN 0 THEN 'Quota exceeded: GenerateRequestsPerDayPerProjectPerModel retry in 12.5s' WHEN 1 THEN 'INVALID_ARGUMENT responseMimeType' WHEN 2 THEN 'The model is under high demand \"retryDelay\": \"0.2s\"' WHEN 3 THEN 'RESOURCE_EXHAUSTED \"retry_after\": 7' ELSE 'disk full' END"


@register(rf"""SELECT job_id, CASE WHEN regexp_matches(regexp_replace(lower(m), '[^a-z0-9]+', '', 'g'), 'requestsperday|perdayperproject') THEN 'daily_quota'
  WHEN regexp_matches(lower(m), '{"|".join(X.FORMAT_400)}') THEN 'format' WHEN regexp_matches(lower(m), '{"|".join(X.TRANSIENT)}') THEN 'transient' ELSE 'other' END AS class,
  greatest(1.0::DOUBLE, coalesce(TRY_CAST(nullif(regexp_extract(m, '(?i)retry\s+in\s+([0-9]+(?:\.[0-9]+)?)s', 1), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(m, '(?i)"retryDelay"\s*:\s*"([0-9]+(?:\.[0-9]+)?)s"', 1), '') AS DOUBLE),
    TRY_CAST(nullif(regexp_extract(m, '(?i)"retry_after"\s*:\s*([0-9]+(?:\.[0-9]+)?)', 1), '') AS DOUBLE), 60.0::DOUBLE)) AS delay FROM (SELECT job_id, {_MSG} AS m FROM jobs)""", E.JOBS_SQL)
def quota_error_classes(spark: SparkSession, sf: str) -> DataFrame:
    m = E.jobs(spark, sf).select("job_id", F.expr(_MSG.replace('"', '\\"')).alias("m"))
    return m.select("job_id", X.error_class(F.col("m")).alias("class"), X.retry_delay(F.col("m")).alias("delay"))


@register("""SELECT doc_id, max(w) AS width, CAST(sum(n) AS BIGINT) AS n_cells FROM (SELECT doc_id, pos, list_sum([greatest(1, length(c) % 4) FOR c IN string_split(text, ' ')]) AS w, len(string_split(text, ' ')) AS n FROM blocks WHERE kind = 'table') GROUP BY doc_id""", E.BLOCKS_SQL)
def table_widths(spark: SparkSession, sf: str) -> DataFrame:
    cells = F.split("text", " ", -1)
    row = F.struct(F.transform(cells, lambda c: F.struct((F.length(c) % 4).alias("colspan"))).alias("cells"))
    rows = E.blocks(spark, sf).where("kind = 'table'").select("doc_id", K.table_width(F.array(row)).alias("w"), F.size(cells).alias("n"))
    return rows.groupBy("doc_id").agg(F.max("w").alias("width"), F.sum("n").alias("n_cells"))


_LOST = r"regexp_replace(text, '(^| )\p{L}(\p{L}{4,})', '\1§\2', 'g')"
_RESERVED = ", ".join(f"'{w}'" for w in glyphs.RESERVED)


@register()
def glyph_repair(spark: SparkSession, sf: str) -> DataFrame:
    """Words whose first letter was read as a section sign, restored where the source has exactly one word that fits."""
    lost = F.regexp_replace("text", r"(^| )\p{L}(\p{L}{4,})", "$1§$2")
    rows = E.blocks(spark, sf).select("doc_id", "pos", "text", lost.alias("lost"))
    return rows.select("doc_id", "pos", glyphs.repaired(F.col("lost"), F.col("text")).alias("repaired"))


SQL["glyph_repair"] = rf"""WITH {E.BLOCKS_SQL}, t AS (SELECT doc_id, pos, string_split({_LOST}, '§') AS p, regexp_extract_all(text, '\p{{L}}+') AS w FROM blocks),
  parts AS (SELECT doc_id, pos, unnest(p[2:]) AS x, generate_subscripts(p[2:], 1) AS k, w, [{FOLD.format('substr(y, 2)')} FOR y IN w] AS tails FROM t),
  tailed AS (SELECT *, regexp_extract(x, '^\p{{L}}+') AS tail FROM parts),
  found AS (SELECT *, list_position(tails, {FOLD.format('tail')}) AS first FROM tailed),
  mended AS (SELECT doc_id, pos, string_agg(CASE WHEN tail <> '' AND first > 0 AND first = len(tails) + 1 - list_position(list_reverse(tails), {FOLD.format('tail')})
    AND {FOLD.format('tail')} NOT IN ({_RESERVED}) AND length(w[first]) = length(tail) + 1 THEN w[first] || substr(x, length(tail) + 1) ELSE '§' || x END, '' ORDER BY k) AS rest FROM found GROUP BY doc_id, pos)
  SELECT doc_id, pos, p[1] || coalesce(rest, '') AS repaired FROM t LEFT JOIN mended USING (doc_id, pos)"""


@register("""SELECT doc_id, count(*) AS n_front FROM blocks b WHERE pos < (SELECT coalesce(min(pos) FILTER (kind NOT IN ('title', 'author', 'affiliation', 'metadata')), 1000000) FROM blocks c WHERE c.doc_id = b.doc_id) GROUP BY doc_id""", E.BLOCKS_SQL)
def front_matter(spark: SparkSession, sf: str) -> DataFrame:
    """The leading run of title, author, affiliation and metadata blocks."""
    front = F.col("kind").isin("title", "author", "affiliation", "metadata")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    b = E.blocks(spark, sf).select("doc_id", "pos", front.alias("front"))
    return b.withColumn("whole", F.min("front").over(w)).where("whole").groupBy("doc_id").agg(F.count("*").alias("n_front"))


@register(r"""SELECT job_id, CASE WHEN s // 60 > 0 THEN (s // 60) || '분 ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || '초' ELSE (s % 60) || '초' END AS elapsed,
  regexp_replace('Paper_' || job_id || '.PDF', '(?i)\.pdf$', '') || '_ko.pdf' AS result, CAST(58 + round_even(32 * (progress / 97.0::DOUBLE), 0) AS BIGINT) AS percent FROM (SELECT *, (job_id * 777) // 1000 AS s FROM jobs)""", E.JOBS_SQL)
def display_fields(spark: SparkSession, sf: str) -> DataFrame:
    name = F.concat(F.lit("Paper_"), F.col("job_id").cast("string"), F.lit(".PDF"))
    return E.jobs(spark, sf).select(
        "job_id", X.elapsed(F.col("job_id") * 777).alias("elapsed"), F.concat(F.regexp_replace(name, r"(?i)\.pdf$", ""), F.lit("_ko.pdf")).alias("result"),
        (F.lit(58) + F.bround(32 * (F.col("progress") / 97.0))).cast("long").alias("percent"),
    )


_FORMULA = "replace(replace(text, 'th', '{'), 'er', '}') || ' ' || chr(92) || '{'"


@register(rf"""SELECT doc_id, pos, CASE WHEN list_min(d) < 0 THEN 'extra closing brace' WHEN d[-1] > 0 THEN d[-1] || ' unmatched opening brace(s)' END AS problem
  FROM (SELECT doc_id, pos, [length(replace(t[1:i], '}}', '')) - length(replace(t[1:i], '{{', '')) FOR i IN range(1, length(t) + 1)] AS d
    FROM (SELECT doc_id, pos, regexp_replace(regexp_replace({_FORMULA}, '\\[{{}}]', '', 'g'), '[^{{}}]', '', 'g') AS t FROM blocks))""", E.BLOCKS_SQL)
def brace_balance(spark: SparkSession, sf: str) -> DataFrame:
    math = F.concat(F.replace(F.replace("text", F.lit("th"), F.lit("{")), F.lit("er"), F.lit("}")), F.lit(" \\{"))
    return E.blocks(spark, sf).select("doc_id", "pos", T.brace_error(math).alias("problem"))


@register(r"""SELECT doc_id, pos, len(list_filter(p, lambda x: x <> '')) + len(p) - 1 + CASE WHEN text = '' THEN 1 ELSE 0 END AS n_parts, len(p) - 1 AS n_math FROM (SELECT doc_id, pos, text, string_split(text, ' of ') AS p FROM blocks)""", E.BLOCKS_SQL)
def leaked_math_parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of prose in which each ' of ' is replaced by a math wrapper within another."""
    parts = T.split_wrapped(F.replace("text", F.lit(" of "), F.lit("§math{$math{x_{1}}}")))
    n = E.blocks(spark, sf).select("doc_id", "pos", parts.alias("p"))
    return n.select("doc_id", "pos", F.size("p").cast("long").alias("n_parts"), F.size(F.filter("p", lambda x: x["kind"] == "math")).cast("long").alias("n_math"))


@register(r"""SELECT doc_id, pos, CASE pos % 3 WHEN 0 THEN '{C_A}_' || pos % 10 WHEN 1 THEN '{x_{i}^2}_' || pos % 10 || ' + y^a' ELSE chr(92) || 'frac{{a_1}_2}{b}' END AS formula FROM blocks""", E.BLOCKS_SQL)
def repeated_scripts(spark: SparkSession, sf: str) -> DataFrame:
    digit = (F.col("pos") % 10).cast("string")
    raw = F.when(F.col("pos") % 3 == 0, F.concat(F.lit("C_A_"), digit)).when(F.col("pos") % 3 == 1, F.concat(F.lit("x_{i}^2_"), digit, F.lit(" + y^a"))).otherwise("\\frac{a_1_2}{b}")
    return E.blocks(spark, sf).select("doc_id", "pos", T.group_scripts(raw).alias("formula"))


@register("SELECT doc_id, pos, item_id, CASE WHEN true THEN 'identity' END AS provider, source AS translated FROM items", E.BLOCKS_SQL, E.ITEMS_SQL)
def provider_identity(spark: SparkSession, sf: str) -> DataFrame:
    return providers.translate(E.items(spark, sf), [providers.Identity()]).drop("calls", "reason")


def _crowded(spark: SparkSession, sf: str) -> DataFrame:
    """Hints, and for every third one a second, larger and a little lower, that comes just after it."""
    h = E.hints(spark, sf).withColumn("hint_ord", F.col("hint_ord") * 2)
    again = h.where("(doc_id + hint_ord) % 3 = 0").withColumns({"hint_ord": F.col("hint_ord") + 1, "x0": F.col("x0") - 20, "y0": F.col("y0") + 12, "x1": F.col("x1") + 30, "y1": F.col("y1") + 45})
    return h.unionByName(again)


@register("""crowded AS (SELECT doc_id, page, hint_ord * 2 AS hint_ord, text, x0, y0, x1, y1 FROM hints UNION ALL
    SELECT doc_id, page, hint_ord * 2 + 1, text, x0 - 20, y0 + 12, x1 + 30, y1 + 45 FROM hints WHERE (doc_id + hint_ord * 2) % 3 = 0),
  lost AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY hint_ord) AS i FROM crowded h WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = h.doc_id AND b.page = h.page AND (
    greatest(0.0::DOUBLE, least(b.x1, h.x1) - greatest(b.x0, h.x0)) * greatest(0.0::DOUBLE, least(b.y1, h.y1) - greatest(b.y0, h.y0)) >= 0.42 * ((h.x1 - h.x0) * (h.y1 - h.y0))
    OR ((h.x0 + h.x1) / 2 BETWEEN b.x0 AND b.x1 AND (h.y0 + h.y1) / 2 BETWEEN b.y0 AND b.y1)))),
  fold AS (SELECT doc_id, page, 1::BIGINT AS i, [hint_ord] AS inside, [{'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}] AS boxes FROM lost WHERE i = 1 UNION ALL
    SELECT f.doc_id, f.page, l.i, CASE WHEN hit THEN inside ELSE list_append(inside, hint_ord) END, CASE WHEN hit THEN boxes ELSE list_append(boxes, {'x0': x0, 'y0': y0, 'x1': x1, 'y1': y1}) END
    FROM fold f JOIN lost l ON l.doc_id = f.doc_id AND l.page = f.page AND l.i = f.i + 1, LATERAL (SELECT len(list_filter(f.boxes, lambda b:
      greatest(0.0::DOUBLE, least(b.x1, l.x1) - greatest(b.x0, l.x0)) * greatest(0.0::DOUBLE, least(b.y1, l.y1) - greatest(b.y0, l.y0)) >= 0.42 * ((l.x1 - l.x0) * (l.y1 - l.y0))
      OR ((l.x0 + l.x1) / 2 BETWEEN b.x0 AND b.x1 AND (l.y0 + l.y1) / 2 BETWEEN b.y0 AND b.y1))) > 0 AS hit) t)
  SELECT doc_id, page, unnest(inside) AS hint_ord FROM (SELECT * FROM fold QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY i DESC) = 1)""", E.BLOCKS_SQL, E.HINTS_SQL)
def sequential_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Hints that come in one after another: each that no block covers, and none that came in before it."""
    b, h = E.blocks(spark, sf), _crowded(spark, sf)
    placed = layout.insert_by_geometry(b, layout.uncovered(h, b), stabilise.column_hint(h), share=0.42)
    return placed.where("origin = 1").select("doc_id", "page", F.col("num").alias("hint_ord"))


SQL["sequential_recovery"] = SQL["sequential_recovery"].replace(") crowded AS (", "), crowded AS (", 1)


@register()
def geometry_insertion(spark: SparkSession, sf: str) -> DataFrame:
    """Measured hints that no block covers, put into their page's order."""
    b, h = E.blocks(spark, sf), E.hints(spark, sf)
    return layout.insert_by_geometry(b, layout.uncovered(h, b), stabilise.column_hint(h))


@register("""o AS (SELECT user_id, event_id, at_ms, CASE WHEN event_id % 7 = 0 THEN at_ms + 9000 END AS free_ms, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, event_id) AS i
    FROM (SELECT user_id, event_id, epoch_us(ts) // 600000 AS at_ms FROM events)),
  g AS (SELECT user_id, event_id, i, greatest(at_ms, coalesce(free_ms, at_ms)) AS start_ms FROM o WHERE i = 1 UNION ALL
    SELECT o.user_id, o.event_id, o.i, greatest(o.at_ms, coalesce(o.free_ms, o.at_ms), g.start_ms + 3334) FROM g JOIN o ON o.user_id = g.user_id AND o.i = g.i + 1)
  SELECT user_id, event_id, start_ms FROM g""")
def rate_slots(spark: SparkSession, sf: str) -> DataFrame:
    at = F.expr("unix_micros(cast(ts as timestamp)) div 600000")
    e = E.read(spark, sf, "events").select("user_id", "event_id", at.alias("at_ms"))
    return batching.request_slots(e.withColumn("free_ms", F.when(F.col("event_id") % 7 == 0, F.col("at_ms") + 9000)))


SQL["rate_slots"] = "WITH RECURSIVE " + SQL["rate_slots"]


@register("""SELECT doc_id, page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1
  FROM blocks WHERE x1 > x0 AND y1 > y0 GROUP BY doc_id, page""", E.BLOCKS_SQL)
def page_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Union of a page's boxes that have an area."""
    some = E.blocks(spark, sf).where("x1 > x0 and y1 > y0")
    return some.groupBy("doc_id", "page").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


@register("SELECT doc_id, sha256(text) AS source_sha256, length(text) >= 3 AND length(text) * (doc_id % 4 + 1) > greatest(2.4 * length(text), length(text) + 12) AS implausible FROM documents WHERE text IS NOT NULL")
def source_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Hash of each source, and whether an output of one to four times its length is implausible."""
    n, out = F.length("text"), F.length(F.repeat("text", (F.col("doc_id") % 4 + 1).cast("int")))
    return E.read(spark, sf, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("source_sha256"), X.implausible(n, out).alias("implausible"))


GLOSSARY = ("the", "ther", "ing", "of", "der")
_KEPT_SQL = rf"""kept AS (SELECT doc_id, pos, source, f, array_to_string([p[i] || CASE WHEN i <= len(f) THEN 'QZKEEP' || (i - 1) || 'ZQ' ELSE '' END FOR i IN range(1, len(p) + 1)], '') AS safe
  FROM (SELECT *, regexp_extract_all(source, '{P.PLACEHOLDER}|ther|the|ing|der|of') AS f, string_split_regex(source, '{P.PLACEHOLDER}|ther|the|ing|der|of') AS p FROM items))"""


@register("SELECT doc_id, pos, safe, len(f) AS n_kept FROM kept", E.BLOCKS_SQL, E.ITEMS_SQL, _KEPT_SQL)
def term_protection(spark: SparkSession, sf: str) -> DataFrame:
    source = F.col("source")
    return E.items(spark, sf).select("doc_id", "pos", P.protected(source, GLOSSARY).alias("safe"), F.size(P.held(source, GLOSSARY)).cast("long").alias("n_kept"))


_BRANDS = r"""terms AS (SELECT DISTINCT p_brand AS glossary_id, left(w, 3) AS term FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)
    UNION SELECT DISTINCT p_brand, left(w, 2) FROM (SELECT p_brand, unnest(string_split(p_name, ' ')) AS w FROM part)),
  patterns AS (SELECT glossary_id, string_agg(term, '|' ORDER BY length(term) DESC, term) AS p FROM terms GROUP BY glossary_id),
  found AS (SELECT i.doc_id, i.pos, regexp_extract_all(source, '\[\[MATH_[0-9]+\]\]' || coalesce('|' || p, '')) AS f, string_split_regex(source, '\[\[MATH_[0-9]+\]\]' || coalesce('|' || p, '')) AS g
    FROM items i LEFT JOIN patterns ON glossary_id = 'Brand#' || (1 + doc_id % 5) || (1 + pos % 5))"""


@register("""SELECT doc_id, pos, array_to_string([g[i] || CASE WHEN i <= len(f) THEN 'QZKEEP' || (i - 1) || 'ZQ' ELSE '' END FOR i IN range(1, len(g) + 1)], '') AS safe, array_to_string(f, '|') AS kept FROM found""", E.BLOCKS_SQL, E.ITEMS_SQL, _BRANDS)
def glossary_protection(spark: SparkSession, sf: str) -> DataFrame:
    """Each text's placeholders and the terms of its own glossary, a brand's parts, exchanged for tokens."""
    words = E.read(spark, sf, "part").select(F.col("p_brand").alias("glossary_id"), F.explode(F.split("p_name", " ")).alias("w"))
    terms = words.select("glossary_id", F.explode(F.array(F.left("w", F.lit(3)), F.left("w", F.lit(2)))).alias("term"))
    own = F.concat(F.lit("Brand#"), (1 + F.col("doc_id") % 5).cast("string"), (1 + F.col("pos") % 5).cast("string"))
    made = glossary.protected_by(E.items(spark, sf).withColumn("glossary_id", own), terms)
    return made.select("doc_id", "pos", "safe", F.array_join("kept", "|").alias("kept"))


@register("""SELECT doc_id, pos, CASE WHEN pos % 3 = 2 THEN 'unknown' WHEN pos % 3 = 1 AND len(f) > 0 THEN 'missing' END AS reason,
  CASE WHEN pos % 3 = 0 OR (pos % 3 = 1 AND len(f) = 0) THEN source END AS restored FROM kept""", E.BLOCKS_SQL, E.ITEMS_SQL, _KEPT_SQL)
def term_restoration(spark: SparkSession, sf: str) -> DataFrame:
    """Results that keep all tokens, lose one or invent one."""
    safe, third = P.protected(F.col("source"), GLOSSARY), F.col("pos") % 3
    out = F.when(third == 0, F.col("safe")).when(third == 1, F.replace("safe", F.lit("QZKEEP0ZQ"), F.lit(""))).otherwise(F.concat("safe", F.lit(" QZKEEP9999ZQ")))
    rows = E.items(spark, sf).select("doc_id", "pos", safe.alias("safe"), P.held(F.col("source"), GLOSSARY).alias("kept"))
    rows = rows.withColumn("out", out)
    return rows.select("doc_id", "pos", P.restore_fault(F.col("out"), F.col("kept")).alias("reason"), P.restored(F.col("out"), F.col("kept")).alias("restored"))


def entry(spark: SparkSession, sf: str = "/root/testdata/sf0.001") -> DataFrame:
    """The flagship query."""
    return prose_coverage_by_lang(spark, sf).orderBy("lang", "source")
