"""Job, block, hint and heartbeat tables derived from the driver's tables by fixed integer arithmetic.

Each function returns a lazy DataFrame; ``*_SQL`` states the same rows for DuckDB as a common table
expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kinds of block, in order.
KINDS = (
    "title", "author", "affiliation", "metadata", "abstract", "section", "subsection", "paragraph",
    "list_item", "equation", "figure", "table", "caption", "reference", "footer",
)
#: The moment that stands for "now" in queue queries.
AS_OF = "1998-06-15 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered text blocks with a page, a kind and a box: one per line of a document."""
    lines = read(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "text"))
    x0 = F.lit(60) + 440 * (F.col("pos") % 2)
    ordinal = F.col("pos") % 8
    y0 = F.lit(40) + 110 * ordinal + (F.col("doc_id") * 31 + F.col("pos") * 17) % 23
    return lines.select(
        "doc_id",
        "pos",
        "text",
        F.floor(F.col("pos") / 8).cast("int").alias("page"),
        ordinal.alias("ord"),
        F.element_at(F.array(*map(F.lit, KINDS)), ((F.col("doc_id") * 7 + F.col("pos")) % 15 + 1).cast("int")).alias("kind"),
        x0.cast("double").alias("x0"),
        y0.cast("double").alias("y0"),
        (x0 + 380).cast("double").alias("x1"),
        (y0 + 90).cast("double").alias("y1"),
    )


BLOCKS_SQL = """blocks AS (
  SELECT doc_id, pos, text, CAST(pos // 8 AS INTEGER) AS page, pos % 8 AS ord,
    [%s][CAST((doc_id * 7 + pos) %% 15 AS INTEGER) + 1] AS kind,
    CAST(60 + 440 * (pos %% 2) AS DOUBLE) AS x0,
    CAST(40 + 110 * (pos %% 8) + (doc_id * 31 + pos * 17) %% 23 AS DOUBLE) AS y0,
    CAST(60 + 440 * (pos %% 2) + 380 AS DOUBLE) AS x1,
    CAST(40 + 110 * (pos %% 8) + (doc_id * 31 + pos * 17) %% 23 + 90 AS DOUBLE) AS y1
  FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM documents)
)""".replace("pos % 8 AS ord", "pos %% 8 AS ord") % ", ".join(f"'{k}'" for k in KINDS)


def hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measured text boxes near the blocks: shifted, some missing, some in two halves."""
    b = blocks(spark, sf_dir).where("pos % 5 <> 4")
    dx = (F.col("doc_id") * 13 + F.col("pos") * 29) % 37 - 18
    dy = (F.col("doc_id") * 7 + F.col("pos") * 11) % 31 - 15 + F.when((F.col("doc_id") + F.col("pos")) % 9 == 0, 110).otherwise(0)
    halves = F.when(F.col("pos") % 11 == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    b = b.withColumns({"dx": dx, "dy": dy, "n": F.size(halves)}).withColumn("h", F.explode(halves))
    tall = F.lit(90.0) / F.col("n")
    y0 = F.col("y0") + F.col("dy") + F.col("h") * tall
    return b.select(
        "doc_id",
        "page",
        (F.col("pos") * 2 + F.col("h")).alias("hint_ord"),
        "text",
        F.element_at(F.array(*map(F.lit, ("Times", "Arial-Bold", "CMMI10", "Times-Italic"))), ((F.col("doc_id") + F.col("pos")) % 4 + 1).cast("int")).alias("font"),
        (F.lit(7.0) + (F.col("pos") * 7 + F.col("doc_id")) % 9).alias("size"),
        (((F.col("doc_id") + F.col("pos") * 3) % 11) / 10.0).alias("bold_ratio"),
        (((F.col("doc_id") * 3 + F.col("pos")) % 11) / 10.0).alias("italic_ratio"),
        (((F.col("doc_id") * 5 + F.col("pos") * 7) % 13 - 3) / 5.0).alias("em"),
        (F.col("x0") + F.col("dx")).alias("x0"),
        y0.alias("y0"),
        (F.col("x1") + F.col("dx")).alias("x1"),
        (y0 + tall).alias("y1"),
    )


HINTS_SQL = """hints AS (
  SELECT doc_id, page, pos * 2 + h AS hint_ord, text,
    ['Times', 'Arial-Bold', 'CMMI10', 'Times-Italic'][CAST((doc_id + pos) % 4 AS INTEGER) + 1] AS font,
    7.0::DOUBLE + (pos * 7 + doc_id) % 9 AS size,
    ((doc_id + pos * 3) % 11) / 10.0::DOUBLE AS bold_ratio, ((doc_id * 3 + pos) % 11) / 10.0::DOUBLE AS italic_ratio,
    ((doc_id * 5 + pos * 7) % 13 - 3) / 5.0::DOUBLE AS em,
    x0 + dx AS x0, y0 + dy + h * (90.0::DOUBLE / n) AS y0, x1 + dx AS x1, y0 + dy + h * (90.0::DOUBLE / n) + 90.0::DOUBLE / n AS y1
  FROM (
    SELECT *, (doc_id * 13 + pos * 29) % 37 - 18 AS dx,
      (doc_id * 7 + pos * 11) % 31 - 15 + CASE WHEN (doc_id + pos) % 9 = 0 THEN 110 ELSE 0 END AS dy,
      CASE WHEN pos % 11 = 3 THEN 2 ELSE 1 END AS n,
      unnest(CASE WHEN pos % 11 = 3 THEN [0, 1] ELSE [0] END) AS h
    FROM blocks WHERE pos % 5 <> 4
  )
)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job rows from orders."""
    o = read(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "O", "queued").otherwise("processing")
    beat = F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 90)")
    return o.select(
        F.col("o_orderkey").alias("job_id"),
        F.col("o_custkey").alias("user_id"),
        status.alias("status"),
        F.col("o_orderdate").alias("created_at"),
        (F.col("o_orderkey") % 10).alias("attempts"),
        (F.col("o_orderkey") % 97).alias("progress"),
        F.when(F.col("o_orderkey") % 3 != 0, beat).alias("last_dispatch"),
        F.when(F.col("o_orderkey") % 7 != 0, F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 120)")).alias("heartbeat_at"),
        (F.col("o_orderkey") % 11 != 0).alias("active"),
        F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("worker "), F.col("o_orderkey").cast("string"))).when(F.col("o_orderkey") % 5 == 1, F.lit("  ")).otherwise(F.concat(F.lit("page "), F.col("o_orderkey").cast("string"))).alias("message"),
    )


JOBS_SQL = """jobs AS (
  SELECT o_orderkey AS job_id, o_custkey AS user_id,
    CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'O' THEN 'queued' ELSE 'processing' END AS status,
    o_orderdate AS created_at, o_orderkey % 10 AS attempts, o_orderkey % 97 AS progress,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate + to_seconds(CAST(o_orderkey % 90 AS INTEGER)) END AS last_dispatch,
    CASE WHEN o_orderkey % 7 <> 0 THEN o_orderdate + to_seconds(CAST(o_orderkey % 120 AS INTEGER)) END AS heartbeat_at,
    o_orderkey % 11 <> 0 AS active,
    CASE o_orderkey % 5 WHEN 0 THEN 'worker ' || o_orderkey WHEN 1 THEN '  ' ELSE 'page ' || o_orderkey END AS message
  FROM orders
)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dispatch responses for three quarters of the jobs."""
    o = read(spark, sf_dir, "orders").where("o_orderkey % 4 <> 3")
    codes = F.array(*[F.lit(x).cast("int") for x in (200, 204, 401, 403, 404, 500, None)])
    return o.select(
        F.col("o_orderkey").alias("request_id"),
        F.element_at(codes, (F.col("o_orderkey") % 7 + 1).cast("int")).alias("status_code"),
        F.when(F.col("o_orderkey") % 14 == 6, "timeout").alias("error_msg"),
    )


RESPONSES_SQL = """responses AS (
  SELECT o_orderkey AS request_id, [200, 204, 401, 403, 404, 500, NULL][CAST(o_orderkey % 7 AS INTEGER) + 1] AS status_code,
    CASE WHEN o_orderkey % 14 = 6 THEN 'timeout' END AS error_msg
  FROM orders WHERE o_orderkey % 4 <> 3
)"""


def heartbeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Client signals from events."""
    action = F.when(F.col("event_type") == "error", "disconnect").when(F.col("event_type") == "signup", "resume").otherwise("heartbeat")
    return read(spark, sf_dir, "events").select(
        "event_id", "user_id", "ts", action.alias("action"), F.col("value"), F.concat_ws(" ", F.lit("step"), (F.col("event_id") % 3).cast("string")).alias("message")
    )


HEARTBEATS_SQL = """heartbeats AS (
  SELECT event_id, user_id, ts, CASE event_type WHEN 'error' THEN 'disconnect' WHEN 'signup' THEN 'resume' ELSE 'heartbeat' END AS action, value, 'step ' || event_id % 3 AS message
  FROM events
)"""


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translation items with a numbered placeholder after the third word of some, and a faulty result."""
    b = blocks(spark, sf_dir).where("kind not in ('figure', 'table', 'footer', 'equation')")
    words = F.split("text", " ", -1)
    marked = F.when(
        ((F.col("doc_id") + F.col("ord")) % 4 == 0) & (F.size(words) > 4),
        F.concat_ws(" ", F.slice(words, 1, 3), F.lit("[[MATH_0]]"), F.slice(words, 4, 2), F.lit("[[MATH_1]]"), F.slice(words, F.lit(6), F.size(words))),
    ).otherwise(F.col("text"))
    k = F.col("doc_id") * 5 + F.col("pos")
    source = F.col("source")
    out = (
        F.when(k % 13 == 0, F.replace(source, F.lit("[[MATH_1]]"), F.lit("")))
        .when(k % 17 == 0, F.replace(source, F.lit("[[MATH_0]]"), F.lit("[[MATH_0]] [[MATH_0]]")))
        .when(k % 19 == 0, F.replace(source, F.lit("[[MATH_0]]"), F.lit("[[MATH_7]]")))
        .when(k % 23 == 0, F.lit(""))
        .when(k % 29 == 0, F.concat(source, F.lit(" §math{x}")))
        .when(k % 31 == 0, F.lit("   "))
        .when(k % 37 == 0, F.lit(None))
        .when(k % 41 == 0, F.concat(source, F.lit(" §times §alpha_1")))
        .otherwise(source)
    )
    item_id = F.concat(F.lit("p"), F.col("page").cast("string"), F.lit("_b"), F.col("ord").cast("string"))
    return b.withColumn("source", marked).select("doc_id", "pos", item_id.alias("item_id"), "kind", "source", out.alias("translated"))


ITEMS_SQL = """items AS (
  SELECT doc_id, pos, 'p' || page || '_b' || ord AS item_id, kind, source,
    CASE WHEN k % 13 = 0 THEN replace(source, '[[MATH_1]]', '') WHEN k % 17 = 0 THEN replace(source, '[[MATH_0]]', '[[MATH_0]] [[MATH_0]]')
      WHEN k % 19 = 0 THEN replace(source, '[[MATH_0]]', '[[MATH_7]]') WHEN k % 23 = 0 THEN '' WHEN k % 29 = 0 THEN source || ' §math{x}'
      WHEN k % 31 = 0 THEN '   ' WHEN k % 37 = 0 THEN NULL WHEN k % 41 = 0 THEN source || ' §times §alpha_1' ELSE source END AS translated
  FROM (
    SELECT *, doc_id * 5 + pos AS k, CASE WHEN (doc_id + ord) % 4 = 0 AND len(w) > 4
      THEN array_to_string(w[1:3] || ['[[MATH_0]]'] || w[4:5] || ['[[MATH_1]]'] || w[6:], ' ') ELSE text END AS source
    FROM (SELECT *, string_split(text, ' ') AS w FROM blocks WHERE kind NOT IN ('figure', 'table', 'footer', 'equation'))
  )
)"""
