"""Chat formatting by multi-party perspective rotation, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import materialize


def escape(text: Column) -> Column:
    """Text that cannot be taken for a header: a backslash goes between < and |, one more where some stand already.
    Taking one backslash out of each such place gives the text back."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


END = "<|end|>\n"


def rotate_perspectives(turns: DataFrame, chunk: int = 1024, crowd: int = 4096) -> DataFrame:
    """Render each dialogue once for every participant, with that speaker as the assistant.

    turns has conv_id, turn, role and text. Participants of a dialogue are its different roles, trimmed, other
    than ``system`` in any case; names that differ by case are different people; a null or blank role speaks as
    ``unknown``. One row per dialogue, participant (perspective) and turn: turn_index (from 0, by turn, null turns
    first, then by md5 of role and text), role_out (``assistant`` for the perspective's own turns, ``system`` for
    system turns, else ``user``), name (the speaker of a user turn, else null), rendered (header, content and end
    mark), mask (1 if the turn is trained on), start and length (characters of the turn in the rendered dialogue),
    content_start and content_length: the characters to train on where mask is 1, without header and end mark.
    The concatenation of rendered in order of turn_index is the dialogue.

    Content is escaped (:func:`escape`), and in header names line ends, < > and | become _, so no text or role forges
    a turn. Null text is empty text. Repeated rows are turns of their own. A dialogue of system turns only has
    no participant and no rows. Other columns are ignored. Rows stay turns: a dialogue is never gathered
    into one value, and running totals are taken first in chunks of turn numbers, then over chunks, and
    turns meet participants by chunk, so a dialogue that holds much of the table is not one task. A turn number with more than ``crowd`` rows is chunked by
    md5 as well, and equal rows under it are counted first.
    """
    trimmed = F.coalesce(F.nullif(F.trim("role"), F.lit("")), F.lit("unknown"))
    speaker = F.when(F.lower(trimmed) == "system", "system").otherwise(trimmed)
    said = turns.select("conv_id", "turn", speaker.alias("speaker"), F.coalesce("text", F.lit("")).alias("text"))
    kind = turns.schema["conv_id"].dataType
    # A dialogue's key without nulls, so that joins and windows share one partitioning.
    key = ["c", "c_null"]
    said = said.withColumns({"c": F.coalesce("conv_id", F.lit("0").cast(kind)), "c_null": F.col("conv_id").isNull()})
    chunk_no = lambda turn: F.coalesce(F.floor(F.col(turn) / chunk), F.lit(-(2**62)))
    said = said.withColumns({"tie": F.md5(F.concat("speaker", F.lit("\n"), "text").cast("binary")), "part": chunk_no("turn")})
    said = said.withColumns({"copies": F.lit(1).cast("long"), "sub": F.lit("")})
    crowded = materialize(said.groupBy(*key, "turn").agg(F.count("*").alias("n")).where(F.col("n") > crowd).drop("n"))
    if not crowded.isEmpty():
        said = _thinned(said, crowded, key, chunk)

    said = said.withColumn("turn_key", F.struct(F.col("turn").isNotNull(), F.col("turn"))).drop("conv_id", "turn")
    speakers = said.where("speaker <> 'system'").select(*key, F.col("speaker").alias("perspective")).distinct()
    own = F.col("speaker") == F.col("perspective")
    role_out = F.when(F.col("speaker") == "system", "system").when(own, "assistant").otherwise("user")
    name = F.when(role_out == "user", F.col("speaker"))
    shown = F.concat(F.lit(" name="), F.regexp_replace(name, r"[\r\n<>|]", "_"))
    head = F.concat(F.lit("<|"), role_out, F.coalesce(shown, F.lit("")), F.lit("|>\n"))
    content = escape(F.col("text"))
    # By dialogue and chunk: so the windows' rows are dealt by both, and no task has a whole dialogue.
    present = said.select(*key, "part").distinct().join(speakers, key)
    turn = said.join(present, [*key, "part"])
    length = (F.length(head) + F.length(content) + len(END)).cast("long")

    places = [*key, "perspective", "part", "sub"]
    before = Window.partitionBy(*places).orderBy("turn_key", "tie").rowsBetween(Window.unboundedPreceding, -1)
    size = F.col("length") * F.col("copies")
    sized = turn.withColumn("length", length)
    local = sized.withColumns({"i": F.coalesce(F.sum("copies").over(before), F.lit(0)), "c_at": F.coalesce(F.sum(size).over(before), F.lit(0))})
    over_parts = Window.partitionBy(*key, "perspective").orderBy("part", "sub").rowsBetween(Window.unboundedPreceding, -1)
    totals = sized.groupBy(*places).agg(F.sum("copies").alias("n"), F.sum(size).alias("chars"))
    totals = totals.select(*places, F.coalesce(F.sum("n").over(over_parts), F.lit(0)).alias("n0"), F.coalesce(F.sum("chars").over(over_parts), F.lit(0)).alias("c0"))
    placed = local.join(totals, places)
    start = F.col("c0") + F.col("c_at") + F.col("k") * F.col("length")
    if not crowded.isEmpty():
        placed = placed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    else:
        placed = placed.withColumn("k", F.lit(0))
    return placed.select(
        F.when(~F.col("c_null"), F.col("c")).alias("conv_id"),
        "perspective",
        (F.col("n0") + F.col("i") + F.col("k")).cast("long").alias("turn_index"),
        role_out.alias("role_out"),
        name.alias("name"),
        F.concat(head, content, F.lit(END)).alias("rendered"),
        own.cast("int").alias("mask"),
        start.cast("long").alias("start"),
        "length",
        (start + F.length(head)).cast("long").alias("content_start"),
        F.length(content).cast("long").alias("content_length"),
    )


def _thinned(said: DataFrame, crowded: DataFrame, key: list[str], chunk: int) -> DataFrame:
    """Turns of crowded numbers counted if equal, and chunked by md5; their neighbours keep their place by the same key."""
    at = [F.col(f"s.{c}") == F.col(f"x.{c}") for c in key] + [F.col("s.turn").eqNullSafe(F.col("x.turn"))]
    number = F.coalesce(F.lpad(F.pmod("turn", F.lit(chunk)).cast("string"), 9, "0"), F.lit(""))
    calm = said.alias("s").join(crowded.alias("x"), at, "left_anti")
    dense = said.alias("s").join(crowded.alias("x"), at, "left_semi").drop("copies").groupBy(*[c for c in said.columns if c != "copies"])
    dense = dense.agg(F.count("*").alias("copies")).withColumn("sub", F.concat(number, F.substring("tie", 1, 3)))
    chunks = crowded.select(*key, F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(2**62))).alias("part"), F.lit(True).alias("near")).distinct()
    calm = calm.join(chunks, [*key, "part"], "left").withColumn("sub", F.when(F.col("near"), number).otherwise("")).drop("near")
    return calm.select(*said.columns).unionByName(dense.select(*said.columns))


#: The same rows from DuckDB; it states the rendering without chunks.
ROTATION_SQL = r"""
WITH said AS (
  SELECT conv_id, turn, CASE WHEN lower(r) = 'system' THEN 'system' ELSE r END AS speaker, text
  FROM (SELECT conv_id, turn, coalesce(nullif(trim(role), ''), 'unknown') AS r, coalesce(text, '') AS text FROM conversations)
), people AS (
  SELECT DISTINCT conv_id, speaker AS perspective FROM said WHERE speaker <> 'system'
), cast_turns AS (
  SELECT s.conv_id, p.perspective, s.turn, s.speaker, s.text, md5(s.speaker || chr(10) || s.text) AS tie,
    CASE WHEN s.speaker = 'system' THEN 'system' WHEN s.speaker = p.perspective THEN 'assistant' ELSE 'user' END AS role_out
  FROM said s JOIN people p ON s.conv_id IS NOT DISTINCT FROM p.conv_id
), headed AS (
  SELECT *, CASE WHEN role_out = 'user' THEN speaker END AS name,
    '<|' || role_out || CASE WHEN role_out = 'user' THEN ' name=' || regexp_replace(speaker, '[\r\n<>|]', '_', 'g') ELSE '' END || '|>' || chr(10) AS head,
    regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS content
  FROM cast_turns
), rendered AS (
  SELECT *, head || content || '<|end|>' || chr(10) AS rendered FROM headed
), placed AS (
  SELECT *, row_number() OVER w - 1 AS turn_index,
    CAST(coalesce(sum(length(rendered)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, tie, speaker, text
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM rendered
  WINDOW w AS (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, tie, speaker, text)
)
SELECT conv_id, perspective, turn_index, role_out, name, rendered, CAST(role_out = 'assistant' AS INTEGER) AS mask, start,
  CAST(length(rendered) AS BIGINT) AS length, CAST(start + length(head) AS BIGINT) AS content_start,
  CAST(length(content) AS BIGINT) AS content_length
FROM placed
"""
