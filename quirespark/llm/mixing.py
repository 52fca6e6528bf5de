"""Mixing sources to target weights: repetition rates by source, whole copies, and one hash-seeded Bernoulli copy.

DataFrame functions only. Documents become narrow rows once (size and a uniform draw, no text); sources are counted from
them with combining; a source's target is found by filling weights up to each source's cap with whole-number sums, so that
reruns agree to the bit. Rates are joined back by source: broadcast if the sources are few by count, else with the
documents of each source dealt over salts.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import discard, materialize, ranked

WORD = r"[^\x20\x09-\x0D]+"
FEW_SOURCES = 100_000  # rates of so many sources are broadcast at most (some 10 MB)
SALTS = 64


def draw(seed: int, doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number in [0, 2^32) from md5 of seed, id and text; rows that agree in both share it."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: Fraction, cap: int) -> DataFrame:
    """(source, source_size, target): ``sizes`` has one row for each source, with its size.

    Sources in order of code points (null last) weigh ``weights``, repeating, and share ``share`` times all sizes. A target
    stops at ``cap`` times its source's size; what is over is shared again by weight until none is above. Each round sums two
    whole numbers over all sources; a source that is over once stays at its cap.
    """
    placed = ranked(sizes, [F.col("source").asc_nulls_last()], "place")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("place") - 1) % len(weights) + 1).cast("int"))
    rows = placed.select("source", F.col("size").alias("source_size"), weight.cast("long").alias("weight"))
    total = Fraction(rows.agg(F.sum("source_size")).first()[0] or 0) * share
    over, level = F.lit(False), Fraction(0)
    n_over = -1
    while True:
        got = rows.agg(
            F.coalesce(F.sum(F.when(over, F.col("source_size"))), F.lit(0)).alias("capped"),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)).alias("open"),
            F.count(F.when(over, 1)).alias("n"),
        ).first()
        if got.n == n_over or not got.open:
            break
        n_over = got.n
        level = (total - cap * got.capped) / got.open  # words for each unit of weight
        # cap * size < level * weight, in whole numbers that no sum of sizes makes too large for a decimal
        over = (F.col("source_size").cast("decimal(38,0)") * cap * F.lit(level.denominator).cast("decimal(38,0)")) <= (
            F.col("weight").cast("decimal(38,0)") * F.lit(str(level.numerator)).cast("decimal(38,0)")
        )
    target = F.when(over, F.col("source_size") * F.lit(float(cap))).otherwise(F.col("weight") * F.lit(float(level)))
    out = materialize(rows.select("source", "source_size", target.cast("double").alias("target")))
    out._quire_rows = placed._quire_rows
    discard(placed)
    return out


def _rates(sizes: DataFrame, weights: Sequence[int], percent: int, cap: int) -> DataFrame:
    """Targets with the rate of each source: how often a document of it is taken on average."""
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("size")), weights, Fraction(percent, 100), cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    out = targets.select(F.col("source").alias("_source"), "source_size", "target", rate.alias("_rate"))
    out._quire_rows = targets._quire_rows
    return out


def _with_copies(drawn: DataFrame, rates: DataFrame) -> DataFrame:
    """drawn (with source and ``_u``) and its source's rate and ``_copies``: floor(rate) and one more by the draw.

    Rates come by broadcast if a count bounds the sources, else by a join in which each source's documents are dealt over salts.
    """
    same = F.col("source").eqNullSafe(F.col("_source"))
    if rates._quire_rows <= FEW_SOURCES:
        joined = drawn.join(F.broadcast(rates), same)
    else:
        salted = drawn.withColumn("_salt", F.col("_u") % SALTS)
        spread = rates.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = salted.join(spread.hint("merge"), same & (F.col("_salt") == F.col("_other")))
    extra = F.col("_u") < (F.col("_rate") - F.floor("_rate")) * F.lit(float(1 << 32))
    return joined.withColumn("_copies", (F.floor("_rate") + extra.cast("int")).cast("int"))


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def mix_sources(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, cap: int = 2, seed: int = 2024
) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document; :func:`emit_mixture` makes the copies.

    ``size``: words ``[^\\x20\\x09-\\x0D]+`` of the text (null: 0). A source's rate is its target over its size (size 0: 0). A
    document is taken floor(rate) times, and once more if a draw from md5 of seed, id and text is below the fraction: so at
    most ``cap`` times, alike in every run. ``taken`` is size * copies.

    Nulls: a null source is a source of its own, the last; a null id draws as an empty one. Repeated rows share their draw.
    Other columns, whatever their names, are left out. No rows in, no rows out.
    """
    sized = materialize(docs.select("doc_id", "source", _size().alias("size"), draw(seed).alias("_u")))
    mixed = _with_copies(sized, _rates(sized, weights, percent, cap))
    taken = (F.col("size") * F.col("_copies")).cast("long").alias("taken")
    return mixed.select("doc_id", "source", "size", "source_size", "target", F.col("_copies").alias("copies"), taken)


def emit_mixture(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), percent: int = 150, cap: int = 2, seed: int = 2024
) -> DataFrame:
    """The mixture itself: every document's own columns once for each of its copies, and ``copy`` from 1 (in place of a column
    of that name). The copies of a row are those that :func:`mix_sources` counts; texts are read, not shuffled."""
    rates = _rates(docs.select("source", _size().alias("size")), weights, percent, cap)
    own = [c for c in docs.columns if c.lower() not in ("copy", "_u", "_source", "source_size", "target", "_rate", "_copies", "_salt", "_other")]
    kept = {c: f"_own_{i}" for i, c in enumerate(docs.columns) if c not in own and c.lower() != "copy"}
    drawn = docs.select(*own, *(F.col(c).alias(a) for c, a in kept.items()), draw(seed).alias("_u"))
    mixed = _with_copies(drawn, rates).where("_copies > 0")
    return mixed.select(*own, *(F.col(a).alias(c) for c, a in kept.items()), F.explode(F.sequence(F.lit(1), F.col("_copies"))).alias("copy"))


def mixing_sql(weights: Sequence[int] = (3, 1, 2), percent: int = 150, cap: int = 2, seed: int = 2024) -> str:
    """DuckDB SQL of op12_mixing: the level of the filled weights in closed form, from sources in order of size for each weight."""
    return rf"""
with sized as (
  select doc_id, source, length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'x', 'g'), '[\x20\x09-\x0D]+', '', 'g')) as size,
    ('0x' || substr(md5('{seed}:' || coalesce(doc_id::varchar, '') || ':' || coalesce(text, '')), 1, 8))::bigint as u
  from documents
), sources as (
  select source, sum(size)::bigint as source_size,
    list_extract({list(weights)}, ((row_number() over (order by encode(source) nulls last) - 1) % {len(weights)} + 1)::bigint) as weight
  from sized group by source
), filled as (
  select *, sum({cap} * source_size) over w as capped, sum(weight) over () - sum(weight) over w as open,
    sum(source_size) over () * {percent} / 100 as total
  from sources window w as (order by {cap} * source_size / weight, source nulls last rows unbounded preceding)
), levels as (
  select total, capped, open, {cap} * source_size / weight as cap_level, (total - capped) / open as level from filled where open > 0
  union all select distinct total, 0, sum(weight) over (), 0, total / sum(weight) over () from filled
), chosen as (
  select coalesce(max(level), 0) as level from levels where level >= cap_level
), targets as (
  select source, source_size, least({cap} * source_size, level * weight)::double as target from sources, chosen
), rated as (
  select d.doc_id, d.size, d.u, t.source_size, t.target, case when t.source_size > 0 then t.target / t.source_size else 0 end as rate
  from sized d join targets t on d.source is not distinct from t.source
)
select doc_id, size, source_size, target,
  (size * (floor(rate) + case when u < (rate - floor(rate)) * 4294967296 then 1 else 0 end))::bigint as taken
from rated"""
