"""Job-queue operators: eligibility, dispatch, merges, latest state and progress."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def since(as_of: str, seconds: int) -> Column:
    return F.lit(as_of).cast("timestamp") - F.expr(f"INTERVAL {seconds} SECONDS")


def recoverable(jobs: DataFrame, as_of: str, limit: int | None = 3, live: int = 45) -> DataFrame:
    """Queued jobs of clients heard of in the last ``live`` seconds that may be dispatched again, oldest first."""
    got = jobs.where(
        (F.col("status") == "queued")
        & F.col("active")
        & (F.col("heartbeat_at") >= since(as_of, live))
        & (F.col("created_at") < since(as_of, 20))
        & (F.col("attempts") < 8)
        & (F.col("last_dispatch").isNull() | (F.col("last_dispatch") < since(as_of, 45)))
    )
    return got if limit is None else got.orderBy("created_at", "job_id").limit(limit)


def stale(jobs: DataFrame, as_of: str, seconds: int = 45) -> DataFrame:
    """Jobs whose client is off, unknown or silent for longer than ``seconds``."""
    return jobs.where(~F.col("active") | F.col("heartbeat_at").isNull() | (F.col("heartbeat_at") < since(as_of, seconds)))


def merge_responses(jobs: DataFrame, responses: DataFrame) -> DataFrame:
    """Jobs with the effect of dispatch responses on queued ones: message class and progress."""
    seen = responses.where("status_code is not null or error_msg is not null")
    return response_effects(jobs.join(seen, (jobs.job_id == seen.request_id) & (jobs.status == "queued"), "left"))


def response_effects(joined: DataFrame) -> DataFrame:
    """What a response (null columns: none) does to its job. Tables and streams share this."""
    code = F.col("status_code")
    ok = code.isin(200, 204)
    outcome = (
        F.when(F.col("request_id").isNull(), "unchanged")
        .when(ok, F.when(F.col("progress") >= 4, "resuming").otherwise("starting"))
        .when(code.isin(401, 403, 404), "refused").when(code.isNotNull(), "retrying").otherwise("network")
    )
    return joined.select(
        "job_id", "status", outcome.alias("outcome"), F.when(F.coalesce(ok, F.lit(False)), F.greatest("progress", F.lit(3))).otherwise(F.col("progress")).alias("progress")
    )


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Rows of new, and those of old whose key new does not have; no row is shuffled by more than its key."""
    return new.unionByName(old.join(new.select(key).distinct(), key, "left_anti").select(new.columns))


def latest(events: DataFrame, key: str, *order: str) -> DataFrame:
    """The last event of each key, by a combinable maximum (no sort of a key's rows)."""
    rest = [c for c in events.columns if c != key and c not in order]
    return events.groupBy(key).agg(F.max(F.struct(*order, *rest)).alias("m")).select(key, *[F.col(f"m.{c}").alias(c) for c in (*order, *rest)])


def running_progress(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Progress that never falls: whole percent (the fraction is cut off), clamped to 0..100, with the message's first 500
    characters. What is no number counts as 0; null stays out."""
    w = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.nanvl(F.col("value"), F.lit(0.0))))
    percent = F.when(F.col("value").isNotNull(), clamped).cast("int")
    return events.select(key, "event_id", "ts", F.max(percent).over(w).alias("progress"), F.left("message", F.lit(500)).alias("message"))


def progress_changes(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Rows whose progress or message differs from the one before."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    marked = running_progress(events, key).withColumns({"p": F.lag("progress").over(w), "m": F.lag("message").over(w)})
    return marked.where(~(F.col("progress").eqNullSafe(F.col("p")) & F.col("message").eqNullSafe(F.col("m")))).drop("p", "m")


def oldest_queued(jobs: DataFrame, limit: int = 10) -> DataFrame:
    """The oldest queued jobs; a limit outside 1..10 is moved into it."""
    return jobs.where("status = 'queued'").orderBy("created_at", "job_id").limit(max(1, min(10, limit)))


def insertable(results: tuple[str, ...]) -> Column:
    """Whether a row (job_id, user_id, path, progress, attempts) may be inserted: its path is owner/job/original.pdf, no
    progress is made, attempts are within 0..8, and all ``results`` columns are null."""
    owner = F.col("user_id").cast("string")
    whole = F.concat_ws("/", owner, F.col("job_id").cast("string"), F.lit("original.pdf"))
    out = (F.element_at(F.split("path", "/"), 1) == owner) & (F.col("path") == whole) & (F.col("progress") == 0) & F.col("attempts").between(0, 8)
    for c in results:
        out = out & F.col(c).isNull()
    return out


def sessions(events: DataFrame, gap: str = "6 hours", key: str = "user_id") -> DataFrame:
    """Activity sessions: a gap over ``gap`` starts a new one. Batch and streaming share this plan."""
    return events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("beats"), F.min("ts").alias("first"), F.max("ts").alias("last")).drop("w")


def client_states(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Per signal: whether the client is active after it and whether it changed that."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    active = F.col("action") != "disconnect"
    return events.select(
        key, "event_id", "action", active.alias("active"),
        F.coalesce(active != F.lag(active).over(w), active).alias("changed"),
        F.sum((F.col("action") == "resume").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("resumes"),
    )
