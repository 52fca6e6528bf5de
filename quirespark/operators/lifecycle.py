"""A job's life as a fold over its events, dispatch with attempts and cooldown, and the registry of providers' quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import queue

STATE = (
    "status string, active boolean, heartbeat_at timestamp, attempts int, last_dispatch timestamp, progress int, "
    "paused_at timestamp, started_at timestamp, finished_at timestamp, error string"
)
#: What a job may be.
STATUSES = ("uploading", "queued", "processing", "paused", "done", "failed")


def _now(state: Column, **changes: Column) -> Column:
    """The state with some fields replaced."""
    names = [c.split()[0] for c in STATE.split(", ")]
    types = dict(c.split() for c in STATE.split(", "))
    return F.struct(*[(changes[n] if n in changes else state[n]).cast(types[n]).alias(n) for n in names])


def step(state: Column, event: Column, silent: int = 45) -> Column:
    """The state after an event (ts, action, message).

    dispatch  counts an attempt of a queued job and stamps it; a queued job whose client is gone is paused instead
    start     a queued job is processed; one whose client is gone (off, unknown or silent) is paused; others ignore it
    heartbeat, resume   the client is there; a paused job is queued again, its moments, error and last dispatch cleared
    disconnect   the client is off
    poll      a job in work whose client is gone is paused
    done      a job in work is done, with progress 100
    error     a job in work is queued again if the message tells a passing fault, else failed, with the message's end
    Any other action changes nothing.
    """
    ts, action = event["ts"], event["action"]
    none = F.lit(None)
    is_ = lambda *x: state["status"].isin(*x)
    late = (F.unix_micros(ts) - F.unix_micros(state["heartbeat_at"])) > silent * 1_000_000
    gone = F.coalesce(~state["active"] | late, F.lit(True))
    paused = _now(state, status=F.lit("paused"), active=F.lit(False), paused_at=ts)
    started = _now(state, status=F.lit("processing"), started_at=ts, error=none)
    counted = _now(state, attempts=state["attempts"] + 1, last_dispatch=ts, progress=F.greatest(state["progress"], F.lit(2)))
    seen = _now(state, active=F.lit(True), heartbeat_at=ts)
    back = _now(
        state, status=F.lit("queued"), active=F.lit(True), heartbeat_at=ts, paused_at=none, started_at=none, finished_at=none, error=none, last_dispatch=none
    )
    again = _now(state, status=F.lit("queued"), error=none, started_at=none, finished_at=none)
    failed = _now(state, status=F.lit("failed"), error=F.right(event["message"], F.lit(6000)), finished_at=ts)
    return (
        F.when((action == "dispatch") & is_("queued"), F.when(gone, paused).otherwise(counted))
        .when((action == "start") & is_("queued"), F.when(gone, paused).otherwise(started))
        .when(action.isin("heartbeat", "resume"), F.when(is_("paused"), back).otherwise(seen))
        .when(action == "disconnect", _now(state, active=F.lit(False)))
        .when((action == "poll") & is_("processing") & gone, _now(state, status=F.lit("paused"), active=F.lit(False), paused_at=ts, started_at=none, finished_at=none, error=none))
        .when((action == "done") & is_("processing"), _now(state, status=F.lit("done"), progress=F.lit(100), finished_at=ts, error=none))
        .when((action == "error") & is_("processing"), F.when(X.passing_fault(event["message"]), again).otherwise(failed))
        .otherwise(state)
    )


def current_states(events: DataFrame, key: str = "job_id", silent: int = 45) -> DataFrame:
    """The state of each job after all its events (``key``, ts, event_id, action, message), which start with an insert:
    queued, its client seen when the first event came. A job's events are one fold, in the JVM."""
    ordered = F.array_sort(F.collect_list(F.struct("ts", "event_id", "action", "message")))
    by = events.groupBy(key).agg(ordered.alias("log"))
    first = F.get("log", F.lit(0))["ts"]
    blank = F.from_json(F.lit('{"status":"queued","active":true,"attempts":0,"progress":0}'), STATE)
    start = _now(blank, heartbeat_at=first)
    return by.select(key, F.aggregate("log", start, lambda s, e: step(s, e, silent)).alias("s")).select(key, "s.*")


def silences(events: DataFrame, until: str, key: str = "job_id", silent: int = 45) -> DataFrame:
    """A poll for each sign of life (the first event, heartbeats, resumes) that no other follows for ``silent`` seconds, a
    millisecond after them and not after ``until``: the moments at which a watcher would find the client gone."""
    w = Window.partitionBy(key).orderBy("ts", "event_id")
    lives = events.withColumn("first", F.row_number().over(w) == 1).where(F.col("first") | F.col("action").isin("heartbeat", "resume"))
    due = F.col("ts") + F.expr(f"INTERVAL {silent} SECONDS") + F.expr("INTERVAL 0.001 SECONDS")
    polls = lives.withColumns({"due": due, "next": F.lead("ts").over(w)}).where("(next is null or next > due - interval 0.001 seconds)")
    polls = polls.where(F.col("due") <= F.lit(until).cast("timestamp"))
    return polls.select(key, F.col("due").alias("ts"), F.lit(-1).cast("long").alias("event_id"), F.lit("poll").alias("action"), F.lit(None).cast("string").alias("message"))


def watched_states(events: DataFrame, until: str, key: str = "job_id", silent: int = 45) -> DataFrame:
    """The state of each job at ``until``, if whoever is silent for ``silent`` seconds is paused then."""
    own = events.select(key, F.col("ts").cast("timestamp").alias("ts"), "event_id", "action", "message").where(F.col("ts") <= F.lit(until).cast("timestamp"))
    return current_states(own.unionByName(silences(own, until, key, silent)), key, silent)


def dispatched(jobs: DataFrame, as_of: str, per_tick: int = 3, live: int = 45) -> DataFrame:
    """All jobs after one tick: the oldest ``per_tick`` that may be dispatched have one attempt more, the tick as their last
    dispatch and a progress of 2 at least. Only their ids, a bounded table, meet the jobs."""
    chosen = queue.recoverable(jobs, as_of, per_tick, live).select("job_id", F.lit(True).alias("chosen"))
    marked = jobs.join(F.broadcast(chosen), "job_id", "left")  # at most per_tick rows
    hit = F.coalesce("chosen", F.lit(False))
    return marked.withColumns(
        {
            "attempts": F.when(hit, F.col("attempts") + 1).otherwise(F.col("attempts")),
            "last_dispatch": F.when(hit, F.lit(as_of).cast(jobs.schema["last_dispatch"].dataType)).otherwise(F.col("last_dispatch")),
            "progress": F.when(hit, F.greatest("progress", F.lit(2))).otherwise(F.col("progress")),
        }
    ).drop("chosen")


def cooldowns(answers: DataFrame, key: str = "model") -> DataFrame:
    """After each provider answer (``key``, ts_ms, event_id, delay_s or null, daily): until when the provider rests, the latest
    moment any answer asked for (a second at least), and whether its daily quota is gone, which stays so."""
    w = Window.partitionBy(key).orderBy("ts_ms", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    until = F.col("ts_ms") + (F.greatest(F.lit(1.0), F.col("delay_s")) * 1000).cast("long")
    return answers.select(
        key, "event_id", F.max(F.when(F.col("delay_s").isNotNull(), until)).over(w).alias("until_ms"), F.max("daily").over(w).alias("exhausted")
    )


def exhausted(answers: DataFrame, key: str = "model") -> DataFrame:
    """The providers whose daily quota is gone."""
    return answers.where("daily").select(key).distinct()
