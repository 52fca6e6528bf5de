"""A job's life as keyed stream state with event-time timers, and dispatches joined to their responses as two streams."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as X
from ..operators import queue

#: The state of a job; moments are microseconds.
FIELDS = ("status", "active", "heartbeat_at", "attempts", "last_dispatch", "progress", "paused_at", "started_at", "finished_at", "error")
_MOMENTS = ("heartbeat_at", "last_dispatch", "paused_at", "started_at", "finished_at")
_STATE = T.StructType(
    [
        T.StructField("status", T.StringType()), T.StructField("active", T.BooleanType()), T.StructField("heartbeat_at", T.LongType()),
        T.StructField("attempts", T.IntegerType()), T.StructField("last_dispatch", T.LongType()), T.StructField("progress", T.IntegerType()),
        T.StructField("paused_at", T.LongType()), T.StructField("started_at", T.LongType()), T.StructField("finished_at", T.LongType()),
        T.StructField("error", T.StringType()), T.StructField("version", T.LongType()), T.StructField("asked", T.LongType()),
    ]
)
_KEY = T.StructType([T.StructField("ts", T.LongType()), T.StructField("event_id", T.LongType())])
_EVENT = T.StructType([T.StructField("action", T.StringType()), T.StructField("passing", T.BooleanType()), T.StructField("message", T.StringType())])
_MADE = (
    "job_id long, version long, status string, active boolean, heartbeat_at long, attempts int, last_dispatch long, progress int, "
    "paused_at long, started_at long, finished_at long, error string"
)


def advanced(state: dict, ts: int, action: str, passing: bool, message: str | None, silent: int) -> dict:
    """The state after one event: the rules of the whole-table fold, for one job at a time."""
    status = state["status"]
    gone = not state["active"] or state["heartbeat_at"] is None or ts - state["heartbeat_at"] > silent
    paused = {"status": "paused", "active": False, "paused_at": ts}
    rest = {"started_at": None, "finished_at": None, "error": None}
    change: dict = {}
    if action in ("dispatch", "start") and status == "queued":
        if gone:
            change = paused
        elif action == "start":
            change = {"status": "processing", "started_at": ts, "error": None}
        else:
            change = {"attempts": state["attempts"] + 1, "last_dispatch": ts, "progress": max(2, state["progress"])}
    elif action in ("heartbeat", "resume"):
        change = {"active": True, "heartbeat_at": ts}
        if status == "paused":
            change |= {"status": "queued", "paused_at": None, "last_dispatch": None} | rest
    elif action == "disconnect":
        change = {"active": False}
    elif status == "processing" and action == "poll" and gone:
        change = paused | rest
    elif status == "processing" and action == "done":
        change = {"status": "done", "progress": 100, "finished_at": ts, "error": None}
    elif status == "processing" and action == "error":
        change = {"status": "queued"} | rest if passing else {"status": "failed", "error": None if message is None else message[-6000:], "finished_at": ts}
    return state | change


class Watch(StatefulProcessor):
    """Events wait in a map until the watermark has passed them, so that late ones take their place; then they are folded in
    order of (ts, event_id). A beat that nothing follows for ``silent`` seconds counts as a poll a millisecond later: a
    timer asks for it even if the job is never heard of again."""

    def __init__(self, silent: int) -> None:
        self.silent = silent * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", _STATE)
        self.waiting = handle.getMapState("waiting", _KEY, _EVENT)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues: object) -> Iterator[Row]:
        moments, passed = set(), timerValues.getCurrentWatermarkInMs() * 1000
        for r in rows:
            if r.at < passed:  # too late: what stood at its moment is folded
                continue
            self.waiting.updateValue((r.at, r.event_id), (r.action, r.passing, r.message))
            moments.add(-(-r.at // 1000))
        for moment in moments:
            self.handle.registerTimer(moment)
        return iter(())

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[Row]:
        """The first timer that a watermark sets off folds all it has passed; the others find nothing left."""
        end = timerValues.getCurrentWatermarkInMs() * 1000
        due = sorted((at, event) for at, event in ((tuple(k), tuple(v)) for k, v in self.waiting.iterator()) if at[0] <= end)
        held = self.now.get()
        if held is None and not due:
            return
        state = dict(zip(_STATE.names, held, strict=True)) if held else self._first(due[0][0][0])
        before = dict(state)
        for at, (action, passing, message) in due:
            state = self._polled(state, at[0])
            state = advanced(state, at[0], action, passing, message, self.silent)
            self.waiting.removeKey(at)
        state = self._polled(state, end)
        if asked := self._silence(state):
            if asked > end and asked != state["asked"]:
                self.handle.registerTimer(-(-asked // 1000))
                state["asked"] = asked
        if not held or any(state[c] != before[c] for c in FIELDS):
            state["version"] += 1
            yield Row(job_id=key[0], version=state["version"], **{c: state[c] for c in FIELDS})
        if state != before or not held:
            self.now.update(tuple(state[c] for c in _STATE.names))

    @staticmethod
    def _first(ts: int) -> dict:
        return dict.fromkeys(_STATE.names) | {"status": "queued", "active": True, "heartbeat_at": ts, "attempts": 0, "progress": 0, "version": 0}

    def _silence(self, state: dict) -> int | None:
        """When a job in work counts as polled after its last beat."""
        return state["heartbeat_at"] + self.silent + 1000 if state["status"] == "processing" else None

    def _polled(self, state: dict, until: int) -> dict:
        at = self._silence(state)
        return advanced(state, at, "poll", False, None, self.silent) if at is not None and at <= until else state

    def close(self) -> None:
        pass


def watched_jobs(events: DataFrame, silent: int = 45, late: str = "10 minutes") -> DataFrame:
    """Each job's state, again whenever it changes (``version`` counts), from its events (job_id, ts, event_id, action, message)
    as they arrive: what :func:`~quirespark.operators.lifecycle.watched_states` gives for whole tables.

    Events may come in any order within ``late``; later ones are dropped. Whoever is silent for ``silent`` seconds is paused
    by a timer of the stream's own time. Needs the RocksDB state store. A job is the unit of state.
    """
    rows = events.select(
        "job_id", "ts", F.unix_micros("ts").alias("at"), "event_id", "action", X.passing_fault(F.col("message")).alias("passing"), "message"
    )
    made = rows.withWatermark("ts", late).groupBy("job_id").transformWithState(Watch(silent), _MADE, outputMode="Update", timeMode="EventTime")
    return made.select("job_id", "version", *[F.timestamp_micros(c).alias(c) if c in _MOMENTS else F.col(c) for c in FIELDS])


def merged_responses(jobs: DataFrame, responses: DataFrame, within: str = "10 minutes", late: str = "1 minute") -> DataFrame:
    """Dispatched jobs and responses as two streams: what :func:`~quirespark.operators.queue.merge_responses` gives for tables.

    jobs (job_id, status, progress, dispatched_at) and responses (request_id, status_code, error_msg, answered_at) meet if an
    answer comes ``within`` that time of its dispatch; a job without one comes out as unchanged once the watermark has passed
    that time, and both sides' state is given up then. A response delivered again counts once.
    """
    left = jobs.withWatermark("dispatched_at", late)
    seen = responses.where("status_code is not null or error_msg is not null").withWatermark("answered_at", late)
    once = seen.dropDuplicatesWithinWatermark(["request_id"])
    on: Column = (
        (F.col("job_id") == F.col("request_id")) & (F.col("status") == "queued")
        & (F.col("answered_at") >= F.col("dispatched_at")) & (F.col("answered_at") <= F.col("dispatched_at") + F.expr(f"INTERVAL {within}"))
    )
    return queue.response_effects(left.join(once, on, "left"))
