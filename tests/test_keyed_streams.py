"""Keyed stream state and joined streams end with the rows of their whole-table twins."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirespark.operators import lifecycle, queue
from quirespark.streaming import lifecycle as L

T0 = datetime(2024, 1, 1)
EVENTS = "job_id long, ts timestamp, event_id long, action string, message string"
JOBS = "job_id long, status string, progress long, dispatched_at timestamp"
RESPONSES = "request_id long, status_code int, error_msg string, answered_at timestamp"


@pytest.fixture
def rocks(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, before)


def write(spark, folder, rows, kinds):
    spark.createDataFrame(rows, kinds).coalesce(1).write.mode("append").parquet(str(folder))


def read(spark, folder, kinds):
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(folder))


def drain(stream, spark, name, tmp, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp / name)).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def at(job, seconds, event, action, message=""):
    return (job, T0 + timedelta(seconds=seconds), event, action, message)


def test_watched_jobs_with_late_and_lost_beats(spark, tmp_path, rocks):
    batches = [
        [at(1, 0, 1, "dispatch"), at(1, 5, 2, "start"), at(2, 0, 3, "start"), at(3, 0, 4, "start"), at(4, 0, 5, "dispatch"), at(5, 0, 6, "start")],
        # job 1 beats in time, one beat of it arrives a batch late; job 2 falls silent; job 3 beats again after its pause
        [at(1, 80, 8, "heartbeat"), at(3, 100, 9, "heartbeat"), at(3, 101, 10, "dispatch"), at(3, 102, 11, "start"), at(5, 20, 12, "disconnect")],
        [at(1, 40, 7, "heartbeat"), at(1, 110, 13, "error", "429 RESOURCE_EXHAUSTED: Quota exceeded for metric GenerateRequestsPerDay"), at(3, 120, 14, "done"), at(5, 30, 15, "poll")],
        [at(1, 112, 16, "start"), at(1, 113, 17, "error", "disk full"), at(4, 90, 18, "start"), at(4, 91, 19, "resume")],
        [at(9, 1000, 20, "dispatch")],  # time goes on
        [at(2, 30, 21, "heartbeat"), at(9, 1001, 22, "start")],  # lost: far behind the watermark
        [at(9, 2000, 23, "dispatch")],
    ]
    for rows in batches:
        write(spark, tmp_path / "in", rows, EVENTS)
    made = drain(L.watched_jobs(read(spark, tmp_path / "in", EVENTS), late="2 minutes"), spark, "watched", tmp_path, "update")
    last = made.groupBy("job_id").agg(F.max_by(F.struct(*L.FIELDS), "version").alias("s")).select("job_id", "s.*")
    kept = [r for rows in batches for r in rows if r[2] != 21]
    until = str(T0 + timedelta(seconds=2000 - 120))
    want = lifecycle.watched_states(spark.createDataFrame(kept, EVENTS), until)
    got = {r.job_id: tuple(r) for r in last.collect()}
    assert got == {r.job_id: tuple(r) for r in want.select("job_id", *L.FIELDS).collect()}
    assert {j: r[1] for j, r in got.items()} == {1: "failed", 2: "paused", 3: "done", 4: "queued", 5: "paused", 9: "paused"}
    assert got[2][7] == T0 + timedelta(seconds=45, milliseconds=1)


def test_random_logs_fold_alike_in_tables_and_by_hand(spark):
    import random

    random.seed(5)
    actions = ("dispatch", "start", "heartbeat", "poll", "done", "error", "disconnect", "resume", "other")
    rows, n = [], 0
    for job in range(60):
        t = 0
        for _ in range(random.randint(1, 25)):
            t, n = t + random.choice([0, 1, 20, 44, 45, 46, 100]), n + 1
            rows.append(at(job, t, n, random.choice(actions), random.choice(["high demand", "disk full", None])))
    df = spark.createDataFrame(rows, EVENTS)
    until = T0 + timedelta(seconds=700)
    want = {r.job_id: r for r in lifecycle.watched_states(df, str(until)).collect()}
    micros = lambda m: round((m - T0).total_seconds() * 1_000_000)
    watch = L.Watch(45)
    for job, state in want.items():
        mine = sorted((r for r in rows if r[0] == job and r[1] <= until), key=lambda r: (r[1], r[2]))
        s = watch._first(micros(mine[0][1]))
        for _, ts, _, action, message in mine:
            s = watch._polled(s, micros(ts))
            s = L.advanced(s, micros(ts), action, message == "high demand", message, watch.silent)
        s = watch._polled(s, micros(until))
        got = tuple(s[c] for c in L.FIELDS)
        assert got == tuple(micros(v) if isinstance(v, datetime) else v for v in (state[c] for c in L.FIELDS)), (job, mine)


def test_responses_meet_dispatches_as_streams(spark, tmp_path):
    moment = lambda s: T0 + timedelta(seconds=s)
    codes = [200, 204, 401, 403, 404, 500, None]
    jobs = [(i, "queued" if i % 5 else "processing", i % 9, moment(i)) for i in range(40)]
    answers = [(i, codes[i % 7], "timeout" if i % 14 == 6 else None, moment(i + 30)) for i in range(40) if i % 4 != 3]
    for part in (jobs[:20], jobs[20:]):
        write(spark, tmp_path / "jobs", part, JOBS)
    for part in (answers[15:], answers[:15], answers[5:10]):  # out of order, some delivered twice
        write(spark, tmp_path / "answers", part, RESPONSES)
    for day in (1, 2):  # time goes on, on both sides
        write(spark, tmp_path / "jobs", [(1000 + day, "queued", 0, moment(86_400 * day))], JOBS)
        write(spark, tmp_path / "answers", [(2000 + day, 200, None, moment(86_400 * day))], RESPONSES)
    both = L.merged_responses(read(spark, tmp_path / "jobs", JOBS), read(spark, tmp_path / "answers", RESPONSES), late="2 minutes")
    got = sorted(tuple(r) for r in drain(both, spark, "merged", tmp_path).where("job_id < 1000").collect())
    want = queue.merge_responses(spark.createDataFrame(jobs, JOBS), spark.createDataFrame(answers, RESPONSES))
    assert got == sorted(tuple(r) for r in want.collect()) and len(got) == 40
    assert {r[2] for r in got} == {"unchanged", "starting", "resuming", "refused", "retrying", "network"}
