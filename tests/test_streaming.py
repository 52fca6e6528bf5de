"""Streams end with the rows of the same operators over whole tables."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quirespark.operators import queue
from quirespark.sources import entities as E
from quirespark.streaming import jobs as S

T0 = datetime(2024, 1, 1)
COLUMNS = "event_id long, user_id long, ts timestamp, action string, value double"


def write(spark, folder, groups):
    for g in groups:
        rows = [(i, u, T0 + timedelta(seconds=s), "heartbeat", 0.0) for i, u, s in g]
        spark.createDataFrame(rows, COLUMNS).coalesce(1).write.mode("append").parquet(str(folder))


def drain(stream, spark, name, tmp):
    q = stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp / name)).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return [tuple(r) for r in spark.table(name).collect()]


def test_sessions_close_after_the_gap(spark, tmp_path):
    write(spark, tmp_path / "in", [[(1, 1, 0), (2, 1, 30), (3, 2, 5)], [(4, 1, 100)], [(5, 9, 5000)]])
    beats = S.heartbeat_stream(spark, str(tmp_path / "in"), 1)
    got = drain(S.session_stream(beats, late="1 minute"), spark, "closed", tmp_path)
    held = spark.read.parquet(str(tmp_path / "in"))
    want = [tuple(r) for r in queue.sessions(held, "45 seconds").where("user_id <> 9").collect()]
    assert sorted(got) == sorted(want) and len(got) == 3


def test_each_event_once(spark, tmp_path):
    write(spark, tmp_path / "in", [[(1, 1, 0), (2, 1, 1)], [(1, 1, 0), (3, 1, 2)], [(2, 1, 1)]])
    got = drain(S.unique_stream(S.heartbeat_stream(spark, str(tmp_path / "in"), 1)), spark, "once", tmp_path)
    assert sorted(r[0] for r in got) == [1, 2, 3]


def test_three_ticks_raise_attempts(spark, sf_dir, tmp_path):
    """Each tick sees the dispatches of the ticks before: no job twice within its cooldown, as in the whole-table form."""
    from quirespark.operators import lifecycle
    from quirespark.plans.rules import TICKS

    write(spark, tmp_path / "in", [[(1, 1, 0)], [(2, 1, 1)], [(3, 1, 2)]])
    jobs, log, live = E.jobs(spark, sf_dir), str(tmp_path / "log"), 20 * 86_400
    ticks = S.heartbeat_stream(spark, str(tmp_path / "in"), 1)
    tick = S.dispatch_tick(jobs, TICKS.__getitem__, log, live=live)
    q = ticks.writeStream.foreachBatch(tick).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    held = spark.read.parquet(log)
    made = {n: {r.job_id for r in held.where(F.col("tick") == n).collect()} for n in range(3)}
    assert [len(x) for x in made.values()] == [3, 3, 3] and not made[0] & made[1] and not made[1] & made[2]
    want = jobs
    for at in TICKS:
        want = lifecycle.dispatched(want, at, live=live)
    cols = ["job_id", "attempts", "last_dispatch", "progress"]
    got = S.with_dispatches(jobs, held)
    assert sorted(map(tuple, got.select(cols).collect()), key=str) == sorted(map(tuple, want.select(cols).collect()), key=str)
    before = {tuple(r) for r in held.collect()}
    tick(None, 2)  # a tick that runs again changes nothing
    assert {tuple(r) for r in spark.read.parquet(log).collect()} == before


def test_snapshots_keep_what_a_tick_reads_the_same(spark, tmp_path):
    """Ticks with a snapshot every three equal ticks over the whole log; a tick that runs again changes nothing."""
    at = lambda n: str(T0 + timedelta(seconds=46 * n))
    jobs = spark.createDataFrame(
        [(i, "queued", True, T0 + timedelta(days=1), T0 - timedelta(days=1, seconds=-i), 0, None, 0) for i in range(7)],
        "job_id long, status string, active boolean, heartbeat_at timestamp, created_at timestamp, attempts int, last_dispatch timestamp, progress int",
    )
    few, whole = (S.dispatch_tick(jobs, at, str(tmp_path / name), 3, every=every) for name, every in (("few", 3), ("whole", 1000)))
    for n in range(14):
        few(None, n)
        whole(None, n)
        if n % 3 == 0:
            few(None, n)  # replayed
        assert len(S.held_before(spark, str(tmp_path / "few"), n, 3).inputFiles()) <= 8 * 4
    cols = ["job_id", "attempts", "last_dispatch"]
    left, right = (S.with_dispatches(jobs, S.held_before(spark, str(tmp_path / name), 14, every)).select(cols) for name, every in (("few", 3), ("whole", 1000)))
    assert sorted(map(tuple, left.collect())) == sorted(map(tuple, right.collect())) and left.agg(F.sum("attempts")).first()[0] == 42
    kept = sorted(int(p.name.split("=")[1]) for p in (tmp_path / "few").glob("tick=*"))
    assert kept == [9, 10, 11, 12, 13] and len(list((tmp_path / "few" / "_counted").glob("before=*"))) == 2


def test_ticks_come_every_half_minute(spark, tmp_path):
    write(spark, tmp_path / "in", [[(1, 1, 0)]])
    q = S.half_minutes(S.heartbeat_stream(spark, str(tmp_path / "in"))).format("memory").queryName("ticked").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    assert spark.table("ticked").count() == 1
    q.stop()
    assert S.now_text().endswith("+00:00")
