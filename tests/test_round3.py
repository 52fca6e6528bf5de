"""Inputs that earlier versions got wrong."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quirespark.functions import text as X
from quirespark.operators import integrity, lifecycle, queue

KINDS = "job_id long, ts timestamp, event_id long, action string, message string"


def test_daily_quota_goes_back_to_the_queue(spark):
    t0 = datetime(2024, 1, 1)
    rows = [
        (job, t0 + timedelta(seconds=i), i, action, message if action == "error" else "")
        for job, message in ((1, "429 RESOURCE_EXHAUSTED: Quota exceeded for metric GenerateRequestsPerDay"), (2, "INVALID_ARGUMENT"), (3, None))
        for i, action in enumerate(("dispatch", "start", "error"))
    ]
    got = {r.job_id: r.status for r in lifecycle.current_states(spark.createDataFrame(rows, KINDS)).collect()}
    assert got == {1: "queued", 2: "failed", 3: "failed"}


def test_null_and_blank_results_are_made_again(spark):
    items = spark.createDataFrame([(1, i, f"i{i}", "one") for i in range(4)], "doc_id long, pos int, item_id string, source string")
    stored = spark.createDataFrame([(1, 0, None), (1, 1, " \n　"), (1, 2, ""), (1, 3, "eins")], "doc_id long, pos int, translated string")
    got = {r.pos: (r.translated, r.again) for r in integrity.resumed(items, stored).collect()}
    assert got == {0: ("one", True), 1: ("one", True), 2: ("one", True), 3: ("eins", False)}
    assert integrity.missing(items.join(stored, ["doc_id", "pos"])).first().missing == "i0,i1,i2"


def test_progress_of_any_number(spark):
    t0 = datetime(2024, 1, 1)
    values = [None, float("nan"), -1e300, 7.9, float("inf"), 1e12]
    df = spark.createDataFrame([(1, i, t0 + timedelta(seconds=i), v, "m") for i, v in enumerate(values)], "user_id long, event_id long, ts timestamp, value double, message string")
    assert [r.progress for r in queue.running_progress(df).orderBy("event_id").collect()] == [None, 0, 0, 7, 100, 100]


def test_transport_marks_are_whole_words(spark):
    texts = ["§times", "§alpha_1", "§alpha", "§alpha{", "§math{x}", "a §in b", "§index", "§ 3"]
    items = spark.createDataFrame([(1, i, f"i{i}", "s", t) for i, t in enumerate(texts)], "doc_id long, pos int, item_id string, source string, translated string")
    got = {texts[r.pos] for r in integrity.error_rows(items).collect()}
    assert got == {"§alpha", "§alpha{", "§math{x}", "a §in b"}


def test_escapes_hold_no_noncharacter(spark):
    df = spark.createDataFrame([("﷐﷑﷒é\u0007&\n",), (None,)], "t string")
    assert [r.e for r in df.select(X.escape_tex(F.col("t")).alias("e")).collect()] == ["é\\&\n", None]


def test_checkpoints_of_some_documents_leave_the_others(spark, tmp_path):
    import pytest

    from quirespark.sources import checkpoints as C

    folder, docs = str(tmp_path), spark.createDataFrame([(i, f"text {i}") for i in range(4)], "doc_id long, text string")
    state = lambda s: F.concat(F.lit(s), F.col("doc_id").cast("string"))
    held = lambda: {r.doc_id: r.state for r in C.load(docs, folder, "s", "de").collect()}
    assert held() == dict.fromkeys(range(4))
    C.save(docs.withColumn("state", state("a")), folder, "s", "de")
    C.save(docs.where("doc_id < 2").withColumn("state", state("b")), folder, "s", "de")
    assert held() == {0: "b0", 1: "b1", 2: "a2", 3: "a3"}

    def broken(i):
        raise RuntimeError("killed")

    killed = docs.withColumn("state", F.when(F.col("doc_id") == 3, F.udf(broken)("doc_id")).otherwise("c"))
    with pytest.raises(Exception, match="killed"):
        C.save(killed, folder, "s", "de")
    assert held() == {0: "b0", 1: "b1", 2: "a2", 3: "a3"} and not list(tmp_path.rglob("_making*"))
    assert C.compact(spark, folder, "s", "de") == 2 and C.compact(spark, folder, "s", "de") == 1
    assert held() == {0: "b0", 1: "b1", 2: "a2", 3: "a3"}
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 0, "other").otherwise(F.col("text")))
    assert {r.doc_id: r.state for r in C.load(changed, folder, "s", "de").collect()}[0] is None


def test_two_lost_hints_on_one_spot_come_in_once(spark):
    from quirespark.operators import stabilise

    kinds = "doc_id long, page int, {} int, text string, {} x0 double, y0 double, x1 double, y1 double"
    blocks = spark.createDataFrame([(1, 0, 0, "a block that stands", "paragraph", 100.0, 700.0, 400.0, 800.0)], kinds.format("pos", "kind string,"))
    hints = spark.createDataFrame(
        [(1, 0, 0, "a paragraph that was lost", "Times", 10.0, 60.0, 400.0, 440.0, 490.0), (1, 0, 1, "other words about the sea", "Times", 10.0, 70.0, 410.0, 430.0, 480.0)],
        kinds.format("hint_ord", "font string, size double,"),
    )
    rows = stabilise.stabilised(blocks, hints).collect()
    assert sorted((r.text, r.origin) for r in rows) == [("a block that stands", "block"), ("a paragraph that was lost", "recovered")]


def test_blocks_flow_only_where_none_does_yet(spark):
    from quirespark.operators import stabilise

    rows = [(p, 0, i, "paragraph", f"{'words ' * 12} {p} {i}", x, 100.0 + 100 * i, x + 380, 190.0 + 100 * i, 2 if (p, i) == (2, 0) else 1) for p in (1, 2) for i, x in enumerate((60.0, 60.0, 500.0, 500.0))]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double, flow_columns int")
    hints = blocks.select("doc_id", "page", F.col("pos").alias("hint_ord"), "text", F.lit("Times").alias("font"), F.lit(10.0).alias("size"), "x0", "y0", "x1", "y1")
    got = {(r.doc_id, r.place): r.flow_columns for r in stabilise.stabilised(blocks, hints).collect()}
    assert got == {(1, i): 2 for i in range(4)} | {(2, 0): 2, (2, 1): 1, (2, 2): 1, (2, 3): 1}
