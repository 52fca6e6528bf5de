"""One line of thousands of words: work grows with the line, not with its square (versions before took minutes)."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quirespark.functions import glyphs
from quirespark.functions import protect as P
from quirespark.functions import text as X
from quirespark.llm import _common
from quirespark.operators import stabilise
from quirespark.plans import documents, rules

N = 4_000
LIMIT = 30  # seconds


@pytest.fixture(scope="module")
def words():
    random.seed(5)
    return ["".join(random.choices("abcdeßéÜ", k=random.randint(1, 8))) for _ in range(N)]


@pytest.fixture
def in_time(spark):
    spark.range(10).selectExpr("sum(id)").collect()
    began = time.monotonic()
    yield
    assert time.monotonic() - began < LIMIT


def fold(t):
    return t.lower().replace("ß", "ss")


def mended(text, source):
    tails = [fold(w[1:]) for w in source]

    def of(tail):
        k = tails.index(fold(tail)) if tails.count(fold(tail)) == 1 else None
        return source[k] if k is not None and fold(tail) not in glyphs.RESERVED and len(source[k]) == len(tail) + 1 else f"§{tail}"

    return re.sub(r"§([^\W\d_]+)", lambda m: of(m[1]), text)


def test_signs_of_a_long_line_are_mended(spark, in_time, words):
    words = [*words, "gamma", "xgamma", "öalpha"]
    rows = [(i, " ".join("§" + w[1:] if len(w) > k else w for w in words) + " § §§ §9 §nowhere", " ".join(words)) for i, k in enumerate((1, 4))]
    df = spark.createDataFrame(rows, "i long, t string, s string")
    got = {r.i: r.r for r in df.select("i", glyphs.repaired(F.col("t"), F.col("s")).alias("r")).collect()}
    assert got == {i: mended(t, words) for i, t, _ in rows}
    assert got[1] != rows[1][1] and "§gamma" in got[1] and "§nowhere" in got[1]


def test_signs_without_a_source_stay(spark):
    rows = [(0, None, "a"), (1, "§ello", None), (2, "§ello", "12 !"), (3, "hello", "hello"), (4, "", "hello"), (5, "§ello §", "Hello"), (6, "§ello² §²x", "Hello²Ⅷword")]
    df = spark.createDataFrame(rows, "i long, t string, s string")
    got = {r.i: r.r for r in df.select("i", glyphs.repaired(F.col("t"), F.col("s")).alias("r")).collect()}
    assert got == {0: None, 1: "§ello", 2: "§ello", 3: "hello", 4: "", 5: "Hello §", 6: "Hello² §²x"}


def test_terms_of_a_long_text_are_kept_and_put_back(spark, in_time, words):
    terms = ("ab", "abc", "ß")
    text = " [[MATH_0]] ".join([" ".join(words * 3), *words[:N // 4]])
    find = re.compile(P.pattern(terms))
    held = find.findall(text)
    count = iter(range(len(held)))
    safe = find.sub(lambda _: P.TOKEN.format(next(count)), text)
    df = spark.createDataFrame([(text,)], "t string")
    made = df.select(P.protected(F.col("t"), terms).alias("safe"), P.held(F.col("t"), terms).alias("kept"))
    r = made.select("*", P.restored(F.col("safe"), F.col("kept")).alias("back"), P.restore_fault(F.col("safe"), F.col("kept")).alias("fault")).first()
    assert len(held) > N and (r.safe, r.kept, r.back, r.fault) == (safe, held, text, None)


def test_cells_of_a_long_line(spark, in_time, words, tmp_path):
    words = words * 3
    spark.createDataFrame([(8, " ".join(words))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.id: r.source for r in rules.table_items(spark, str(tmp_path)).collect()}
    assert got == {f"p0_b0__r{k // 4}c{k % 4}": f"{w} [[MATH_0]]" if k % 5 == 4 else w for k, w in enumerate(words)}


def test_prose_is_told_by_the_rules_for_footers_and_formulas(spark):
    texts = ["", None, "page 12", "PAGE 1234567", "12", "eight letters", "seven 77", "a+b=c and letters", "x = 1", "∑∫ some letters here", "+ " * 5 + "plain letters " * 9, "long " * 40]
    rows = [(t, font, y) for t in texts for font in ("Times", "CMMI10", None) for y in (10.0, 955.0, None)]
    t, font, y0 = (F.col(c) for c in "tfy")
    whole = (X.letters(t) >= 8) & ~X.is_footer(t, y0) & ~X.likely_math(t, font)
    got = spark.createDataFrame(rows, "t string, f string, y double").select(X.prose_candidate(t, font, y0).alias("a"), whole.alias("b")).collect()
    assert [bool(r.a) for r in got] == [bool(r.b) for r in got] and {bool(r.a) for r in got} == {True, False}


def test_hints_are_read_once(spark, monkeypatch):
    """Rules on texts are named in one place of the stabiliser's plan: the table of hints."""
    columns = "doc_id long, page int, hint_ord long, text string, font string, size double, x0 double, y0 double, x1 double, y1 double"
    hints = spark.createDataFrame([(1, 0, i, f"some prose of hint {i}", "Times", 10.0, 60.0, 40.0 + 110 * i, 440.0, 130.0 + 110 * i) for i in range(3)], columns)
    blocks = spark.createDataFrame([(1, 0, 0, "some prose of hint 0", "paragraph", 60.0, 40.0, 440.0, 130.0)], "doc_id long, page int, pos int, text string, kind string, x0 double, y0 double, x1 double, y1 double")
    calls = []
    whole = X.prose_candidate
    monkeypatch.setattr(X, "prose_candidate", lambda *a: calls.append(a) or whole(*a))
    read = stabilise.read_once(hints)
    stable = stabilise.stabilised(blocks, read)
    assert [(r.place, r.origin, r.text) for r in stable.orderBy("place").collect()] == [(0, "block", "some prose of hint 0"), (1, "recovered", "some prose of hint 1"), (2, "recovered", "some prose of hint 2")]
    assert [tuple(r) for r in stabilise.coverage(stable, read).select("source_letters", "output_letters").collect()] == [(45, 45)]
    assert len(calls) == 1


def test_texts_of_blocks_and_hints_move_once(spark):
    """The stabiliser's shuffles hold little more than each text once: boxes tell what texts are needed for."""
    columns = "doc_id long, page int, {} int, text string, {} double, x0 double, y0 double, x1 double, y1 double"
    place = lambda i: (60.0, 40.0 + 110 * i, 440.0, 130.0 + 110 * i)
    rng = random.Random(5)
    texts = [["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9000)) for _ in range(8)] for _ in range(60)]
    rows = [(d, 0, i, t, 10.0, *place(i)) for d, page in enumerate(texts) for i, t in enumerate(page)]
    blocks = spark.createDataFrame(rows, columns.format("pos", "kind_no")).drop("kind_no").withColumn("kind", F.lit("paragraph"))
    hints = spark.createDataFrame(rows, columns.format("hint_ord", "size")).withColumn("font", F.lit("Times"))
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: store.executorSummary("driver").totalShuffleWrite()
    before = moved()
    stable = stabilise.stabilised(blocks, hints)
    assert sum(len(r.text) for r in stable.select("text").collect()) == 60 * 8 * 9000
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert moved() - before < 3 * 60 * 8 * 9000


def test_coverage_writes_no_texts_and_moves_each_once(spark, tmp_path, monkeypatch):
    """Pages' letters ask for the stabilised blocks and for what the rules say of the hints, not for the hints' texts in a table."""
    rng = random.Random(7)
    lines = lambda: "\n".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9000)) for _ in range(8))
    spark.createDataFrame([(d, lines()) for d in range(60)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    store = spark.sparkContext._jsc.sc().statusStore()
    moved = lambda: store.executorSummary("driver").totalShuffleWrite()
    monkeypatch.setattr(_common, "shared_folder", lambda _: f"{tmp_path}/shared")
    before = moved()
    rows = documents.stabilised_coverage(spark, str(tmp_path)).collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert rows and sum(f.stat().st_size for f in (tmp_path / "shared").rglob("*.parquet")) < 9000 * 8
    assert moved() - before < 3 * 60 * 8 * 9000
