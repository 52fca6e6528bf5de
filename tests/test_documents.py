"""Formulas, markup and the stabiliser on worked cases."""

import pytest
from pyspark.sql import functions as F

from quirespark.functions import formula as M
from quirespark.functions import markup as K
from quirespark.operators import stabilise


@pytest.mark.parametrize(
    "raw, want",
    [
        ("§theta", r"\theta"),
        ("\theta\tx", r"\theta x"),
        ("\nabla f\nx", r"\nabla f x"),
        ("\right)", r"\right)"),
        ("\tq", " q"),
    ],
)
def test_transport_is_decoded_alike_in_both_forms(spark, raw, want):
    assert M.decode(raw) == want
    df = spark.createDataFrame([(raw,)], "t string").select(M.decode_transport(F.col("t")).alias("d"))
    assert df.first().d == want


@pytest.mark.parametrize(
    "raw, want",
    [
        ("A_x_y", r"{A_x}_y"),
        (r"\begin{equation*}a = b\end{equation*}", "a = b"),
        (r"\det \dt", r"\det \,\mathrm{d}t"),
        (r"\dtheta", r"\,\mathrm{d}\theta"),
        (r"\t\t := x", ":= x"),
        ("a ∈ B", r"a \in  B"),
        ("", ""),
    ],
)
def test_clean(raw, want):
    assert M.clean(raw) == (want, False)


def test_unsafe_commands_are_named():
    assert M.clean(r"\INPUT{x}") == ("", True)
    assert M.recovered_parts("a §math{\\input{x}} b") == [("text", "a "), ("unsafe", ""), ("text", " b")]


def test_break_points_lie_outside_groups():
    text = r"-a = {b + c} + (d - e) \leq f"
    assert [text[k:].split()[0] for k in M.break_points(text)] == ["=", "+", r"\leq"]


@pytest.mark.parametrize("n, target", [(3, 118), (30, 70), (60, 52), (200, 52)])
def test_broken_lines_keep_every_character(n, target):
    math = "a = " + " + ".join(f"x_{{{i}}}" for i in range(n))
    lines = M.broken(math, target)
    assert " ".join(lines) == math and len(lines) <= 10
    assert all(len(x) <= target * 1.2 for x in lines[:-1]) and all(x[0] in "+=" for x in lines[1:])


def test_equation_forms():
    assert M.equation("a & = b", [], "(1)", 1, False) == "\\begin{equation}\na = b\\tag{(1)}\n\\end{equation}\n"
    assert r"\resizebox{\linewidth}{!}{$\displaystyle xxx" in M.equation("x" * 100, [], "", 3, False)
    assert "&\\quad + c" in M.equation(r"\frac{a}{b} = " + "x" * 80 + r" \\ + c", [], "", 3, False)
    assert M.equation("", [], "1", 1, False) == ""


def test_long_chain_of_commands_does_not_recurse():
    text = "§gamma" + "_§gamma" * 5000
    assert M.bare_parts(text) == [("math", text)]


def test_literal_section_signs_are_text(spark):
    assert M.bare_parts("see § 5 and §mathematics") == [("text", "see § 5 and §mathematics")]
    rows = spark.createDataFrame([("§ 5",), ("§mu x",), (None,)], "t string").select(M.bare_command(F.col("t")).alias("b")).collect()
    assert [r.b for r in rows] == [False, True, None]


def test_assembly_and_rendering_round_trip(spark):
    df = spark.createDataFrame([("let §alpha be §mathcal M, 50%",)], "t string")
    s = df.select(K.assembled(M.recover_parts("t")).alias("s")).first().s
    assert s.text == "let [[MATH_0]] be [[MATH_1]], 50%" and s.formulas == {"[[MATH_0]]": r"\alpha", "[[MATH_1]]": r"\mathcal M"}
    shown = df.select(K.assembled(M.recover_parts("t")).alias("s")).select(K.rendered(F.col("s.text"), F.col("s.formulas")).alias("r")).first().r
    assert shown == r"let \(\alpha\) be \(\mathcal M\), 50\%"


def test_nulls_stay_null(spark):
    df = spark.createDataFrame([(None,)], "t string")
    row = df.select(M.clean_formula("t").alias("c"), M.recover_parts("t").alias("p"), K.rendered(F.col("t"), F.create_map().cast("map<string,string>")).alias("r")).first()
    assert row.c.formula is None and row.p is None and row.r is None


def test_anchored_recovered_and_deduplicated(spark):
    full = "measured words of the paragraph that stands here"
    blocks = spark.createDataFrame(
        [(1, 0, 0, "paragraph", "misread words of", 100.0, 100.0, 400.0, 200.0), (1, 0, 1, "list_item", "• an item", 100.0, 500.0, 400.0, 600.0),
         (1, 0, 2, "paragraph", full, 600.0, 700.0, 900.0, 800.0)],
        "doc_id long, page int, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double",
    )
    hints = spark.createDataFrame(
        [(1, 0, 0, full, "Arial-Bold", 10.0, 100.0, 100.0, 400.0, 200.0), (1, 0, 1, "a paragraph that was lost entirely", "Times", 10.0, 100.0, 300.0, 400.0, 400.0)],
        "doc_id long, page int, hint_ord int, text string, font string, size double, x0 double, y0 double, x1 double, y1 double",
    )
    rows = sorted(stabilise.stabilised(blocks, hints).collect(), key=lambda r: r.place)
    assert [(r.text, r.origin) for r in rows] == [(full, "source"), ("a paragraph that was lost entirely", "recovered"), ("an item", "block")]
    assert [r.style for r in rows] == ["bold", "normal", "normal"] and [r["size"] for r in rows] == [10.0, 10.0, None]
    assert not stabilise.coverage(stabilise.stabilised(blocks, hints), hints).first().low


def test_empty_tables(spark, sf_dir):
    from quirespark.sources import entities as E

    b, h = E.blocks(spark, sf_dir).where("false"), E.hints(spark, sf_dir).where("false")
    assert stabilise.stabilised(b, h).count() == 0 and stabilise.column_hint(h).count() == 0 and stabilise.previews(b, h).count() == 0


def test_objects_are_checked(spark, tmp_path):
    from quirespark.sources import objects

    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"<html>"), ("c.pdf", b""), ("d.pdf", b"%PDF" + b"x" * 100), ("e.txt", b"%PDF")):
        (tmp_path / name).write_bytes(data)
    rows = objects.read_objects(spark, str(tmp_path), largest=50).collect()
    assert {r.path[-5:]: r.fault for r in rows} == {"a.pdf": None, "b.pdf": "type", "d.pdf": "too large"}
    bytes_ = spark.createDataFrame([(b"",), (b"%PD",)], "c binary").select(objects.fault(F.col("c"), F.length("c")).alias("f"))
    assert [r.f for r in bytes_.collect()] == ["empty", "type"]


def test_glossary_without_terms(spark):
    from quirespark.functions import provider

    df = spark.createDataFrame([([],), (None,), ([("a", "", "translate", None)],)], "t array<struct<source: string, target: string, policy: string, note: string>>")
    assert [r.g for r in df.select(provider.glossary_lines(F.col("t")).alias("g")).collect()] == ["- none supplied"] * 3


def test_long_lines_stay_whole(spark, tmp_path):
    from quirespark.plans import documents
    from quirespark.sources import entities as E

    line = " ".join(["word"] * 100_020)
    rows = [(i, line if i < 4 else "\n".join(["fast words " * 30] * 12), "en", "s", 1) for i in range(12)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    sizes = [r["n"] for r in E.items(spark, str(tmp_path)).where("doc_id < 4").select(F.size(F.split("source", " ")).alias("n")).collect()]
    assert 100_022 in sizes and set(sizes) <= {100_020, 100_022}
    terms = documents.equation_display(spark, str(tmp_path)).where("doc_id >= 4").select(F.regexp_count("markup", F.lit("x_[{]")).alias("n")).collect()
    assert terms and all(r["n"] == 60 for r in terms)
