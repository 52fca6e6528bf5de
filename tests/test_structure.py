"""Span trees of pages, checked formulas, documents as pieces of markup."""

import pytest
from pyspark.sql import functions as F

from quirespark.functions import validate as C
from quirespark.operators import flow
from quirespark.plans import catalog, structure
from quirespark.sources import spans as S

from .compare import assert_same

BLOCK = (
    "doc_id long, page int, pos long, kind string, text string, flow_columns int, column string, style string, indent double, size double, "
    "x0 double, y0 double, x1 double, y1 double"
)


@pytest.mark.parametrize("name", ["page_span_rows", "page_text_hints", "formula_checks", "document_markup"])
def test_equals_sql(spark, sf_dir, duck, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.SQL[name])


PAGES = [
    (1, "<p>  one <b>two</b><br>&nbsp;&nbsp;three <i>x</i><br>four<ul><li>a &amp;lt; b</LI></ul><h2></h2>"),
    (2, None),
    (3, ""),
    (4, 'no block<script>var t="</p>";track(0);</script><P class="a">&nbsp;<em>lead</em><!-- <b> --><br/>x<br><br>y</p>tail<th><code>k</code></th>'),
    (5, "<p><b>open<p>next</b> <strong>s</strong></p>"),
    (6, "<h1>\u0001\u0002A</h1><pre> q < r </pre><p><br></p><td>1 < 2"),
]


def test_span_tree(spark, duck):
    pages = spark.createDataFrame(PAGES, "page_id long, html string")
    got = {(r.page_id, r.tag, r.text): r for r in S.page_hints(pages).collect()}
    first = got[1, "p", "one two\nthree x\nfour"]
    assert (first.bold_ratio, first.italic_ratio, first.paragraph_indent, first.first_line_indent_em) == (0.143, 0.048, "no", 0.0)
    assert {k for k in got} == {
        (1, "p", "one two\nthree x\nfour"), (1, "li", "a &lt; b"), (4, "p", "lead\nx\ny"), (4, "th", "k"), (5, "p", "open"), (5, "p", "next s"),
        (6, "h1", "A"), (6, "pre", "q < r"), (6, "td", "1 < 2"),
    }
    assert got[4, "th", "k"].font == "Courier" and got[4, "th", "k"].bold_ratio == 1.0 and got[4, "p", "lead\nx\ny"].paragraph_indent == "yes"
    con = duck.cursor()
    con.execute("create or replace temp table given (page_id bigint, html varchar)")
    con.executemany("insert into given values (?, ?)", PAGES)
    for name, made in (("page_span_rows", S.page_spans), ("page_text_hints", S.page_hints)):
        assert_same(made(pages), con, catalog.SQL[name].replace("FROM pages)", "FROM given)"))
    assert S.page_hints(pages.limit(0)).count() == 0


def test_span_tree_takes_blocks_of_many_spans(spark):
    pages = spark.createDataFrame([(1, "<p>" + "<b>x</b> y<br>" * 30_000)], "page_id long, html string")
    spans = S.page_spans(pages)
    assert spans.where("flags = 16 and trim(text) <> ''").count() == 30_000
    assert S.page_hints(pages).first().bold_ratio == pytest.approx(0.333, abs=0.001)


@pytest.mark.parametrize(
    "formula, kind, name",
    [
        (r"\frac{a}{b}", None, None), (None, None, None), ("", None, None), (r"\{ x \}", None, None), (r"\foo + \bar", "undefined", "foo"),
        (r"{a", "unclosed", "{"), ("a}", "mismatch", "}"), (r"\begin{matrix}{a\end{matrix}", "mismatch", "matrix"), (r"\begin{cases}a", "unclosed", "cases"),
        (r"\begin{tabular}\foo", "environment", "tabular"), (r"\end{cases}", "mismatch", "cases"), (r"\begin{cases}\begin{matrix}x\end{matrix}\end{cases}", None, None),
        ("{" * 500 + "}" * 500, None, None), (r"\\ \, a", None, None), (r"\begin{}", "environment", ""),
    ],
)
def test_faults(spark, formula, kind, name):
    got = spark.createDataFrame([(formula,)], "f string").select(C.fault(F.col("f")).alias("r")).first().r
    assert (got.kind, got.name) == (kind, name)


def test_each_formula_has_a_budget_of_its_own(spark):
    rows = [r"\int \dx", r"\dx \dy", r"\dx \dy \dz", r"x_{\foo} \dx", r"\unheard \dx", r"\dx }", r"\alpha", None]
    df = spark.createDataFrame([(i, f) for i, f in enumerate(rows)], "i int, f string").select("i", C.repaired_by_check(F.col("f")).alias("r"))
    got = {r.i: (r.r.formula, r.r.repairs, r.r.kind, r.r.name) for r in df.collect()}
    assert got == {
        0: (r"\int \,\mathrm{d}x", 1, None, None),
        1: (r"\,\mathrm{d}x \,\mathrm{d}y", 2, None, None),
        2: (r"\,\mathrm{d}x \,\mathrm{d}y \dz", 2, "undefined", "dz"),
        3: (r"x_{\mathrm{foo}} \,\mathrm{d}x", 2, None, None),
        4: (r"\unheard \dx", 0, "undefined", "unheard"),
        5: (r"\,\mathrm{d}x }", 1, "mismatch", "}"),
        6: (r"\alpha", 0, None, None),
        7: (None, 0, None, None),
    }


def _row(doc, page, pos, kind, text, flow_columns=2, column="column1", style="normal", box=(100.0, 200.0, 400.0, 500.0)):
    return (doc, page, pos, kind, text, flow_columns, column, style, None, 8.0, *box)


def _whole(df, doc):
    rows = [r for r in df.collect() if r.doc_id == doc]
    return "".join(r.text for r in sorted(rows, key=lambda r: (r.pos is None, r.pos, r.part)))


def test_mixed_document(spark):
    rows = [
        _row(1, 0, 0, "title", "T"),
        _row(1, 0, 1, "figure", "f.png"),
        _row(1, 0, 2, "caption", "Figure 1.", style="italic", box=(100.0, 510.0, 400.0, 570.0)),
        _row(1, 0, 3, "list_item", "• First"),
        _row(1, 0, 4, "footer", "7"),
        _row(1, 0, 5, "list_item", "second"),
        _row(1, 0, 6, "section", "Methods"),
        _row(1, 0, 7, "figure", "g.png", column="full"),
        _row(1, 0, 8, "caption", "Figure 2."),
        _row(1, 0, 9, "title", "late"),
        _row(2, 0, 0, "title", ""),
        _row(3, 0, 0, "list_item", "x", flow_columns=9),
        _row(None, None, 0, None, None, flow_columns=None, column=None, style=None),
    ]
    made = flow.document_pieces(spark.createDataFrame(rows, BLOCK))
    text = _whole(made, 1)
    order = [
        "\\begin{flushleft}", "\\begin{multicols}{2}", "\\includegraphics[width=0.759\\linewidth]{\\detokenize{f.png}}", "\\begin{minipage}{0.759\\linewidth}", "\\textit{Figure 1.}",
        "\\begin{itemize}\n\\item First\n\\item second\n\\end{itemize}\n\\SourceSection{Methods}", "\\end{multicols}\n\\begin{center}\n\\includegraphics",
        "Figure 2.", "\\begin{multicols}{2}\\raggedcolumns\nlate\\par\n\\end{multicols}\n\\end{document}\n",
    ]
    places = [text.find(x) for x in order[:-1]] + [text.rfind(order[-1])]
    assert -1 not in places and places == sorted(places), (places, text)
    assert _whole(made, 2) == "\\end{document}\n"
    assert _whole(made, 3) == "\\begin{multicols}{3}\\raggedcolumns\n\\begin{itemize}\n\\item x\n\\end{itemize}\n\\end{multicols}\n\\end{document}\n"
    assert _whole(made, None) == "\\end{document}\n"
    assert flow.document_pieces(spark.createDataFrame([], BLOCK)).count() == 0


def test_blocks_are_shuffled_once(spark, sf_dir):
    plan = flow.document_pieces(structure.flowing_blocks(spark, sf_dir))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1
