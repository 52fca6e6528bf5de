import pytest

from quirespark.plans import catalog

from .compare import assert_same


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert_same(catalog.QUERIES[name](spark, sf_dir), duck, catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_query_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_insertion_takes_all_hints_without_a_block(spark, sf_dir):
    from quirespark.sources import entities as E

    box = ("doc_id", "page", "x0", "y0", "x1", "y1")
    kept = {}
    for r in E.blocks(spark, sf_dir).where("doc_id < 60").select(*box).collect():
        kept.setdefault(r[:2], []).append(r[2:])

    def covered(h, b):
        x, y = (h[0] + h[2]) / 2, (h[1] + h[3]) / 2
        shared = max(0.0, min(h[2], b[2]) - max(h[0], b[0])) * max(0.0, min(h[3], b[3]) - max(h[1], b[1]))
        return b[0] <= x <= b[2] and b[1] <= y <= b[3] or shared >= 0.42 * (h[2] - h[0]) * (h[3] - h[1])

    hints = E.hints(spark, sf_dir).where("doc_id < 60").select(*box, "hint_ord").collect()
    want = {(h["doc_id"], h["hint_ord"]) for h in hints if not any(covered(h[2:6], b) for b in kept.get(h[:2], ()))}
    rows = catalog.QUERIES["geometry_insertion"](spark, sf_dir).where("origin = 1 and doc_id < 60").select("doc_id", "num").collect()
    assert {tuple(r) for r in rows} == want and len(rows) == len(want) and want
