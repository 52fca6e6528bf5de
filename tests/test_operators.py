"""Providers, checkpoints, geometric insertion, slots and TeX rules on small cases."""

import pytest
from pyspark.sql import functions as F

from quirespark.functions import protect, tex
from quirespark.operators import batching, integrity, layout, providers
from quirespark.sources import checkpoints


class Picky:
    """Fails on any batch that holds a text with 'bad'."""

    name = "picky"

    def __init__(self):
        self.sizes = []

    def __call__(self, texts):
        self.sizes.append(len(texts))
        if any("bad" in t for t in texts):
            raise providers.ProviderError("output")
        return [t.upper() for t in texts]


class Down:
    name = "down"

    def __call__(self, texts):
        raise providers.ProviderError("down")


def test_bisection_isolates_the_bad_text():
    p = Picky()
    got = providers.run_chain(["a", "bad"], [p, providers.Identity()])
    assert [g[:2] for g in got] == [("picky", "A"), ("identity", "bad")]
    assert p.sizes == [2, 1, 1]


def test_calls_are_bounded():
    p = Picky()
    got = providers.run_chain(["bad"] * 10, [p])
    assert len(p.sizes) == 19 and all(g[0] is None and g[1] == "bad" and g[3] == "output" for g in got)


def test_a_provider_that_is_down_is_asked_once():
    got = providers.run_chain(["x"] * 30, [Down(), providers.Identity()])
    assert {g[0] for g in got} == {"identity"}
    assert providers.run_chain(["x"], [Down()]) == [(None, "x", 1, "down")]


@pytest.mark.parametrize(
    "source, out, reason",
    [("a", "", "empty"), ("", "", None), ("[[MATH_0]] a", "b [[MATH_0]]", None), ("[[MATH_0]]", "[[MATH_0]] [[MATH_0]]", "placeholders"), ("a", None, "empty")],
)
def test_faults(source, out, reason):
    assert providers.fault(source, out) == reason


def test_wrong_count_is_a_fault():
    assert providers.run_chain(["a", "b"], [lambda t: t[:1] if len(t) > 1 else t])[0][3] is None


def test_translate_keeps_every_row(spark):
    rows = spark.createDataFrame([(i, 0, f"i{i}", None if i == 3 else f"t {i} bad" if i % 5 == 0 else f"t {i}") for i in range(40)], "doc_id long, pos int, item_id string, source string")
    got = {r.doc_id: r for r in providers.translate(rows, [Picky(), providers.Identity()]).collect()}
    assert len(got) == 40 and got[3].translated == "" and got[5].provider == "identity" and got[6].translated == "T 6"
    assert providers.translate(rows.limit(0), [providers.Identity()]).count() == 0


def test_checkpoints_are_guarded(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two")], "doc_id long, text string")
    checkpoints.save(docs.withColumn("state", F.concat(F.lit('{"t": "'), "text", F.lit('"}'))), str(tmp_path), "structure", "de")
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 2, "new").otherwise(F.col("text")))
    got = {r.doc_id: r.state for r in checkpoints.load(changed, str(tmp_path), "structure", "de").collect()}
    assert got == {1: '{"t": "one"}', 2: None}
    assert checkpoints.delete(spark, str(tmp_path), "structure", "de")
    assert not checkpoints.delete(spark, str(tmp_path), "structure", "de")


def test_insertion_by_geometry(spark):
    kinds = "doc_id long, page int, {} int, x0 double, x1 double, y0 double"
    blocks = spark.createDataFrame([(1, 0, 0, 50.0, 450.0, 100.0), (1, 0, 1, 50.0, 450.0, 300.0), (1, 0, 2, 550.0, 950.0, 100.0)], kinds.format("pos"))
    extra = spark.createDataFrame([(1, 0, 0, 50.0, 450.0, 200.0), (1, 0, 1, 550.0, 950.0, 400.0), (1, 0, 2, 50.0, 450.0, 900.0), (1, 0, 3, 0.0, 1000.0, 50.0)], kinds.format("hint_ord"))
    got = layout.insert_by_geometry(blocks, extra).orderBy("place").collect()
    assert [(r.origin, r.num) for r in got] == [(1, 3), (0, 0), (1, 0), (0, 1), (1, 2), (0, 2), (1, 1)]


def test_slots_equal_the_recurrence(spark):
    import random

    rng, rows = random.Random(5), []
    for i in range(200):
        at = rng.randrange(300_000)
        rows.append((1 + i % 3, i, at, at + 20_000 if i % 9 == 0 else None))
    df = spark.createDataFrame(rows, "user_id long, event_id long, at_ms long, free_ms long")
    got = {r.event_id: r.start_ms for r in batching.request_slots(df).collect()}
    last = {}
    for u, i, at, free in sorted(rows, key=lambda r: (r[2], r[1])):
        last[u] = max(at, free or at, last.get(u, -10_000) + 3334)
        assert got[i] == last[u]


@pytest.mark.parametrize(
    "text, out",
    [
        ("C_A_B", "{C_A}_B"), ("X^a^b", "{X^a}^b"), ("X_a^b_c", "{X_a^b}_c"), ("x_1^2", "x_1^2"), ("{a_b_c}", "{{a_b}_c}"), ("", ""),
        (r"\alpha_i_j", r"{\alpha_i}_j"), ("a_{i_j_k}", "a_{{i_j}_k}"), ("_a", "_a"), ("a_b_c_d", "{{a_b}_c}_d"), ("a_", "a_"), ("{a", "{a"), ("a}", "a}"),
    ],
)
def test_repeated_scripts(text, out):
    assert tex.grouped_scripts(text) == out


@pytest.mark.parametrize(
    "text, parts",
    [
        ("a §math{x} b", [("text", "a "), ("math", "x"), ("text", " b")]), ("$math{\\math{y_{1}}}", [("math", "y_{1}")]),
        ("§math{open", [("text", "§math{open")]), ("", [("text", "")]), ("§math{a}§math{b}", [("math", "a"), ("math", "b")]),
    ],
)
def test_wrapped_parts(text, parts):
    assert tex.wrapped_parts(text) == parts


def test_brace_errors(spark):
    cases = {"{a}": None, "": None, "}{": "extra closing brace", "{{": "2 unmatched opening brace(s)", r"\{": None, r"\\{": None, r"{\}": "1 unmatched opening brace(s)", r"\alpha{": "1 unmatched opening brace(s)"}
    df = spark.createDataFrame([(k,) for k in cases] + [(None,)], "t string")
    got = {r.t: r.e for r in df.select("t", tex.brace_error(F.col("t")).alias("e")).collect()}
    assert got == {**cases, None: None}


def test_protection_round_trip(spark):
    terms = ["state space", "state", "a.b", " "]
    texts = ["", "state space of state", "a.b axb [[MATH_12]]", "none", "statestate", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    safe = df.select("t", protect.protected(F.col("t"), terms).alias("s"), protect.held(F.col("t"), terms).alias("k"))
    rows = safe.select("*", protect.restored(F.lower("s"), F.col("k")).alias("r"), protect.restore_fault(F.concat("s", F.lit("qzkeep")), F.col("k")).alias("f")).collect()
    assert all(r.r == r.t for r in rows)
    got = {r.t: r.s for r in rows}
    assert got["state space of state"] == "QZKEEP0ZQ of QZKEEP1ZQ" and got["a.b axb [[MATH_12]]"] == "QZKEEP0ZQ axb QZKEEP1ZQ"
    assert {r.f for r in rows if r.t is not None} == {"leftover"}


BOXED = "doc_id long, page int, pos int, kind string, text string, x0 double, y0 double, x1 double, y1 double, anchored boolean"


def plain_dedup(rows, ratio=0.92):
    """The blocks kept of one page, one after another."""
    import re
    from difflib import SequenceMatcher

    def sig(r):
        if r[3] in ("equation", "figure", "table"):
            return ""
        return re.sub(r"[^\w\s]", "", " ".join(r[4].casefold().split())).strip()

    def shared(p, q):
        w, h = min(p[7], q[7]) - max(p[5], q[5]), min(p[8], q[8]) - max(p[6], q[6])
        small = min((x[7] - x[5]) * (x[8] - x[6]) for x in (p, q))
        return max(0, w) * max(0, h) / max(1, small)

    kept = []
    for r in sorted(rows, key=lambda r: r[2]):
        a, hit = sig(r), None
        for k in kept if len(a) >= 18 else ():
            b = sig(k[1])
            if len(b) >= 18 and (a == b or (shared(r, k[1]) >= 0.28 and (SequenceMatcher(None, a, b).ratio() >= ratio or (min(len(a), len(b)) >= 30 and (a in b or b in a))))):
                hit = k
                break
        if hit is None:
            kept.append([r[2], r])
        elif (r[9] and not hit[1][9]) or (r[9] == hit[1][9] and len(a) > len(sig(hit[1]))):
            hit[1] = r
    return [(k[0], k[1][2]) for k in kept]


def test_similar_blocks_join_the_first(spark):
    fox, more = "the quick brown fox jumps over it", "The quick brown fox jumps over it all!"
    near, far = (0.0, 0.0, 100.0, 100.0), (500.0, 500.0, 600.0, 600.0)
    rows = [(1, 0, 0, "paragraph", fox, *near, False), (1, 0, 1, "paragraph", more, *near, False), (1, 0, 2, "paragraph", "short", *near, False), (1, 0, 3, "paragraph", "short", *near, False)]
    rows += [(1, 1, 8, "paragraph", fox, *near, False), (1, 1, 9, "paragraph", more, *far, False), (1, 1, 10, "table", fox, *near, False), (1, 1, 11, "paragraph", fox.upper(), *far, True)]
    rows += [(1, 2, 20, "paragraph", "words before " + fox + " and a long tail of many other words behind", *near, True), (1, 2, 21, "paragraph", fox, *near, False)]
    got = sorted((r.page, r.pos, r.text_of) for r in integrity.dedup_similar(spark.createDataFrame(rows, BOXED)).collect())
    assert got == [(0, 0, 1), (0, 2, 2), (0, 3, 3), (1, 8, 11), (1, 9, 9), (1, 10, 10), (2, 20, 20)]


def test_similar_blocks_equal_the_plain_loop(spark):
    import random

    rng, rows = random.Random(3), []
    base = ["some words that stand on a page of text", "other words of another paragraph, longer than it", "a third text that is like none of the others"]
    for n in range(300):
        text = rng.choice(base)
        text = text if rng.random() < 0.4 else text + rng.choice([" x", " and more of it", "!"]) if rng.random() < 0.6 else text[: rng.randint(3, 40)]
        x, y = rng.choice([0, 40, 300]), rng.choice([0, 30, 400])
        rows.append((1, n % 12, n, rng.choice(["paragraph", "section", "table"]), text, float(x), float(y), x + 100.0, y + 80.0, rng.random() < 0.3))
    got = sorted((r.page, r.pos, r.text_of) for r in integrity.dedup_similar(spark.createDataFrame(rows, BOXED)).collect())
    assert got == sorted((p, *k) for p in range(12) for k in plain_dedup([r for r in rows if r[1] == p]))
