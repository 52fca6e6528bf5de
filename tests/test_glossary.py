"""Glossaries by document against one alternation for each."""

import random

import pytest
from pyspark.sql import functions as F

from quirespark.functions import protect as P
from quirespark.operators.glossary import protected_by


@pytest.mark.parametrize("largest", [10**6, 0])
def test_each_document_by_its_own_glossary(spark, largest):
    random.seed(3)
    words = ["a", "ab", "abc", "b.c", "ba", "Über", "x|y", "cab", "(", "aa"]
    glossaries = {g: random.sample(words, 4) for g in range(6)}
    texts = ["".join(random.choice(["a", "b", "c", ".", "x|y", " ", "Über", "[[MATH_0]]", "[[MATH_12]]", "("]) for _ in range(30)) for _ in range(120)]
    rows = [(i, 0, t, i % 7 if i % 11 else None) for i, t in enumerate(texts)] + [(900, 0, None, 1), (901, 0, "", 1), (902, 1, "ab", 99)]
    items = spark.createDataFrame(rows, "doc_id long, pos int, source string, glossary_id int").withColumns({"safe": F.lit(1), "terms": F.lit(2)}).repartition(3)
    terms = [(g, f" {t} ") for g, ts in glossaries.items() for t in (*ts, ts[0])] + [(0, "  "), (0, None), (None, "a")]
    table = spark.createDataFrame(terms, "glossary_id int, term string")
    got = {r.doc_id: (r.safe, r.kept) for r in protected_by(items, table, largest=largest).collect()}
    for g in (*range(6), None):
        mine = spark.createDataFrame([(i, t) for i, _, t, k in rows if (k if k in glossaries else None) == g], "doc_id long, t string")
        for r in mine.select("doc_id", P.protected(F.col("t"), glossaries.get(g, ())).alias("safe"), P.held(F.col("t"), glossaries.get(g, ())).alias("kept")).collect():
            if r.doc_id % 11 or r.doc_id >= 900 or g is None:
                assert got[r.doc_id] == (r.safe, r.kept), (g, r)
    back = protected_by(items, table, largest=largest).select("doc_id", P.restored(F.col("safe"), F.col("kept")).alias("t"))
    assert {r.doc_id: r.t for r in back.collect()} == {i: t for i, _, t, _ in rows}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "glossary_id int, term string")
    items = spark.createDataFrame([(1, 0, "text [[MATH_0]]", 1)], "doc_id long, pos int, source string, glossary_id int")
    assert [tuple(r) for r in protected_by(items, none).collect()] == [(1, 0, "text QZKEEP0ZQ", ["[[MATH_0]]"])]
    assert protected_by(items.limit(0), none).collect() == []
