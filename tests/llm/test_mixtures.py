"""Mixing sources and importance resampling: SQL on the tables, plain versions on awkward rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quirespark.llm import mixing
from quirespark.llm.mixing import emit_mixture, mix_sources
from quirespark.llm.queries import ORACLE_SQL, QUERIES
from quirespark.llm.resampling import importance_weights, resample_to_target
from tests.compare import assert_same

from .util import SCHEMA, awkward, empty


@pytest.mark.parametrize("name", ["op11_resampling", "op12_mixing"])
def test_query_equals_its_sql(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, ORACLE_SQL[name])


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain_targets(sizes, weights, share, cap):
    """Give by weight, cut what is over a cap, share it again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), sum(sizes.values()) * share
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > cap * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in open_}
        for s in over:
            target[s] = Fraction(cap * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def plain_mix(rows, weights=(3, 1, 2), percent=150, cap=2, seed=2024):
    sizes = Counter()
    for r in rows:
        sizes[r.source] += len(words(r.text))
    target = plain_targets(dict(sizes), weights, Fraction(percent, 100), cap)
    for r in rows:
        size = len(words(r.text))
        rate = float(target[r.source]) / sizes[r.source] if sizes[r.source] else 0.0
        u = int(hashlib.md5(f"{seed}:{'' if r.doc_id is None else r.doc_id}:{r.text or ''}".encode()).hexdigest()[:8], 16)
        yield r.doc_id, r.source, size, sizes[r.source], float(target[r.source]), math.floor(rate) + (u < (rate % 1) * 2**32)


def mixed_sources(spark):
    more = [(100 + i, "a b c " * (i % 7), "en", f"source {i % 5}" if i % 5 else None) for i in range(60)]
    return awkward(spark).unionByName(spark.createDataFrame(more, SCHEMA), allowMissingColumns=True)


@pytest.mark.parametrize("few", [100_000, 1])
def test_mixing_equals_plain_version_by_broadcast_and_by_salts(spark, monkeypatch, few):
    monkeypatch.setattr(mixing, "FEW_SOURCES", few)
    docs = mixed_sources(spark).withColumns({c: F.lit(9) for c in ("Source_Size", "_U", "Copy", "target")})
    want = Counter(plain_mix(docs.collect()))
    got = Counter((r.doc_id, r.source, r["size"], r.source_size, r.target, r.copies) for r in mix_sources(docs).collect())
    assert got == want
    assert len({r[5] for r in want}) > 1
    emitted = emit_mixture(docs)
    assert emitted.columns == [c for c in docs.columns if c != "Copy"] + ["copy"]
    made = Counter((r.doc_id, r.source, r.text) for r in emitted.collect())
    counted = Counter()
    for r, m in zip(docs.collect(), plain_mix(docs.collect()), strict=True):
        counted[(r.doc_id, r.source, r.text)] += m[5]
    assert made == +counted


def test_taken_words_come_near_targets_where_a_source_has_many_documents(spark):
    docs = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', 50 + int(id % 100)) as text", "if(id % 3 = 0, 'hot', concat('s', id % 11)) as source")
    for r in mix_sources(docs).groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target


def test_mixing_plan_is_native_and_holds_no_cross_join(spark):
    plan = mix_sources(mixed_sources(spark))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Cartesian|NestedLoop", plan)


def test_mixing_and_resampling_of_nothing(spark):
    assert mix_sources(empty(spark)).collect() == [] and emit_mixture(empty(spark)).collect() == []
    assert resample_to_target(empty(spark), empty(spark)).collect() == []


def features(text, least, most):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return len(found), Counter(" ".join(found[i : i + n]) for n in range(least, most + 1) for i in range(len(found) - n + 1))


def plain_weights(docs, target, least, most, buckets):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(), Counter()
    for texts, counts in ((docs, s), (target, t)):
        for r in texts:
            for f, n in features(r.text, least, most)[1].items():
                counts[bucket(f)] += n
    total_s, total_t = sum(s.values()), sum(t.values())
    for r in docs:
        n_words, found = features(r.text, least, most)
        gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(total_s + buckets) / ((s[b] + 1) * float(total_t + buckets))))
        yield r.doc_id, n_words, sum(found.values()), sum(n * gain(bucket(f)) for f, n in found.items())


@pytest.mark.parametrize(("least", "most", "buckets"), [(1, 1, 10_000), (1, 3, 500), (2, 2, 50)])
def test_resampling_equals_plain_version(spark, least, most, buckets):
    docs = awkward(spark).unionByName(
        spark.createDataFrame([(200, "ÄÖ Straße 12ab ΑΒΓ x_y I'm É", "de", None), (201, "the cat The CAT the", "en", None)], SCHEMA), allowMissingColumns=True
    )
    target = docs.where("doc_id in (1, 10) or doc_id is null").select("text", F.lit(1).alias("item_id"))
    weighed = importance_weights(docs, target, least, most, buckets)
    want = list(plain_weights(docs.collect(), target.collect(), least, most, buckets))
    assert Counter((r.doc_id, r.n_words, r.n_features, r.weight) for r in weighed.collect()) == Counter(want)
    got = resample_to_target(docs, target, least, most, buckets, percent=40, min_words=5).collect()
    h = lambda i: int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
    scored = [(i, n, f, w, w + math.floor(-1000 * math.log(-math.log((h(i) + 0.5) / 2**32)))) for i, n, f, w in want]
    fit = sorted((x for x in scored if x[1] >= 5), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    assert Counter((r.doc_id, r.n_features, r.weight, r.score) for r in got) == Counter((i, f, w, s) for i, _, f, w, s in scored)
    ranks = sorted((r["rank"], r.doc_id, r.score) for r in got if r["rank"] is not None)
    assert ranks == [(k, x[0], x[4]) for k, x in enumerate(fit[: 40 * len(fit) // 100], 1)] and ranks


def test_each_distinct_tuple_is_hashed_once_and_blocks_stay_small(spark):
    from quirespark.llm import resampling

    docs = spark.range(3000).selectExpr("id as doc_id", "concat('common words here ', id % 50) as text")
    blocks = resampling._blocks(docs.repartition(2), 1, 2)
    assert max(len(r.docs) for r in blocks.select("docs").collect()) <= resampling.BLOCK_DOCS
    assert all(len(r.words) == 53 for r in blocks.select("words").collect())


def test_large_blocks_are_written_and_read_few_at_a_time(spark, tmp_path, monkeypatch):
    """A row group holds a block or two of megabytes, not all those of a task."""
    from quirespark.llm import _common

    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=9)) for _ in range(200_000)]
    texts = [" ".join(w + x for w in words) + " the cat" for x in "klmnop"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(_common, "shared_folder", lambda _: str(tmp_path))
    monkeypatch.setattr(_common, "discard", lambda _: None)
    got = importance_weights(docs, docs.where("false").select("text"))
    assert sorted((r.doc_id, r.n_features) for r in got.collect()) == [(i, 200_002) for i in range(6)]
    files = [pq.ParquetFile(f) for f in tmp_path.rglob("*.parquet")]
    groups = [f.metadata.row_group(i) for f in files if "totals" in f.schema_arrow.names for i in range(f.num_row_groups)]
    assert sum(g.num_rows for g in groups) >= 3 and max(g.num_rows for g in groups) <= 2
