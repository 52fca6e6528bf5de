"""Stages that go on where they stopped, and providers that are not asked again once they were down."""

import pytest
from pyspark.sql import functions as F

from quirespark.operators import stages as S
from quirespark.operators.providers import ProviderError
from quirespark.operators.waves import locked, translate_in_waves
from quirespark.sources import checkpoints


def documents(spark, n=6):
    return spark.createDataFrame([(i, f"text {i}") for i in range(n)], "doc_id long, text string")


def stage(name, made):
    def make(docs):
        made.append((name, sorted(r.doc_id for r in docs.select("doc_id").collect())))
        return docs.withColumn("state", F.concat(F.coalesce("state", F.col("text")), F.lit(f"|{name}")))

    return S.Stage(name, make)


def test_a_run_stopped_after_any_stage_ends_like_one_that_was_not(spark, tmp_path):
    docs, names = documents(spark), S.NAMES[:4]
    whole = {tuple(r) for r in S.run(docs, [stage(n, []) for n in names], str(tmp_path / "whole"), "de").collect()}
    assert {(r[2], r[3]) for r in whole} == {(3, f"text {i}|" + "|".join(names)) for i in range(6)}
    for stop in names[:-1]:
        made = []
        chain = [stage(n, made) for n in names]
        S.run(docs, chain, str(tmp_path / stop), "de", until=stop)
        assert {tuple(r) for r in S.run(docs, chain, str(tmp_path / stop), "de").collect()} == whole
        assert [n for n, _ in made] == list(names) and all(ids == list(range(6)) for _, ids in made)  # nothing twice


def test_documents_at_different_stages_make_only_what_they_lack(spark, tmp_path):
    docs, made, folder = documents(spark), [], str(tmp_path)
    chain = [stage(n, made) for n in ("a", "b", "c")]
    S.run(docs.where("doc_id < 4"), chain, folder, "de", until="a")
    S.run(docs.where("doc_id < 2"), chain, folder, "de", until="b")
    checkpoints.save(docs.where("doc_id = 5").withColumn("state", F.lit("x")), folder, "c", "de")  # later stages stand for earlier ones
    changed = docs.withColumn("text", F.when(F.col("doc_id") == 0, "other").otherwise(F.col("text")))
    del made[:]
    got = {r.doc_id: r.state for r in S.run(changed, chain, folder, "de").collect()}
    assert made == [("a", [0, 4]), ("b", [0, 2, 3, 4]), ("c", [0, 1, 2, 3, 4])]
    assert got == {i: f"text {i}|a|b|c" for i in (1, 2, 3, 4)} | {0: "other|a|b|c", 5: "x"}


def test_a_stage_that_fails_leaves_those_before_it(spark, tmp_path):
    docs, made, folder = documents(spark), [], str(tmp_path)

    def broken(i):
        raise RuntimeError("killed")

    bad = S.Stage("b", lambda d: d.withColumn("state", F.when(F.col("doc_id") == 5, F.udf(broken)("doc_id")).otherwise(F.col("state"))))
    with pytest.raises(Exception, match="killed"):
        S.run(docs, [stage("a", made), bad], folder, "de")
    assert {r.reached for r in S.manifest(docs, ["a", "b"], folder, "de").collect()} == {0}
    got = S.run(docs, [stage("a", made), stage("b", made)], folder, "de")
    assert {r.reached for r in got.collect()} == {1} and [n for n, _ in made] == ["a", "b"]
    assert S.run(docs.limit(0), [stage("a", [])], folder, "de").collect() == []


class Counting:
    """Writes a file for each call; refuses all of them, or none."""

    def __init__(self, name, folder, refuse):
        self.name, self.folder, self.refuse = name, str(folder), refuse

    def __call__(self, texts):
        import uuid

        open(f"{self.folder}/{self.name}-{uuid.uuid4().hex}", "w").close()
        if self.refuse:
            raise ProviderError("down", "429")
        return [t.upper() for t in texts]


def test_no_later_wave_asks_a_provider_that_was_down(spark, tmp_path):
    (tmp_path / "calls").mkdir()
    items = spark.range(400).selectExpr("id as doc_id", "0 as pos", "concat('i', id) as item_id", "concat('text ', id) as source").repartition(8)
    first, second = Counting("first", tmp_path / "calls", True), Counting("second", tmp_path / "calls", False)
    calls = lambda name: len(list((tmp_path / "calls").glob(f"{name}-*")))
    folder = str(tmp_path / "out")
    got = translate_in_waves(items, [first, second], folder, waves=4, first=50)
    assert {(r.doc_id, r.provider, r.translated, r.reason) for r in got.collect()} == {(i, "second", f"TEXT {i}", None) for i in range(400)}
    made = spark.read.parquet(f"{folder}/wave=0").count()
    assert 0 < made < 60 and 1 <= calls("first") <= 8  # once for each task of the first wave, none afterwards
    assert locked(spark, folder, 4) == {"first"}
    before = calls("first"), calls("second")
    assert got.count() == 400 and translate_in_waves(items, [first, second], folder, waves=4, first=50).count() == 400
    assert (calls("first"), calls("second")) == before  # finished waves stand
