import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import queries as Q
from quirespark.llm.components import connected_components
from quirespark.llm.language import fit_language_model, identify_languages
from quirespark.llm.packing import WordEncoder, differencing, pack_documents, windows_for
from quirespark.llm.sharding import place, shard_documents
from quirespark.llm.simhash import (
    GrayIndex, fingerprint, fingerprint_edges, gray_levels, gray_rank, keep_representatives, near_groups, simhash_components,
)
from quirespark.llm.toxicity import COST, LEET, ToxicityModel, _Scorer, char_model, decode, fit_toxicity, restore, score_toxicity

from .util import AWKWARD, awkward, empty, union_components

WORDS = Q.tokenizer_file("word_bpe_49k.json")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# Components


def test_components(spark):
    links = [(1, 2), (2, 3), (5, 4), (4, 4), (9, 8), (8, 7), (7, 6), (3, 1), (10, 11), (11, 12), (12, 13), (13, 14)]
    got = connected_components(spark.createDataFrame([*links, (None, 3)], "a long, b long")).collect()
    want = union_components(range(1, 15), links)
    assert {r["node"]: r["component"] for r in got} == want
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 1 Sharding


def check_shards(rows, docs, n_shards):
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(
        (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in docs
    )
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(0 <= s < n_shards and sorted(x) == list(range(len(x))) for s, x in slots.items())


def test_sharding_table(spark, sf_dir):
    rows = rows_of(Q.op1_sharding(spark, sf_dir))
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    check_shards(rows, docs, 24)
    size = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows], minlength=24)
    assert size.max() / size.mean() < 1.02 and size.min() / size.mean() > 0.98
    text, where = dict(docs), defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())  # equal texts stay together


def test_sharding_awkward(spark):
    check_shards(rows_of(shard_documents(awkward(spark), 3)), [x[:2] for x in AWKWARD], 3)
    assert shard_documents(empty(spark), 4).count() == 0


def test_sharding_hot_group_is_split(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, "same text").otherwise(F.concat(F.lit("text "), "id")).alias("text"))
    rows = rows_of(shard_documents(docs, 8, rows_per_slot_cell=50))
    check_shards(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 8)
    size = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows])
    assert size.max() / size.mean() < 1.05


def test_placement_balances_all_dimensions():
    need = np.random.default_rng(1).pareto(2, (2000, 3))
    got = place(need / (need.sum(axis=0) / 10), np.ones((10, 3)))
    for k in range(3):
        load = np.bincount(got, weights=need[:, k])
        assert load.max() / load.mean() < 1.15


def test_sharding_equals_plain_greedy(spark):
    """One level: each group of equal texts, largest first, to the highest dot product with the free capacity."""
    rng = np.random.default_rng(4)
    texts = [" ".join("w" * int(n) for n in rng.integers(1, 9, rng.integers(1, 40))) for _ in range(120)]
    docs = [(i, texts[int(k)]) for i, k in enumerate(rng.integers(0, 120, 300))]
    got = rows_of(shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 5))
    groups = defaultdict(lambda: [0, 0, 0])
    for _, t in docs:
        for k, x in enumerate((len(t.encode()) + 8, t.count(" ") + 1, 1)):
            groups[hashlib.md5(t.encode()).hexdigest()][k] += x
    names = sorted(groups)
    need = [[x / (sum(g[k] for g in groups.values()) / 5) for k, x in enumerate(groups[n])] for n in names]
    free, want = [[1.0] * 3 for _ in range(5)], {}
    for i in sorted(range(len(names)), key=lambda i: (-max(need[i]), i)):
        dots = [sum(a * b for a, b in zip(f, need[i], strict=True)) for f in free]
        best = max(range(5), key=lambda j: (round(dots[j], 12), -j))
        want[names[i]] = best
        free[best] = [a - b for a, b in zip(free[best], need[i], strict=True)]
    text = dict(docs)
    assert {hashlib.md5(text[r["doc_id"]].encode()).hexdigest(): r["shard"] for r in got} == want


def test_sharding_levels(spark):
    """Small blocks: several levels, each block packing its own groups; sizes stay near equal and groups together."""
    rng = np.random.default_rng(6)
    docs = [(i, f"text {i // 3} " + "word " * int(rng.pareto(1.5) * 10)) for i in range(6000)]
    rows = rows_of(shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 4, grain=8, block=150))
    check_shards(rows, docs, 4)
    for what in ("size", "tokens"):
        load = np.bincount([r["shard"] for r in rows], weights=[r[what] for r in rows])
        assert load.max() / load.mean() < 1.03
    count = np.bincount([r["shard"] for r in rows])
    assert count.max() / count.mean() < 1.05
    text, where = dict(docs), defaultdict(set)
    for r in rows:
        where[text[r["doc_id"]]].add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_sharding_repeated_ids_are_dealt(spark):
    docs = [(7, "same text")] * 2000 + [(i, f"text {i}") for i in range(2000)]
    rows = rows_of(shard_documents(spark.createDataFrame(docs, "doc_id long, text string"), 8, rows_per_slot_cell=50))
    check_shards(rows, docs, 8)
    size = np.bincount([r["shard"] for r in rows], weights=[r["size"] for r in rows])
    assert size.max() / size.mean() < 1.05


# 3 Toxicity


def truth(spark, sf_dir, rows):
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    return [(labels[r["doc_id"]], r) for r in rows if r["held_out"] and r["doc_id"] in labels]


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = rows_of(Q.op3_toxicity(spark, sf))
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = truth(spark, sf, rows)
    hit = sum(y and r["predicted"] for y, r in held)
    assert hit / sum(y for y, _ in held) > 0.9 and hit / sum(r["predicted"] for _, r in held) > 0.85


def toy_model(spark):
    lines = [(i, f"{a} you {b} idiot {a} and so is that {b} person {i}", 1) for i, (a, b) in enumerate((x, y) for x in "oh well so now then look hey yes no wow".split() for y in "bad sad mad odd red big hot wet".split())]
    lines += [(1000 + i, f"{a} you are a kind and {b} person {i}", 0) for i, (a, b) in enumerate((x, y) for x in "oh well so now then look hey yes no wow".split() for y in "nice good fine calm kind warm wise safe".split())]
    df = spark.createDataFrame(lines, "doc_id long, text string, toxic int")
    return fit_toxicity(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


def test_toxicity_reads_obfuscation(spark):
    model = toy_model(spark)
    assert "idiot" in model.weights
    bad = ["you 1d10t", "such an i d i o t", "iiidddiioott", "i.d.i.o.t", "IDIOT!!!", "!d!0t", "what an idiooooot", "i-d-1-0-t"]
    fine = ["you are kind", "version 1.0 of 2024", "a a a a a a", None, "", "well-known", "3.14159", "THE!! OF!! AND!!", "B2B and i18n"]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(bad + fine)], "doc_id long, text string, score int")
    got = {r["text"]: r["score"] for r in score_toxicity(df, model).collect()}
    assert {t for t, s in got.items() if s >= 0.3} == set(bad)
    assert score_toxicity(empty(spark), model).count() == 0
    assert score_toxicity(awkward(spark), model).count() == len(AWKWARD)


def scores(spark, model, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r["score"] for r in score_toxicity(df, model).orderBy("doc_id").collect()]


def test_toxicity_reads_long_tokens(spark):
    model = toy_model(spark)
    bad = ["you.are.an.idiot.nobody.wants.you.here.ever.again", "y0u,are,an,1d10t,nobody,wants,you,here,ever,again", "i_d_i_o_t" + "_" * 40, "i" + "_" * 20 + "d" + "_" * 20 + "iot", "idi" + "o" * 60 + "t", "i" + "d" * 30 + "i" * 30 + "ot"]
    assert min(scores(spark, model, bad)) >= 0.3
    once, both, words = scores(spark, model, ["well.idiot.so", "idiot.and.idiot", "idiot and idiot"])
    assert both > once and words > 0.3
    assert max(scores(spark, model, ["x" * 70_000, "kind." * 200, "a1" * 500])) < 0.3


def test_toxicity_decodes_behind_gates(spark):
    model = toy_model(spark)
    bad = ["idiooot", "iidiot", "idiiiot", "id-iot", "i.diot", "id.io.t", "idi_ot", "i'd'iot", "idio-t", "1d-iot", "so.idiiiot.oh"]
    assert min(scores(spark, model, bad)) >= 0.3
    assert max(scores(spark, model, ["well-known", "id-card", "little", "balloon", "THE!! OF!!"])) < 0.3


def test_toxicity_reads_runs(spark):
    model = toy_model(spark)
    bad = ["so id iot", "an i diot", "you id i ot", "1d iot", "such an i d i o t i d i o t"]
    assert min(scores(spark, model, bad)) >= 0.3
    assert max(scores(spark, model, ["an i d card", "so id is it", "to do it id", "a a a", "i i i i i i", "i " * 5000])) < 0.3
    once, twice = scores(spark, model, ["i d i o t " + "x x x x x", "i d i o t i d i o t"])
    assert twice > once
    short = ToxicityModel({"ass": 5.0, "dumb*": 5.0, "moron": 5.0}, model.char_log_p)
    found = _Scorer(short)
    assert found.broken(list("ass")) == [("ass", 5.0)] and found.broken(["a", "ss"]) == [("ass", 5.0)]
    assert sorted(found.spaced("moronmoron")) == [("moron", 5.0)] * 2
    assert [v for _, v in found.spaced("dumbest")] == [5.0]


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = fit_toxicity(awkward(spark), none)
    assert not model.weights and score_toxicity(awkward(spark), model).where("score >= 0.3").isEmpty()


def all_readings(noisy, log_p, collapse):
    """Every way to read a short token, one character after another, with its score."""
    paths = [((0, 0), 0.0, "")]
    before = ""
    for ch in noisy:
        code = ord(ch) - 96 if "a" <= ch <= "z" else 0
        options = [(code, ch, 0.0)] if code else [(ord(x) - 96, x, COST["leet"]) for x in LEET.get(ch, "")]
        after = []
        for (a, b), value, text in paths:
            if not code:
                after.append(((a, b), value + COST["drop"] * (1 if ch in LEET else 0.2), text))
            for c, letter, cost in options:
                repeated = collapse and b == c and (ch == before or not code)
                if repeated:
                    after.append(((a, b), value + COST["collapse"], text))
                after.append(((b, c), value + cost + log_p[a][b][c] + COST["repeat"] * repeated, text + letter))
        paths, before = after, ch
    return [(v + (log_p[a][b][0] if b or not a else 0.0), t) for (a, b), v, t in paths]


@pytest.mark.parametrize("collapse", [True, False])
def test_viterbi_against_all_readings(collapse):
    words = {"idiot": 5.0, "stupid": 3.0, "table": 9.0, "little": 4.0}
    log_p = char_model(np.ones((27, 27, 27)), words, share=0.5)
    tokens = ["1d10t", "$tup1d", "l1ttle", "i.d.i.o.t", "iiddiot", "t@bbl3", "l!tt|e", "s-t-u-p", "6a6b", "1101", "aab1", "-1-", "stuu9!d"]
    rng = np.random.default_rng(1)
    tokens += ["".join(rng.choice(list("ialt01!$6.-s"), rng.integers(1, 8))) for _ in range(60)]
    for token in tokens:
        ways = all_readings(token, log_p, collapse)
        best = max(v for v, _ in ways)
        assert any(t == decode(token, log_p, collapse=collapse) and v == pytest.approx(best) for v, t in ways), token
    assert decode("1d10t", log_p) == "idiot" and decode("$tup1d", log_p) == "stupid"
    assert restore("table,", log_p) == "table" and restore("2024", log_p) == ""


def plain_odds(text, model):
    """The score of a text of plain words, word by word."""
    words = text.split()
    seen = Counter()
    value = {}
    for w in words:
        own = [model.weights.get(f, 0.0) for f in ([w] if len(w) >= 3 else []) + [w[:k] + "*" for k in (4, 5, 6, 7) if len(w) > k]]
        if own and max(own) > 0:
            seen[w] += 1
            value[w] = max(own)
    odds = model.prior - model.rate * len(words) + sum(value[w] * (1 + np.log(n)) for w, n in seen.items())
    return 1 / (1 + np.exp(-odds))


def test_toxicity_equals_plain_sum(spark):
    flat = np.log(np.full((27, 27, 27), 1 / 27))
    model = ToxicityModel({"idiot": 4.0, "moro*": 2.0, "moron": 3.0, "dumbest": 2.5}, flat, 0.01, -3.0)
    rng = np.random.default_rng(2)
    words = ["idiot", "moron", "moros", "morons", "dumbest", "cat", "with", "them", "people", "run", "idiotic"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 40))) for _ in range(50)]
    assert scores(spark, model, texts) == pytest.approx([plain_odds(t, model) for t in texts])


def test_many_tokens_keep_their_reading(spark):
    """What a token says does not depend on how many others stand in its batch."""
    model = toy_model(spark)
    noise = " ".join(f"q{i}z" for i in range(320_000))
    many, few = scores(spark, model, [f"1d10t {noise} 1d10t idiot", "1d10t " + "q1z " * 320_000 + "1d10t idiot"])
    assert many == pytest.approx(few)


# 4 Language


def test_language_held_out(spark, sf_dir):
    rows = rows_of(Q.op4_language(spark, sf_dir))
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(rows) == len(docs) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    right = sum(docs[r["doc_id"]]["lang"] == r["lang_pred"] for r in held)
    assert right / len(held) > 0.97


def test_language_mixture_and_awkward(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_language_model(docs)
    de, fr = (docs.where(f"lang = '{x}' and n_chars between 900 and 1500").first()["text"] for x in ("de", "fr"))
    df = spark.createDataFrame([(1, de + " " + fr), (2, de)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in identify_languages(df, model).collect()}
    assert set(got[1]["mixture"]) == {"de", "fr"} and abs(got[1]["mixture"]["de"] - len(de) / len(de + fr)) < 0.2
    assert set(got[2]["mixture"]) == {"de"} and got[2]["score"] == pytest.approx(1)
    odd = {(r["doc_id"], r["text"]): r for r in identify_languages(awkward(spark), model).collect()}
    assert {k[0] for k, r in odd.items() if r["lang_pred"] == "und"} == {3, 4, 5, 6}
    assert identify_languages(empty(spark), model).count() == 0
    nothing = fit_language_model(empty(spark))
    assert all(r["lang_pred"] == "und" for r in identify_languages(awkward(spark), nothing).collect())


# 5 SimHash


def plain_fingerprint(text):
    import xxhash

    parts = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + 3]) for i in range(len(parts) - 2)] or [b" ".join(parts)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(docs):
    fps = {i: plain_fingerprint(t) for i, t in docs}
    links = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    return fps, union_components(fps, links)


def test_simhash_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    fps, want = plain_components(docs)
    got = rows_of(Q.op5_simhash(spark, sf_dir))
    assert len(got) == len(docs)
    assert all(int(r["fingerprint"], 16) == fps[r["doc_id"]] and len(r["fingerprint"]) == 16 for r in got)
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert len(set(want.values())) < len(docs)


def test_simhash_awkward(spark):
    got = rows_of(simhash_components(awkward(spark)))
    assert len(got) == len(AWKWARD)
    by = {(r["doc_id"], r["fingerprint"]): r["component_id"] for r in got}
    assert {c for (i, f), c in by.items() if f == "0" * 16} == {3}
    assert by[2, f"{plain_fingerprint(AWKWARD[0][1]):016x}"] == 1
    assert simhash_components(empty(spark)).count() == 0


@pytest.mark.parametrize("cap", [4096, 100])
def test_edges_lose_nothing(spark, cap):
    """A dense ball of codes, with buckets small enough to be dealt again."""
    rng = np.random.default_rng(3)
    centre = int(rng.integers(0, 1 << 63))
    codes = {centre ^ sum(1 << int(b) for b in rng.integers(0, 64, rng.integers(0, 5))) for _ in range(300)}
    codes |= {int(x) for x in rng.integers(0, 1 << 63, 50)} | {centre ^ x for x in range(64)}
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    edges = fingerprint_edges(spark.createDataFrame([(c,) for c in signed], "fp long"), 2, cap).collect()
    links = [(a, b) for a in signed for b in signed if a < b and (a ^ b).bit_count() <= 2 or a < b and ((a ^ b) % (1 << 64)).bit_count() <= 2]
    want = union_components(signed, links)
    assert all(((r["a"] ^ r["b"]) % (1 << 64)) for r in edges)
    assert union_components(signed, [(r["a"], r["b"]) for r in edges]) == want


def test_gray_index_pairs():
    rng = np.random.default_rng(5)
    fps = np.unique(np.concatenate([rng.integers(0, 1 << 63, 100), (1 << 40) + rng.integers(0, 500, 150)]).astype(np.uint64))
    index = GrayIndex(fps)
    assert (np.diff(gray_rank(index.fps).astype(object)) > 0).all()
    i, j = index.pairs(2)
    want = {(a, b) for a in range(len(fps)) for b in range(a + 1, len(fps)) if (int(index.fps[a]) ^ int(index.fps[b])).bit_count() <= 2}
    assert set(zip(i.tolist(), j.tolist(), strict=True)) == want and len(i) == len(want)


@pytest.fixture(scope="module")
def many_codes(spark):
    """20,000 codes: scattered ones, and crowds of up to three differing bits around some of them."""
    rng = np.random.default_rng(11)
    codes = rng.integers(0, 1 << 64, 16_000, dtype=np.uint64)
    flips = (np.uint64(1) << rng.integers(0, 64, (4_000, 3)).astype(np.uint64)) * rng.integers(0, 2, (4_000, 3)).astype(np.uint64)
    codes = np.unique(np.concatenate([codes, codes[rng.integers(0, 300, 4_000)] ^ np.bitwise_xor.reduce(flips, axis=1)]))
    return codes, spark.createDataFrame([(int(c),) for c in codes.view(np.int64)], "fp long")


def test_gray_levels_prune(spark, many_codes):
    """Groups follow Gray order over all partitions, nodes hold their codes' shared bits, and every level prunes soundly."""
    codes, fps = many_codes
    levels = gray_levels(fps, size=100)
    groups = {r["node"]: r for r in levels[0].collect()}
    members = {g: np.array(r["codes"], dtype=np.int64).view(np.uint64) for g, r in groups.items()}
    in_order = np.concatenate([np.sort(gray_rank(members[g])) for g in sorted(members)])
    assert (np.diff(in_order.astype(object)) > 0).all() and len(in_order) == len(codes)
    assert {len(m) for g, m in members.items() if g != max(members)} == {100}
    for g, r in groups.items():
        ones, zeros = np.bitwise_and.reduce(members[g]), np.bitwise_and.reduce(~members[g])
        assert r["mask"] % (1 << 64) == int(ones | zeros) and r["value"] % (1 << 64) == int(ones)
    sizes = [nodes.count() for nodes in levels]
    assert sizes == [len(groups), -(-len(groups) // 16), 1]
    kept = {(r["a"], r["b"]): r for r in near_groups(levels, 2).collect()}
    above = near_groups(levels[1:], 2).count()
    assert above <= sizes[1] * (sizes[1] + 1) // 2 and len(kept) < len(groups) * (len(groups) + 1) // 4
    for a in range(len(groups)):
        for b in range(a, len(groups)):
            both = (groups[a]["mask"] & groups[b]["mask"]) % (1 << 64)
            apart = ((groups[a]["value"] ^ groups[b]["value"]) & both).bit_count()
            assert ((a, b) in kept) == (apart <= 2)
            if (a, b) in kept:
                assert kept[a, b]["apart"] == apart and kept[a, b]["known"] % (1 << 64) == both


def test_gray_edges_over_many_groups(many_codes):
    """Links between groups as well as within them: components equal those of all pairs."""
    codes, fps = many_codes
    links = []
    for at, c in enumerate(codes):
        links += [(int(c), int(x)) for x in codes[at + 1 :][np.bitwise_count(codes[at + 1 :] ^ c) <= 2]]
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in fingerprint_edges(fps, 2, 100).collect()]
    assert len(links) > 4_000
    nodes = [int(c) for c in codes]
    assert union_components(nodes, got) == union_components(nodes, links)


def test_gray_search_in_parts():
    """A crowd whose links exceed what is held at once, between two indexes of different heights."""
    crowd = np.array([(1 << i) | (1 << j) for i in range(64) for j in range(64)], dtype=np.uint64)
    x, y = GrayIndex(np.unique(crowd)), GrayIndex(np.array([0, 1 << 63 | 1 << 5 | 1], dtype=np.uint64))
    inner = x.links(x, 2, at_once=1000)
    assert set(union_components(x.fps.tolist(), [(int(a), int(b)) for a, b in inner]).values()) == {1}
    want = {(i, j) for i, a in enumerate(x.fps.tolist()) for j, b in enumerate(y.fps.tolist()) if (a ^ b).bit_count() <= 2}
    got = [(i, j) for part in x.near(y, 2) for i, j in zip(*(k.tolist() for k in part), strict=True)]
    assert set(got) == want and len(got) == len(want) and want


def test_fingerprint_words():
    for t in (None, "", "a", "A b", "a b c", "Ä b\x0bc d\x1ce", "one two three four " * 50):
        assert fingerprint(t) == plain_fingerprint(t)


# 6 Packing


def check_packing(rows, docs, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(WORDS)
    by, seqs = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append(r)
    for pieces in seqs.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert 0 < at <= capacity
    for i, t in docs:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for r in sorted(by[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids))
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    used = {k: sum(r["length"] for r in v) for k, v in seqs.items()}
    padded = sum(n if n & (n - 1) == 0 else capacity for n in used.values())
    return 1 - sum(used.values()) / padded


def test_packing_table(spark, sf_dir):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert check_packing(rows_of(Q.op6_packing(spark, sf_dir)), docs) < 0.03


def test_ids_of_every_character():
    """Next to letters, digits, marks, other scripts and combining accents, ids equal the tokenizer's own."""
    enc = WordEncoder(WORDS)
    assert enc.by_word
    points = [c for c in range(0x30000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 400):
        own = " ".join(f"a{chr(c)}b {chr(c)}1 .{chr(c)}É 中{chr(c)} {chr(c)}\u0301 s{chr(c)}'s" for c in points[at : at + 400])
        assert enc.encode(own) == enc.direct(own), hex(points[at])
        enc.clear()


def test_other_vocabularies_get_whole_texts():
    from tokenizers import Tokenizer

    path = Q.tokenizer_file("byte_bpe_50k.json")
    enc, tok = WordEncoder(path), Tokenizer.from_file(path)
    assert not enc.by_word
    for t in ("Two  words, it's 12.", "É\u0301 日本\n x"):
        assert np.frombuffer(enc.encode(t), dtype="<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


def test_packing_awkward(spark):
    docs = [(i, x[1]) for i, x in enumerate(AWKWARD)]
    docs += [(20, "it's ΑΣ İstanbul <|endoftext|> été  x\x1cy 'Sdon't!!'s ²½"), (21, "naïve\tTab\r\nend"), (22, "日本語 text")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("sequence_id", F.lit(1))
    check_packing(rows_of(pack_documents(df, WORDS)), docs)
    assert pack_documents(empty(spark), WORDS).count() == 0
    assert pack_documents(awkward(spark), WORDS).select("doc_id").distinct().count() == len({x[0] for x in AWKWARD})


def test_differencing():
    rng = np.random.default_rng(2)
    for k in (1, 2, 7, 30):
        sizes = rng.integers(1, 513, 40 * k)
        got = differencing(sizes, k)
        load = np.bincount(got, weights=sizes, minlength=k)
        assert load.max() - load.min() <= 60
    got, k = windows_for(np.array([1500, 1500, 1500]), 2048)
    assert k == 3 and len(set(got.tolist())) == 3
    assert differencing(np.array([5]), 3).tolist() == [0]


# Pipeline


def test_representatives(spark):
    """Ids that different texts share, null ids, repeated rows: one row for each component, found by brute force."""
    texts = ["alpha beta gamma delta " * 5, "one two three four five " * 6, "", "red green blue"]
    docs = [(1, texts[0], "a"), (1, texts[1], "b"), (1, texts[1], "a"), (2, texts[0], "c"), (None, texts[3], "n"), (None, texts[3], "m"), (5, None, "x"), (4, "", "y"), (4, "", "y"), (6, texts[1], None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumns({"fp": F.lit(1), "digest": F.lit(2)})
    got = sorted((r["doc_id"], r["text"], r["source"]) for r in rows_of(keep_representatives(df)) if r["doc_id"])
    assert got == sorted([(1, texts[0], "a"), (1, texts[1], "a"), (4, "", "y")])
    assert keep_representatives(df).count() == 4 and keep_representatives(df).columns == df.columns


def test_pipeline(spark, sf_dir):
    import corpus_pipeline as P

    assert [n for n, _ in P.STAGES] == ["language_id", "toxicity", "simhash_dedup", "packing"]
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    first = P.language_stage(spark, docs, sf_dir)
    assert first.columns == docs.columns and first.count() == docs.count()  # every document has letters
    second = P.toxicity_stage(spark, first, sf_dir)
    removed = {r["doc_id"] for r in docs.select("doc_id").exceptAll(second.select("doc_id")).collect()}
    toxic = {r["doc_id"] for r in rows_of_scores(spark, sf_dir) if r["predicted"]}
    assert removed == toxic and toxic
    left = [(r["doc_id"], r["text"]) for r in second.collect()]
    _, want = plain_components(left)
    third = P.dedup_stage(spark, second, sf_dir)
    assert {r["doc_id"] for r in third.collect()} == set(want.values()) and third.columns == docs.columns
    kept = {r["doc_id"] for r in third.collect()}
    check_packing(rows_of(P.run(spark, sf_dir)), [x for x in left if x[0] in kept])


def rows_of_scores(spark, sf_dir):
    return rows_of(Q.op3_toxicity(spark, sf_dir))


def test_stages_awkward(spark, sf_dir):
    import corpus_pipeline as P

    docs = awkward(spark)
    for name, stage in P.STAGES:
        assert stage(spark, empty(spark).withColumn("n_chars", F.lit(1)), sf_dir).count() == 0, name
        docs = stage(spark, docs, sf_dir)
        assert docs.count() > 0


def test_mixture_against_a_direct_search():
    """Two languages: the proportion that EM finds is the best of a fine grid, and the set is the one of least penalised cost."""
    from quirespark.llm.language import mixture

    rng = np.random.default_rng(8)
    grid = np.linspace(0, 1, 2001)
    for share in (0.0, 0.3, 0.5, 0.9, 1.0):
        n = 400
        first = rng.random(n) < share
        gap = rng.gamma(4, 2, n)
        ll = np.stack([np.where(first, 0, -gap), np.where(first, -gap, 0)], axis=1).astype(np.float32)
        got = mixture(ll, np.zeros(1, int), rounds=200)[0]
        like = np.exp(ll.astype(float))
        fit = np.array([np.log(like @ [t, 1 - t] + 1e-300).sum() for t in grid])
        cost = {1: max(fit[0], fit[-1]) - 0.5 * np.log(n + 1), 2: fit.max() - np.log(n + 1)}
        assert (got > 0).sum() == max(cost, key=cost.get)
        if cost[2] > cost[1]:
            assert abs(got[0] - grid[fit.argmax()]) < 0.02
        else:
            assert got.argmax() == (0 if fit[-1] > fit[0] else 1)


def test_mixture_depends_on_the_text_alone():
    from quirespark.llm.language import mixture

    rng = np.random.default_rng(3)
    counts = rng.integers(2, 40, 6000)
    begins = np.concatenate(([0], np.cumsum(counts)[:-1]))
    words = np.log(rng.dirichlet(np.full(4, 0.3), counts.sum()) + 1e-6).astype(np.float32) * 2
    together = mixture(words, begins)
    alone = np.concatenate([mixture(words[b : b + n], np.zeros(1, int)) for b, n in zip(begins, counts, strict=True)])
    assert ((together > 0) == (alone > 0)).all() and np.abs(together - alone).max() < 1e-5


def test_signs_at_the_ends_of_a_token_are_read_as_letters():
    import numpy as np

    from quirespark.llm.toxicity import ToxicityModel, _Scorer, char_model

    words = {w: 3.0 for w in ("nazi", "ass", "shit", "moral", "idiot")}
    scorer = _Scorer(ToxicityModel(words, char_model(np.ones((27, 27, 27)), words)))
    found = {"naz!": "nazi", "a$$": "ass", "sh!+": "shit", "shi+": "shit", "mora|": "moral", "mora!": "moral", "idio+": "idiot", "|diot": "idiot", "@ss": "ass", "(idio+)": "idiot", '"naz!",': "nazi"}
    assert {t: [w for w, _ in scorer[t]] for t in found} == {t: [w] for t, w in found.items()}
    for clean in ("wow!", "100$", "C++", "(see", "!", "$", "a+b", "(c)", "yes!!!", "$5", "so|so"):
        assert scorer[clean] == [], clean
