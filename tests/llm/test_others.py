import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirespark.llm import queries as Q
from quirespark.llm.chat import rotate_perspectives
from quirespark.llm.licences import scan_licences
from quirespark.llm.pieces import START, Vocabulary, decode_documents, encode_documents, marked, piece_digests
from quirespark.llm.neighbours import Forest, nearest_neighbours
from quirespark.llm.vectors import near_duplicate_vectors, split_into_cells, usable

from ..compare import assert_same
from .util import AWKWARD, awkward, empty, union_components

PIECES = Q.tokenizer_file("piece_bpe_32k.model")
VECTORS = "vec_id long, embedding array<float>, label int"


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# 2 Near-duplicate vectors


def plain_links(rows, least=0.93):
    links, count = [], defaultdict(int)
    ok = [(k, np.array(v, dtype=float), lab) for k, (i, v, lab) in enumerate(rows) if i is not None and v and lab is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    for a in range(len(ok)):
        for b in range(a + 1, len(ok)):
            if ok[a][2] == ok[b][2] and len(ok[a][1]) == len(ok[b][1]):
                if ok[a][1] @ ok[b][1] / np.linalg.norm(ok[a][1]) / np.linalg.norm(ok[b][1]) >= least:
                    links.append((rows[ok[a][0]][0], rows[ok[b][0]][0]))
                    count[ok[a][0]] += 1
                    count[ok[b][0]] += 1
    return links, count


def balls(seed=0):
    """Random vectors, balls of near copies of several sizes, a crowd of one vector, and awkward rows."""
    rng = np.random.default_rng(seed)
    rows = []
    for label in range(3):
        centres = rng.normal(size=(30, 16))
        for k, c in enumerate(centres):
            rows += [(0, (c + rng.normal(size=16) * 0.08 * np.linalg.norm(c) / 4).tolist(), label) for _ in range(1 + 3 * k // 4)]
        rows += [(0, centres[0].tolist(), label)] * 20
    rows = [(i, np.array(v, dtype=np.float32).tolist(), lab) for i, (_, v, lab) in enumerate(rows)]
    n = len(rows)
    return rows + [(n, None, 0), (n + 1, [0.0] * 16, 0), (n + 2, [float("nan")] * 16, 0), (n + 3, rows[0][1], None), (n + 4, [None, *rows[0][1][1:]], 0), (n + 5, [float("inf")] * 16, 1), (None, rows[0][1], 0), (n + 6, [1.0, 2.0], 0)]


@pytest.mark.parametrize("cell", [6000, 60, 25])
def test_near_duplicate_vectors(spark, cell):
    rows = balls()
    df = spark.createDataFrame(rows, VECTORS).withColumns({"node": F.lit(1), "v": F.lit(2), "grp": F.lit(3)})
    got = {r["vec_id"]: r for r in rows_of(near_duplicate_vectors(df, per_shard=40, cell=cell))}
    links, count = plain_links(rows)
    assert len(got) == len(rows)
    found, total = sum(r["n_links"] for r in got.values()), 2 * len(links)
    assert 0.97 * total <= found <= total
    want = {rows[k][0]: n for k, n in count.items()}
    assert all(r["n_links"] <= want.get(i, 0) for i, r in got.items())
    comp = union_components([r[0] for r in rows if r[0] is not None], links)
    assert sum(got[i]["component_id"] == c for i, c in comp.items()) >= 0.97 * len(comp)
    assert all(r["kept"] == (i is None or r["component_id"] == i) for i, r in got.items())
    audited = {r["audited_recall"] for r in got.values()}
    assert len(audited) == 1 and 0.97 <= min(audited) <= 1
    assert near_duplicate_vectors(spark.createDataFrame([], VECTORS)).count() == 0


def test_vectors_of_other_lengths_link(spark):
    """Under one label, vectors of its less frequent lengths are searched among their own length."""
    rows = [(i, [float(i), 1.0, -2.0], 0) for i in range(9)] + [(20, [1.0, 0.01], 0), (21, [1.0, 0.02], 0), (22, [0.0, 1.0], 0), (23, [2.0, 0.02], 1), (24, [1e300, 1e298], 0), (25, [1e-300, 1e-302], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    links, count = plain_links([(i, [x / max(map(abs, v)) for x in v], lab) for i, v, lab in rows])
    got = {r["vec_id"]: r for r in rows_of(near_duplicate_vectors(df))}
    assert {i: got[i]["n_links"] for i, _, _ in rows} == {r[0]: count[k] for k, r in enumerate(rows)}
    assert got[21]["component_id"] == got[24]["component_id"] == 20 and got[23]["n_links"] == 0
    near = defaultdict(list)
    for r in rows_of(nearest_neighbours(df, df, k=2)):
        near[r["query_id"]].append(r["vec_id"])
    assert set(near[22]) == {20, 21, 23, 24, 25} & set(near[22]) and len(near[22]) == 2 and set(near[3]) == {2, 4}


def test_dense_ball_is_whole(spark):
    """Vectors so near to each other that no split separates them: all pairs still count."""
    rng = np.random.default_rng(5)
    rows = [(i, (np.eye(8)[0] + rng.normal(size=8) * 0.01).tolist(), 0) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = rows_of(near_duplicate_vectors(df, cell=40))
    assert all(r["n_links"] == 149 and r["component_id"] == 0 and r["audited_recall"] == 1 for r in got)


def test_cells_are_bounded_and_whole(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(30, 16))[rng.integers(0, 30, 3000)] + rng.normal(size=(3000, 16)) * 0.2
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, 1, v.tolist(), "g") for i, v in enumerate(u)], "node long, weight long, u array<double>, grp string")
    got = rows_of(split_into_cells(df, cell=200, margin=0.02, fan=4, sample=500, task=300).groupBy("cell").agg(F.count("*").alias("n"), F.collect_set("node").alias("nodes")))
    assert max(r["n"] for r in got) <= 200 and len(got) > 15 and not any(r["cell"].endswith("!") for r in got)
    assert set().union(*(r["nodes"] for r in got)) == set(range(3000))


def test_vector_recall_on_table(spark):
    import pyarrow.dataset as ds

    sf = "/root/testdata/sf0.1"
    t = ds.dataset(f"{sf}/embeddings.parquet").to_table()
    ids, labels = t["vec_id"].to_numpy(), t["label"].to_numpy()
    x = np.array(t["embedding"].to_pylist(), dtype=float)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.93) & (labels[:, None] == labels) & ~np.eye(len(u), dtype=bool)
    got = {r["vec_id"]: r["n_links"] for r in rows_of(Q.op2_embedding_dedup(spark, sf))}
    found = sum(got.values())
    assert found <= hit.sum() and found >= 0.97 * hit.sum()
    near = defaultdict(list)
    for r in rows_of(Q.op7_nearest(spark, sf)):
        near[r["query_id"]].append(r)
    right = 0
    for k in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[k]) ** 2).sum(axis=1))
        d[k] = np.inf
        best = set(ids[np.lexsort((ids, d))[:10]].tolist())
        mine = sorted(near[ids[k]], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 11))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted((r["score"], r["vec_id"]) for r in mine)
        place = {i: j for j, i in enumerate(ids.tolist())}
        assert all(r["score"] == pytest.approx(d[place[r["vec_id"]]], abs=1e-12) for r in mine)
        right += len(best & {r["vec_id"] for r in mine})
    assert right / (10 * (ids % 100 == 0).sum()) >= 0.93


# 7 Nearest neighbours


def test_nearest_awkward(spark):
    rows = balls(1)
    df = spark.createDataFrame(rows, VECTORS)
    got = defaultdict(list)
    for r in rows_of(nearest_neighbours(df, df.where("vec_id % 25 = 0"), k=5, leaf=20, task=50)):
        got[r["query_id"]].append((r["rank"], r["score"], r["vec_id"]))
    good = {i: np.array(v) for i, v, _ in rows if i is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    hits = total = 0
    for q in (i for i in good if i % 25 == 0):
        best = sorted((float(np.sqrt(((good[q] - v) ** 2).sum())), i) for i, v in good.items() if i != q)[:5]
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5]
        assert [x[1:] for x in mine] == sorted(x[1:] for x in mine)
        assert all(s == pytest.approx(float(np.sqrt(((good[q] - good[i]) ** 2).sum())), abs=1e-12) for _, s, i in mine)
        hits += sum(any(abs(s - b) < 1e-6 for b, _ in best) for _, s, _ in mine)
        total += 5
    assert hits / total > 0.9 and set(got) == {i for i in good if i % 25 == 0}
    few = df.where("vec_id < 3")
    assert nearest_neighbours(few, few, k=10).count() == 6
    none = spark.createDataFrame([], VECTORS)
    assert nearest_neighbours(none, none).count() == 0


def test_nearest_prunes_clustered_vectors(spark):
    """In clustered vectors a query scans less than a fifth of the table for a recall over 0.9, all trees counted."""
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(200, 32)) * 3
    x = (centres[rng.integers(0, 200, 12_000)] + rng.normal(size=(12_000, 32)) * 0.6).astype(np.float32).astype(float)
    planted = Forest(x, 4, 6)
    number = planted.calibrate(x, 10, 0.94)
    at = planted.leaves(x)
    sizes = [np.bincount(at[:, t], minlength=64) for t in range(4)]
    scanned = [sum(sizes[t][j] for t, j in zip_first(planted.order(q), number)) for q in x[:50]]
    assert np.mean(scanned) / len(x) < 0.2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = defaultdict(set)
    for r in rows_of(nearest_neighbours(df, df.where("vec_id % 100 = 0"))):
        got[r["query_id"]].add(r["vec_id"])
    right = 0
    for q in range(0, len(x), 100):
        d = ((x - x[q]) ** 2).sum(axis=1)
        d[q] = np.inf
        right += len(got[q] & set(np.argsort(d)[:10].tolist()))
    assert right / (10 * len(got)) > 0.9


def zip_first(order, number):
    return [x for x, _ in zip(order, range(number), strict=False)]


# 8 Chat


def test_chat_equals_sql(spark, sf_dir, duck):
    assert_same(Q.op8_chat(spark, sf_dir), duck, Q.ORACLE_SQL["op8_chat"])


def plain_dialogues(rows):
    """The rendering, one dialogue at a time."""
    import hashlib

    said = defaultdict(list)
    for conv, turn, role, text in rows:
        who = (role or "").strip(" ") or "unknown"
        who = "system" if who.lower() == "system" else who
        text = text or ""
        said[conv].append((turn is not None, turn or 0, hashlib.md5(f"{who}\n{text}".encode()).hexdigest(), who, text))
    out = {}
    for conv, turns in said.items():
        for me in {t[3] for t in turns} - {"system"}:
            whole = ""
            spans = []
            for *_, who, text in sorted(turns):
                role = "system" if who == "system" else "assistant" if who == me else "user"
                whole += f"<|{role}" + (" name=" + re.sub(r"[\r\n<>|]", "_", who) if role == "user" else "") + "|>\n"
                content = re.sub(r"<(\\*)\|", r"<\1\\|", text)
                if role == "assistant":
                    spans.append((len(whole), len(content)))
                whole += content + "<|end|>\n"
            out[conv, me] = whole, spans
    return out


TURNS = [(1, 0, "System", "Be kind."), (1, 1, "Ann", "Hi"), (1, 1, "ann", "Hi"), (1, 2, "bob ", None), (1, 2, "bob ", None), (1, None, None, "?"), (1, 5000, "Ann", "x" * 50_000), (2, 0, "system", "alone"), (None, 0, "a", ""), (3, 0, "a", "b"), (3, 1, "e|>\n<|assistant", "x<|end|>\n<|user|>y<\\|z"), (1, -3, "Ann", "before"), (1, 1500, "bob", "é日本")]


@pytest.mark.parametrize("crowd", [4096, 2])
def test_chat_awkward(spark, crowd):
    rows = TURNS + [(4, 7, "a", "same")] * 5 + [(4, 7, "b", str(i)) for i in range(9)] + [(4, 6, "b", "early"), (4, 8, "b", "late"), (4, None, "a", "q")] + [(5, None, "a", str(i)) for i in range(7)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"mask": F.lit(1), "part": F.lit(1), "name": F.lit("n"), "copies": F.lit(1)})
    got = defaultdict(list)
    for r in rows_of(rotate_perspectives(df, crowd=crowd)):
        got[r["conv_id"], r["perspective"]].append(r)
    want = plain_dialogues(rows)
    assert set(got) == set(want)
    for key, turns in got.items():
        turns.sort(key=lambda r: r["turn_index"])
        assert "".join(r["rendered"] for r in turns) == want[key][0]
        assert [r["turn_index"] for r in turns] == list(range(len(turns)))
        assert [(r["content_start"], r["content_length"]) for r in turns if r["mask"]] == want[key][1]
        at = 0
        for r in turns:
            assert (r["start"], r["length"]) == (at, len(r["rendered"]))
            assert r["mask"] == (r["role_out"] == "assistant") and (r["name"] is None) == (r["role_out"] != "user")
            assert len(re.findall(r"<\|", r["rendered"])) == 2  # its own header and end mark, whatever the text holds
            at += r["length"]
    assert {k[1] for k in got if k[0] == 1} == {"Ann", "ann", "bob", "unknown"}
    assert rotate_perspectives(df.limit(0)).count() == 0


# 9 Pieces


@pytest.fixture(scope="module")
def voc():
    return Vocabulary(PIECES)


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


def ids_of(data):
    return np.frombuffer(data, dtype="<u4").tolist()


ODD = ["", " ", "a  b", "日本語 text ☃ 😀", "aaaaaaa", "x=1; y = 22\tz\n\nnew", "ß ü é", "\n", "  lead", "<s> <unk> <0x41>", " " * 100, "a" * 1000, "\x00x", "▁x ▁", "https://www.example.com/index.html?q=1&r=2"]


def test_pieces_equal_library(voc, library, spark, sf_dir):
    """Whole texts of the table, odd texts and random strings: the library's own ids, and back again."""
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + ODD
    rng = np.random.default_rng(4)
    texts += ["".join(rng.choice(list(x), 60)) for x in ("theaionrsl ", "aab ", "日本語xa", "ab\n\t ", "=-_.") for _ in range(100)]
    for t in texts:
        got = ids_of(voc.encode(t))
        assert got == library.encode(t), t[:80]
        assert voc.decode(got)[1:] == t.replace("▁", " ")


def test_operator_equals_library(voc, library, spark):
    """The whole operator, giant texts among the others, with small chunks and a tree of several levels."""
    rng = np.random.default_rng(0)
    texts = ["".join(rng.choice(list("the aeionrsm"), 700)), "".join(rng.choice(list("aeinotth"), 500)), "a" * 300, "日本" * 90 + "x" * 100, "word and " * 60, "ab" * 3000, *ODD]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, texts[0])], "doc_id long, text string")
    for chunk, fan in ((97, 64), (33, 2), (40, 5)):
        got = defaultdict(list)
        for r in encode_documents(df, PIECES, chunk=chunk, fan=fan).collect():
            got[r["doc_id"]].append((r["chunk"], list(r["ids"])))
        for i, t in [*enumerate(texts), (99, texts[0])]:
            parts = [x for _, x in sorted(got[i])]
            assert len(parts) == (1 if len(t) <= chunk else -(-(len(t) + 1) // chunk))
            assert sum(parts, []) == library.encode(t), t[:80]
    back_again = {r["doc_id"]: r["text"] for r in decode_documents(encode_documents(df, PIECES, chunk=97), PIECES).collect()}
    assert back_again == {i: t.replace("▁", " ") for i, t in [*enumerate(texts), (99, texts[0])]}
    with pytest.raises(ValueError):
        encode_documents(df, PIECES, chunk=20)


def test_path_weighs_nothing(voc):
    """Of all ways to cut a short word into pieces, exactly one has only neighbours of weight 0: the one of merging."""
    def ways(text):
        return [[]] if not text else [[text[:k], *w] for k in range(1, len(text) + 1) if text[:k] in voc.rank for w in ways(text[k:])]

    for text in ("▁hello", "▁nation", "▁▁ab", "ationa", "▁there"):
        good = [w for w in ways(text) if all(voc.pair[x] for x in zip(["", *w], w, strict=False))]
        assert good == [voc.merge(text)] == [voc.path(text)]


def test_max_plus_is_associative(voc):
    """Products in any grouping, also with chunks that a hard cut divides, equal the chunks' transfer as one."""
    rng = np.random.default_rng(1)
    for letters in ("aeinotth", "aeino tth", "ab"):
        text = marked("".join(rng.choice(list(letters), 400)))
        for c in (33, 50):
            part = [voc.transfer(text[max(0, at - voc.halo) : at + c], min(at, voc.halo)) for at in range(0, 6 * c, c)]
            left = ((part[0] @ part[1]) @ part[2]) @ part[3]
            assert left == part[0] @ (part[1] @ (part[2] @ part[3])) == (part[0] @ part[1]) @ (part[2] @ part[3])
            start = frozenset({START})
            assert left.ahead(start) == part[3].ahead(part[2].ahead(part[1].ahead(part[0].ahead(start))))
            assert left.ahead(start) == voc.transfer(text[: 4 * c], 0).ahead(start)


def test_pieces_awkward(spark, voc):
    rows = encode_documents(awkward(spark), PIECES).collect()
    assert {r["doc_id"] for r in rows} == {x[0] for x in AWKWARD}
    got = rows_of(encode_documents(awkward(spark), PIECES, digests=True))
    again = rows_of(piece_digests(encode_documents(awkward(spark), PIECES), PIECES))
    assert sorted(map(str, got)) == sorted(map(str, again))
    by = defaultdict(int)
    for r in got:
        by[r["doc_id"]] += r["decoded_bytes"]
    assert by[8] == 150_000 and by[9] == 70_000 and by[3] == by[4] == 0 and by[5] == 4
    assert all(r["decoded_crc32"] == zlib.crc32(b"12345 !!! 678") for r in got if r["doc_id"] == 6)
    assert encode_documents(empty(spark), PIECES).count() == 0


# 10 Licences


def test_licences_equal_sql(spark, sf_dir, duck):
    assert_same(Q.op10_licences(spark, sf_dir), duck, Q.ORACLE_SQL["op10_licences"])


def test_licence_forms_equal_sql(spark, duck):
    """Headers and whole texts, quoted, in comments, wrapped and among other words: the SQL finds the same."""
    import duckdb

    forms = []
    for t in [*HEADERS.values(), *WHOLE.values()]:
        forms += [t, "Some words first. " + t.replace("\n", " "), "\n".join("> " + x for x in t.split("\n")), "// " + t.replace("\n", "\r\n// "), t.upper(), "a b c " + t + " d e f", t + "\n\n" + HEADERS["MIT"]]
    forms += [None, "", "e.g. version 2.0. All rights reserved.Licensed under the MIT License!", "neither the name of a b c d e f g h i j k l m nor the names of its contributors may be used"]
    docs = [(i, t) for i, t in enumerate(forms)]
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar)")
    con.executemany("insert into documents values (?, ?)", docs)
    got = scan_licences(spark.createDataFrame(docs, "doc_id long, text string"))
    assert_same(got, con, Q.ORACLE_SQL["op10_licences"])


def test_licences_rules(spark):
    apache = "Licensed under the Apache License, Version 2.0 (the \"License\").\nYou may not use this file except in compliance with the License.\nNoise here. You may obtain a copy of the License at\nhttp://x"
    cases = {
        "Released under the MIT License.": "MIT",
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "a b c\nLICENSED UNDER CC BY-NC 4.0!\nmore": "CC-BY-NC-4.0",
        "This work is licensed under the GNU General Public License, version 3.\nReleased under the MIT License.": "MIT GPL-3.0",
        "We talk about the MIT License and permission.": "",
        "All rights reserved. All rights reserved.": "Proprietary",
        apache: "Apache-2.0-header",
    }
    df = spark.createDataFrame([*cases.items(), (None, ""), ("", "")], "text string, want string").withColumn("doc_id", F.col("want")).withColumn("left", F.lit(1))
    assert all(r["licences"] == r["doc_id"] for r in scan_licences(df).collect())
    assert scan_licences(empty(spark)).count() == 0 and scan_licences(awkward(spark)).count() == len(AWKWARD)


def test_licence_relations(spark):
    """Sentences and rules come as tables; rules go by place, not by order of rows."""
    sentences = spark.createDataFrame([("Own", "May be used by * only"), ("Fee", "for a fee"), (None, "x"), ("Nil", " ")], "id string, sentence string")
    rules = spark.createDataFrame([(2, "Any", ["Own"]), (1, "Paid", ["Own", "Fee"]), (0, "Void", [])], "place int, rule string, ids array<string>")
    texts = ["May be used by\nour good members only, for a fee.", "may be used by us only", "may be used by only", "For a fee! May be used by us only"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r["doc_id"]: (r["sentence_ids"], r["licences"]) for r in scan_licences(df, sentences, rules).collect()}
    assert got == {0: ("Own Fee", "Paid"), 1: ("Own", "Any"), 2: ("", ""), 3: ("Fee Own", "Any")}
    assert all(r["licences"] == "" for r in scan_licences(df, sentences.limit(0), rules.limit(0)).collect())
    many = spark.range(20_001).select(F.concat(F.lit("i"), "id").alias("id"), F.concat(F.lit("word "), "id").alias("sentence"))
    with pytest.raises(ValueError):
        scan_licences(df, many)


def test_licence_gaps_of_any_length(spark):
    """A head takes the nearest tail behind it in its sentence, however far; gaps of no word are none."""
    sentences = spark.createDataFrame([("One", "open it * close it"), ("Two", "start * middle part * end"), ("In", "close it"), ("Tie", "open it again")], "id string, sentence string")
    far = " ".join(["word"] * 3000)
    texts = {
        f"Open it {far} close it": "One", "open it close it": "In", "open it close it x close it": "One", "open it. x close it": "In", "start a middle part b end": "Two",
        "start middle part b end": "", "start a middle part b": "", f"start {far} middle part {far} end or start x": "Two", "open it a close it b close it": "One In", "open it open it a close it": "One",
        "open it again b close it": "One", "open it again": "Tie",
    }
    df = spark.createDataFrame([(None, t, i) for t, i in texts.items()] * 2, "doc_id long, text string, want string")
    got = scan_licences(df.withColumn("doc_id", F.md5("text")), sentences, spark.createDataFrame([], "place int, rule string, ids array<string>"))
    want = {hashlib.md5(t.encode()).hexdigest(): i for t, i in texts.items()}
    rows = got.collect()
    assert len(rows) == 2 * len(texts) and {r["doc_id"]: r["sentence_ids"] for r in rows} == want


def test_common_licences(spark):
    holder = "the author and the many organisations and persons that have given parts of it over the years, listed in the file beside this one,"
    cases = {
        "// SPDX-License-Identifier: MIT": "MIT", "# SPDX-License-Identifier: GPL-2.0-or-later": "GPL-2.0-or-later", "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
        "SPDX-License-Identifier: BSL-1.0": "BSL-1.0", "Code is under the MIT licence.": "MIT", "Code is available under Mozilla Public License 2.0.": "MPL-2.0",
        "Text is licensed under CC BY 3.0.": "CC-BY-3.0", "This file is under the ISC license": "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies.": "ISC-full",
        "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published": "AGPL-3.0",
        "Distributed under the Boost Software License, Version 1.0. (See accompanying file)": "BSL-1.0", "CC0 1.0 Universal": "CC0-1.0",
        "This is free and unencumbered software released into the public domain.": "Unlicense",
        f"Redistribution and use in source and binary forms, with or without modification, are permitted. Neither the name of {holder} nor the names of its contributors may be used": "BSD-3-Clause",
        "the spdx format has a licence identifier; MIT is a school": "", "All rights reserved": "Proprietary",
    }
    df = spark.createDataFrame([(want, t) for t, want in cases.items()], "doc_id string, text string")
    assert [r for r in scan_licences(df).collect() if r["licences"] != r["doc_id"]] == []


def test_licence_scan_is_lookups(spark):
    """Sentences are joined by key from a broadcast table; no text is shuffled."""
    plan = scan_licences(spark.range(1).selectExpr("id doc_id", "'x' text"))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [key" in plan and "Python" not in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


HEADERS = {
    "Apache-2.0-header": """# Licensed under the Apache License, Version 2.0 (the "License");
# you may not use this file except in compliance with the License.
# You may obtain a copy of the License at
#
#     http://www.apache.org/licenses/LICENSE-2.0""",
    "MIT-full": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.""",
    "GPL-3.0-or-later": """ * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU General Public License as published by
 * the Free Software Foundation, either version 3 of the License, or
 * (at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; version 2.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:""",
    "CC-BY-4.0": "This work is licensed under a Creative Commons\nAttribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "MIT": "Released under the\nMIT License.",
}


def test_licences_standard_texts(spark):
    df = spark.createDataFrame([(k, v) for k, v in HEADERS.items()], "doc_id string, text string")
    got = {r["doc_id"]: r["licences"] for r in scan_licences(df).collect()}
    assert got == {k: k for k in HEADERS}
    crlf = df.withColumn("text", F.replace("text", F.lit("\n"), F.lit("\r\n")))
    assert all(r["licences"] == r["doc_id"] for r in scan_licences(crlf).collect())


# Whole texts as they stand in repositories (long middle parts of the Apache and GNU licences left out between paragraphs).
WHOLE = {
    "MIT-full": """MIT License

Copyright (c) 2024 Some Author

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
""",
    "BSD-3-Clause": """Copyright (c) 2024, Some Author

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

3. Neither the name of the University of Somewhere nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED.
""",
    "Apache-2.0-text": """                                 Apache License
                           Version 2.0, January 2004
                        http://www.apache.org/licenses/

   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION

   2. Grant of Copyright License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      copyright license to reproduce, prepare Derivative Works of,
      publicly display, publicly perform, sublicense, and distribute the
      Work and such Derivative Works in Source or Object form.

   3. Grant of Patent License. Subject to the terms and conditions of
      this License, each Contributor hereby grants to You a perpetual,
      worldwide, non-exclusive, no-charge, royalty-free, irrevocable
      (except as stated in this section) patent license to make, have made,
      use, offer to sell, sell, import, and otherwise transfer the Work.

      (a) You must give any other recipients of the Work or
          Derivative Works a copy of this License; and
""",
    "GPL-3.0-text": """                    GNU GENERAL PUBLIC LICENSE
                       Version 3, 29 June 2007

 Copyright (C) 2007 Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The GNU General Public License is a free, copyleft license for
software and other kinds of works.
""",
    "GPL-2.0-text": """                    GNU GENERAL PUBLIC LICENSE
                       Version 2, June 1991

 Copyright (C) 1989, 1991 Free Software Foundation, Inc.,
 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The licenses for most software are designed to take away your
freedom to share and change it.
""",
}


def test_licences_whole_texts(spark):
    df = spark.createDataFrame([(k, v) for k, v in WHOLE.items()], "doc_id string, text string")
    got = {r["doc_id"]: r for r in scan_licences(df).collect()}
    assert {k: r["licences"] for k, r in got.items()} == {k: k for k in WHOLE}
    assert got["MIT-full"]["sentence_ids"] == "MitGrant MitNotice AsIs NoClaim"
    assert got["BSD-3-Clause"]["sentence_ids"] == "BsdGrant BsdSource BsdBinary BsdNoName"
    assert got["Apache-2.0-text"]["n_sentences"] == 3
