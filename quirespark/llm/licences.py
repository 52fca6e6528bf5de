"""Licence recognition by sentences and ordered rules, in DataFrame functions only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Sentences of licences, their headers and references, and the identifier of each. * stands for one word or more.
SENTENCES = (
    ("ApacheRef", "Licensed under the Apache License, Version 2.0"),
    ("ApacheRef", "Released under the Apache License, Version 2.0"),
    ("ApacheUse", "you may not use this file except in compliance with the License"),
    ("ApacheUse", "you may not use this work except in compliance with the License"),
    ("ApacheUse", "you may not use this software except in compliance with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at"),
    ("ApacheBasis", 'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("ApacheCopyright", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of"),
    ("ApachePatent", "each Contributor hereby grants to You a perpetual, worldwide, non-exclusive, no-charge, royalty-free, irrevocable (except as stated in this section) patent license"),
    ("ApacheNotices", "You must give any other recipients of the Work or Derivative Works a copy of this License"),
    ("MitRef", "Released under the MIT License"),
    ("MitRef", "Licensed under the MIT License"),
    ("MitGrant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MitNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("AsIs", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND'),
    ("NoClaim", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"),
    ("BsdGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BsdSource", "Redistributions of source code must retain the above copyright notice"),
    ("BsdBinary", "Redistributions in binary form must reproduce the above copyright notice"),
    ("BsdNoName", "Neither the name of * nor the names of its contributors may be used"),
    ("BsdNoName", "Neither the name of * nor the names of their contributors may be used"),
    ("BsdNoName", "Neither the names of * nor the names of their contributors may be used"),
    ("BsdAdvertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("Gpl3Ref", "licensed under the GNU General Public License, version 3"),
    ("Gpl3Ref", "licensed under the GNU General Public License v3"),
    ("Gpl2Ref", "licensed under the GNU General Public License, version 2"),
    ("Gpl2Ref", "licensed under the GNU General Public License v2"),
    *(
        (i, f"This {what} is free software: you can redistribute it and/or modify it under the terms of {terms}")
        for what in ("program", "file", "software", "library")
        for i, terms in (
            ("GplGrant", "the GNU General Public License as published by the Free Software Foundation"),
            ("Gpl3Ref", "the GNU General Public License as published by the Free Software Foundation, version 3"),
            ("Gpl3Ref", "version 3 of the GNU General Public License"),
            ("Gpl2Ref", "the GNU General Public License as published by the Free Software Foundation, version 2"),
            ("Gpl2Ref", "version 2 of the GNU General Public License"),
        )
    ),
    ("Gpl3Later", "either version 3 of the License, or (at your option) any later version"),
    ("Gpl2Later", "either version 2 of the License, or (at your option) any later version"),
    ("Gpl3Title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("Gpl2Title", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GnuVerbatim", "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed"),
    ("Gpl3Preamble", "The GNU General Public License is a free, copyleft license for software and other kinds of works"),
    ("Gpl2Preamble", "The licenses for most software are designed to take away your freedom to share and change it"),
    ("LgplTitle", "GNU LESSER GENERAL PUBLIC LICENSE"),
    ("MplRef", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CcByNcRef", "licensed under CC BY-NC 4.0"),
    ("CcBySaRef", "licensed under CC BY-SA 4.0"),
    ("CcByRef", "licensed under CC BY 4.0"),
    *(
        (i, f"licensed under {a} Creative Commons {name} 4.0 International{public} License")
        for a in ("a", "the")
        for public in ("", " Public")
        for i, name in (
            ("CcByNcRef", "Attribution-NonCommercial"),
            ("CcBySaRef", "Attribution-ShareAlike"),
            ("CcByRef", "Attribution"),
        )
    ),
    *(
        (i, f"{said} {name}")
        for i, names in (
            ("MitRef", ("the MIT license", "the MIT licence", "MIT license", "the terms of the MIT license")),
            ("ApacheRef", ("the Apache License 2.0", "Apache License 2.0", "the terms of the Apache License, Version 2.0")),
            ("IscRef", ("the ISC license", "ISC license")),
            ("BoostRef", ("the Boost Software License, Version 1.0",)),
            ("Agpl3Ref", ("the GNU Affero General Public License, version 3", "the GNU Affero General Public License v3")),
            ("Mpl2Ref", ("the Mozilla Public License 2.0", "the Mozilla Public License, version 2.0", "Mozilla Public License 2.0")),
            ("Epl2Ref", ("the Eclipse Public License 2.0", "the Eclipse Public License, Version 2.0", "the terms of the Eclipse Public License 2.0")),
            ("Cc0Ref", ("CC0 1.0", "the CC0 1.0 Universal", "CC0 1.0 Universal")),
            ("CcBy3Ref", ("CC BY 3.0", "a Creative Commons Attribution 3.0 Unported License", "the Creative Commons Attribution 3.0 Unported License")),
            ("CcBySa3Ref", ("CC BY-SA 3.0", "a Creative Commons Attribution-ShareAlike 3.0 Unported License")),
            ("Bsd2Ref", ("the BSD 2-Clause License", "the Simplified BSD License")),
            ("Bsd3Ref", ("the BSD 3-Clause License", "the New BSD License")),
        )
        for name in names
        for said in ("is under", "licensed under", "released under", "distributed under", "available under")
    ),
    *(
        (i, f"SPDX-License-Identifier: {name}")
        for i, names in (
            ("ApacheRef", ("Apache-2.0",)), ("MitRef", ("MIT",)), ("IscRef", ("ISC",)), ("Bsd2Ref", ("BSD-2-Clause",)), ("Bsd3Ref", ("BSD-3-Clause",)),
            ("BoostRef", ("BSL-1.0",)), ("Mpl2Ref", ("MPL-2.0",)), ("Epl2Ref", ("EPL-2.0",)), ("Cc0Ref", ("CC0-1.0",)), ("UnlicenseRef", ("Unlicense",)), ("ZlibRef", ("Zlib",)),
            ("Gpl2Ref", ("GPL-2.0", "GPL-2.0-only")), ("Gpl2OrLater", ("GPL-2.0-or-later",)), ("Gpl3Ref", ("GPL-3.0", "GPL-3.0-only")), ("Gpl3OrLater", ("GPL-3.0-or-later",)),
            ("Agpl3Ref", ("AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later")), ("LgplTitle", ("LGPL-2.1", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later")),
            ("CcByRef", ("CC-BY-4.0",)), ("CcBySaRef", ("CC-BY-SA-4.0",)), ("CcByNcRef", ("CC-BY-NC-4.0",)), ("CcBy3Ref", ("CC-BY-3.0",)), ("CcBySa3Ref", ("CC-BY-SA-3.0",)),
        )
        for name in names
    ),
    ("IscGrant", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("IscGrant", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("IscNotice", "provided that the above copyright notice and this permission notice appear in all copies"),
    ("BoostGrant", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("BoostTitle", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("BoostSee", "Distributed under the Boost Software License, Version 1.0"),
    *(("Agpl3Grant", f"{what} is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License") for what in ("This program", "This software")),
    ("Agpl3Title", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("Cc0Title", "CC0 1.0 Universal"),
    ("Cc0Waiver", "has waived all copyright and related or neighboring rights to"),
    ("Mpl2Title", "Mozilla Public License Version 2.0"),
    ("Epl2Title", "Eclipse Public License - v 2.0"),
    ("UnlicenseRef", "This is free and unencumbered software released into the public domain"),
    ("ZlibGrant", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    ("ZlibOrigin", "The origin of this software must not be misrepresented"),
    ("WtfplTitle", "DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE"),
    ("AllRights", "All rights reserved"),
)

# Ordered rules. Each is a sequence of identifiers that must stand in this order, with any others between;
# the identifiers a rule matches are used up, so a later, looser rule does not report the same sentences.
RULES = (
    ("Apache-2.0-text", ("ApacheCopyright", "ApachePatent")),
    ("Apache-2.0-header", ("ApacheRef", "ApacheUse", "ApacheCopy")),
    ("Apache-2.0", ("ApacheRef",)),
    ("MIT-full", ("MitGrant", "AsIs")),
    ("MIT", ("MitRef",)),
    ("GPL-3.0-text", ("Gpl3Title", "Gpl3Preamble")),
    ("GPL-2.0-text", ("Gpl2Title", "Gpl2Preamble")),
    ("GPL-3.0-or-later", ("GplGrant", "Gpl3Later")),
    ("GPL-2.0-or-later", ("GplGrant", "Gpl2Later")),
    ("GPL-3.0", ("Gpl3Ref",)),
    ("GPL-2.0", ("Gpl2Ref",)),
    ("LGPL", ("LgplTitle",)),
    ("GPL-3.0-or-later", ("Gpl3OrLater",)),
    ("GPL-2.0-or-later", ("Gpl2OrLater",)),
    ("AGPL-3.0", ("Agpl3Title",)),
    ("AGPL-3.0", ("Agpl3Grant",)),
    ("AGPL-3.0", ("Agpl3Ref",)),
    ("MPL-2.0", ("MplRef",)),
    ("MPL-2.0", ("Mpl2Title",)),
    ("MPL-2.0", ("Mpl2Ref",)),
    ("EPL-2.0", ("Epl2Title",)),
    ("EPL-2.0", ("Epl2Ref",)),
    ("ISC-full", ("IscGrant", "IscNotice")),
    ("ISC", ("IscRef",)),
    ("BSL-1.0-full", ("BoostTitle", "BoostGrant")),
    ("BSL-1.0", ("BoostSee",)),
    ("BSL-1.0", ("BoostRef",)),
    ("CC0-1.0", ("Cc0Title",)),
    ("CC0-1.0", ("Cc0Waiver",)),
    ("CC0-1.0", ("Cc0Ref",)),
    ("Unlicense", ("UnlicenseRef",)),
    ("Zlib-full", ("ZlibGrant", "ZlibOrigin")),
    ("Zlib", ("ZlibRef",)),
    ("WTFPL", ("WtfplTitle",)),
    ("CC-BY-3.0", ("CcBy3Ref",)),
    ("CC-BY-SA-3.0", ("CcBySa3Ref",)),
    ("BSD-2-Clause", ("Bsd2Ref",)),
    ("BSD-3-Clause", ("Bsd3Ref",)),
    ("CC-BY-NC-4.0", ("CcByNcRef",)),
    ("CC-BY-SA-4.0", ("CcBySaRef",)),
    ("CC-BY-4.0", ("CcByRef",)),
    ("BSD-4-Clause", ("BsdGrant", "BsdAdvertising", "BsdNoName")),
    ("BSD-3-Clause", ("BsdGrant", "BsdNoName")),
    ("BSD-2-Clause", ("BsdGrant",)),
    ("Proprietary", ("AllRights",)),
)

MOST_SENTENCES, MOST_RULES = 20_000, 5_000  # what the relations may hold: they become part of the plan


def default_sentences(spark: SparkSession) -> DataFrame:
    """(id, sentence): the sentences known without further input."""
    return spark.createDataFrame(SENTENCES, "id string, sentence string")


def default_rules(spark: SparkSession) -> DataFrame:
    """(place, rule, ids): the rules known without further input; they are tried by place."""
    return spark.createDataFrame([(n, r, list(ids)) for n, (r, ids) in enumerate(RULES)], "place int, rule string, ids array<string>")


def normal(sentence: str) -> str:
    """A sentence as it is compared: lower case, its words of a-z and 0-9 with single blanks; * stays."""
    lowered = re.sub(r"(^|[^a-z0-9])([a-z])\.", r"\1\2 ", sentence.lower())
    return re.sub(r"[^a-z0-9*]+", " ", lowered).strip()


def _bounded(df: DataFrame, most: int) -> list:
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most:,} sentences or rules")
    return rows


def _anchors(sentences: list[str]) -> list[str]:
    """Few words of which every sentence holds one at least: a text without any needs no closer look."""
    left, out = set(sentences), []
    while left:
        words = sorted({w for s in left for w in s.split() if w != "*"})
        out.append(max(words, key=lambda w: (sum(len(w) > 5 and w in s.split() for s in left), len(w), w)))
        left = {s for s in left if out[-1] not in s.split()}
    return out


def normal_words(text: Column) -> Column:
    """The text as lower-case words with one blank between, and "|" where a sentence ends: at . ! ? before white space, and
    at a line without words. A stop behind a single letter ends nothing."""
    swap = F.regexp_replace
    words = swap(swap(F.lower(text), r"\r\n?", "\n"), r"(^|[^a-z0-9])([a-z])\.", "$1$2 ")
    words = swap(swap(F.translate(words, "|", " "), r"[.!?]+(?=[ \t\n]|$)", "|"), r"[^a-z0-9|\n]+", " ")
    return F.translate(swap(swap(swap(words, r" *\n *", "\n"), r"\n{2,}", "|"), r"[ \n]*\|[ \n]*", "|"), "\n", " ")


HEAD = 3  # words of a sentence that it is looked up by; a shorter one is looked up whole


def _pieces(known: dict[str, str]) -> list[tuple[str, str, int, int, int, int, str]]:
    """(key, words, n, sentence, half, parts, id): each sentence whole (half 0), or its parts around * (1, 2, ...)."""
    out = []
    for number, (sentence, i) in enumerate(known.items()):
        parts = [x.split() for x in sentence.split("*") if x.split()]
        for half, words in enumerate(parts):
            out.append((" ".join(words[:HEAD]), " ".join(words), len(words), number, half + 1 if len(parts) > 1 else 0, len(parts), i))
    return out


def sentence_hits(docs: DataFrame, sentences: list[tuple[str, str]]) -> DataFrame:
    """(doc_id, digest, at, start, past, id): where known sentences stand, by sentence of the text and place of the word.

    A word's key is it and the next two. Keys of a text that are keys of known sentences come from one hash intersection;
    those places alone are looked up in the table of sentences (broadcast: MOST_SENTENCES rows at most) and compared
    as a whole. Around *, the parts are found each by itself, and a head takes the nearest tail behind it in its sentence, one word
    off at least. Matches inside a longer one, or as long and later in the table, do not count.
    """
    known: dict[str, str] = {}
    for i, sentence in sentences:
        known.setdefault(sentence, i)
    pieces = _pieces(known)
    longest, halves = max(p[2] for p in pieces), max(p[4] for p in pieces)
    lengths = sorted({min(HEAD, p[2]) for p in pieces})
    keys = F.array(*map(F.lit, sorted({p[0] for p in pieces})))
    table = F.broadcast(docs.sparkSession.createDataFrame(pieces, "key string, words string, n int, sentence int, half int, parts int, id string"))
    anchors = "|".join(_anchors(list(known)))
    marked = docs.where(F.lower("text").rlike(anchors)).select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "text")
    parts = marked.select("doc_id", "digest", F.posexplode(F.split(normal_words(F.col("text")), r"\|")).alias("at", "s")).where(F.col("s").rlike(anchors))
    parts = parts.select("doc_id", "digest", "at", F.split(F.trim("s"), " ").alias("w"))
    heads = F.flatten(F.transform("w", lambda _, i: F.array(*[F.array_join(F.slice("w", i + 1, F.lit(k)), " ") for k in lengths])))
    parts = parts.withColumn("present", F.array_intersect(heads, keys)).where(F.size("present") > 0)
    places = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.exists(F.array(*[F.array_join(F.slice("w", i + 1, F.lit(k)), " ") for k in lengths]), lambda h: F.array_contains("present", h)))
    found = F.transform(places, lambda i: F.struct(i.alias("start"), F.slice("w", i + 1, F.lit(longest)).alias("w")))
    rows = parts.select("doc_id", "digest", "at", F.explode(found).alias("f")).select("doc_id", "digest", "at", "f.start", "f.w")
    rows = rows.withColumn("key", F.explode(F.array(*[F.array_join(F.slice("w", 1, k), " ") for k in lengths])))
    hits = rows.join(table, "key").where(F.array_join(F.slice("w", F.lit(1), F.col("n")), " ") == F.col("words"))
    hits = hits.select("doc_id", "digest", "at", "start", (F.col("start") + F.col("n")).alias("past"), "sentence", "half", "parts", "id").distinct()
    for half in range(halves, 1, -1):  # the last two parts become one, until a sentence is whole
        place = F.when(F.col("half") == half, F.col("start")).otherwise(F.col("past"))
        order = Window.partitionBy("doc_id", "digest", "at", "sentence").orderBy(place, F.col("half") != half)
        tail = F.first(F.when(F.col("half") == half, F.col("past")), ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
        joins = (F.col("half") == half - 1) & (F.col("half") > 0) & (F.col("parts") >= half)
        hits = hits.withColumn("tail", tail).withColumn("past", F.when(joins, F.col("tail")).otherwise(F.col("past")))
        hits = hits.where("past is not null").where(F.col("half") != half).drop("tail")
    hits = hits.where("half <= 1")
    order = Window.partitionBy("doc_id", "digest", "at").orderBy("start", F.desc("past"), "sentence").rowsBetween(Window.unboundedPreceding, -1)
    outer = hits.withColumn("reach", F.max("past").over(order)).where("reach is null or past > reach")
    return outer.select("doc_id", "digest", "at", "start", "past", "id")


def scan_licences(docs: DataFrame, sentences: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_sentences, sentence_ids, licences) for every row of docs (doc_id, text).

    sentences (id, sentence) and rules (place, rule, ids) are relations of bounded size (MOST_SENTENCES, MOST_RULES;
    an error beyond); by default those of this module. sentence_ids are the identifiers of known sentences in order,
    joined by blanks; licences are the names of the rules that match them, in rule order, joined by blanks, each once. Each rule
    is tried once on what earlier rules left over; where a rule needs several identifiers, others may stand between.
    n_sentences counts the known sentences. Null, empty and wordless texts have none: 0 and two empty strings.
    Identifiers and names are words without blanks. Repeated rows stay, null ids too. Texts without any word that known sentences
    cannot do without are not looked at further; what is found, few narrow rows, is joined back by doc_id and the text's digest.
    """
    spark = docs.sparkSession
    listed = _bounded(default_sentences(spark) if sentences is None else sentences.select("id", "sentence"), MOST_SENTENCES)
    known = [(r["id"], s) for r in listed if r["id"] and (s := normal(r["sentence"] or "").strip("* "))]
    chain = _bounded((default_rules(spark) if rules is None else rules).select("place", "rule", "ids"), MOST_RULES)
    chain = [(r["rule"], tuple(r["ids"])) for r in sorted(chain, key=lambda r: (r["place"], r["rule"])) if r["ids"]]
    rows = docs.select("doc_id", "text")
    if not known:
        return rows.select("doc_id", F.lit(0).cast("long").alias("n_sentences"), F.lit("").alias("sentence_ids"), F.lit("").alias("licences"))
    place = F.struct("at", "start", "id")
    ids = F.transform(F.array_sort(F.collect_list(place)), lambda p: p["id"])
    found = sentence_hits(rows, known).groupBy("doc_id", "digest").agg(ids.alias("ids")).select(
        F.col("doc_id").alias("d"), F.col("digest").alias("g"), F.size("ids").cast("long").alias("n"), F.array_join("ids", " ").alias("sentence_ids"),
        F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")).alias("left"), F.lit("").alias("licences"),
    )
    found = (_apply_rules(found, chain) if chain else found).select("d", "g", "n", "sentence_ids", "licences")
    out = rows.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest")).join(found, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("digest") == F.col("g")), "left")
    return out.select("doc_id", F.coalesce("n", F.lit(0)).alias("n_sentences"), F.coalesce("sentence_ids", F.lit("")).alias("sentence_ids"), F.coalesce("licences", F.lit("")).alias("licences"))


def _rule_pattern(ids: tuple[str, ...]) -> str:
    return "".join(f"(.*?) {i} " for i in ids) + "(.*)"


def _apply_rules(df: DataFrame, chain: list[tuple[str, tuple[str, ...]]]) -> DataFrame:
    """All rules in order as one fold over an array of rules, so the expression does not double with each."""
    rules = F.array(
        *[
            F.struct(
                F.lit(name).alias("name"),
                F.lit("(?s)^" + _rule_pattern(tuple(map(re.escape, ids))) + "$").alias("pattern"),
                F.lit("".join(f"${i + 1}" for i in range(len(ids) + 1))).alias("rest"),
            )
            for name, ids in chain
        ]
    )
    start = F.struct(F.col("left").alias("left"), F.col("licences").alias("licences"))

    def step(acc: Column, rule: Column) -> Column:
        hit = F.regexp(acc["left"], rule["pattern"])
        return F.when(
            hit,
            F.struct(
                F.regexp_replace(acc["left"], rule["pattern"], rule["rest"]).alias("left"),
                F.when(F.array_contains(F.split(acc["licences"], " "), rule["name"]), acc["licences"])
                .otherwise(F.concat_ws(" ", F.nullif(acc["licences"], F.lit("")), rule["name"]))
                .alias("licences"),
            ),
        ).otherwise(acc)

    return df.withColumn("licences", F.aggregate(rules, start, step)["licences"])


def licences_sql() -> str:
    """The same rows from DuckDB by another way: texts become rows of words, and sentences join them word list by word
    list; of matches inside a longer one only the longer counts."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for i, sentence in dict.fromkeys((i, normal(s)) for i, s in SENTENCES):
        head, _, tail = (x.strip() for x in sentence.partition("*"))
        rows.append(f"({quote(i)}, {quote(head)}, {len(head.split())}, {quote(tail)}, {len(tail.split())})")
    steps, last = [], "base"
    for n, (name, ids) in enumerate(RULES):
        pattern = "^" + _rule_pattern(ids) + "$"
        rest = "".join(f"\\{i + 1}" for i in range(len(ids) + 1))
        steps.append(
            f"r{n} AS (SELECT row_id, doc_id, n_sentences, sentence_ids, "
            f"CASE WHEN regexp_matches(rest, '{pattern}', 's') THEN regexp_replace(rest, '{pattern}', '{rest}', 's') ELSE rest END AS rest, "
            f"CASE WHEN regexp_matches(rest, '{pattern}', 's') AND NOT list_contains(string_split(licences, ' '), '{name}') THEN trim(licences || ' {name}') ELSE licences END AS licences FROM {last})"
        )
        last = f"r{n}"
    return rf"""
WITH known(id, head, n_head, tail, n_tail) AS (VALUES {", ".join(rows)}),
firsts AS (SELECT DISTINCT string_split(head, ' ')[1] AS word FROM known),
numbered AS (SELECT row_number() OVER () AS row_id, doc_id, text FROM documents),
plain AS (
  SELECT row_id, regexp_replace(regexp_replace(lower(text), '\r\n?', chr(10), 'g'), '(^|[^a-z0-9])([a-z])\.', '\1\2 ', 'g') AS t FROM numbered
), split AS (
  SELECT row_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos
  FROM (SELECT row_id, regexp_split_to_array(t, '[.!?]+(?:[ \t\n]|$)|\n[^a-z0-9\n]*\n') AS parts FROM plain)
), worded AS (
  SELECT row_id, pos, string_split(trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')), ' ') AS w FROM split
), starts AS (
  SELECT row_id, pos, w, i0 FROM (SELECT row_id, pos, w, unnest(range(1, len(w) + 1)) AS i0, unnest(w) AS word FROM worded)
  WHERE word IN (SELECT word FROM firsts)
), heads AS (
  SELECT s.*, k.* FROM starts s JOIN known k ON string_split(k.head, ' ')[1] = s.w[s.i0] AND array_to_string(s.w[s.i0 : s.i0 + k.n_head - 1], ' ') = k.head
), hits AS (
  SELECT row_id, pos, i0, i0 + n_head AS past, id FROM heads WHERE n_tail = 0
  UNION ALL
  SELECT row_id, pos, i0, min(i0 + n_head + gap + n_tail), id FROM (SELECT *, unnest(range(1, len(w) - i0 - n_head + 1)) AS gap FROM heads WHERE n_tail > 0)
  WHERE array_to_string(w[i0 + n_head + gap : i0 + n_head + gap + n_tail - 1], ' ') = tail GROUP BY row_id, pos, i0, id, head, tail
), outer_hits AS (
  SELECT DISTINCT * FROM hits h WHERE NOT EXISTS (
    SELECT 1 FROM hits o WHERE o.row_id = h.row_id AND o.pos = h.pos AND o.i0 <= h.i0 AND o.past >= h.past AND o.past - o.i0 > h.past - h.i0)
), named AS (
  SELECT row_id, string_agg(id, ' ' ORDER BY pos, i0) AS sentence_ids, ' ' || string_agg(id, '  ' ORDER BY pos, i0) || ' ' AS rest, count(*) AS n
  FROM outer_hits GROUP BY row_id
), base AS (
  SELECT d.row_id, d.doc_id, coalesce(n, 0) AS n_sentences, coalesce(sentence_ids, '') AS sentence_ids, coalesce(rest, '  ') AS rest, '' AS licences
  FROM numbered d LEFT JOIN named n ON d.row_id = n.row_id
), {", ".join(steps)}
SELECT doc_id, n_sentences, sentence_ids, licences FROM {last}
"""
