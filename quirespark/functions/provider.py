"""What providers are asked and what their answers mean: decision tables and request texts as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def next_step(locked: Column, exhausted: Column, status: Column) -> Column:
    """What to do about one model: ``fallback`` once locked, ``skip`` it if its day's quota is used up, else by the
    answer's status: ``accept``, ``lock`` (429, without waiting), ``next`` model (404, 5xx), ``raise``; a null
    status is a lost connection and goes to the next model."""
    return (
        F.when(F.coalesce(locked, F.lit(False)), "fallback")
        .when(F.coalesce(exhausted, F.lit(False)), "skip")
        .when(status.between(200, 299), "accept")
        .when(status == 429, "lock")
        .when(status.isNull() | (status == 404) | (status >= 500), "next")
        .otherwise("raise")
    )


#: Language codes that a web translator spells otherwise.
CODES = {"zh-CN": "zh-cn", "zh-TW": "zh-tw"}


def target_code(language: Column) -> Column:
    """A language's code: that of CODES, else the language in lower case."""
    plain = F.trim(F.coalesce(language, F.lit("")))
    out = F.lower(plain)
    for name, code in CODES.items():
        out = F.when(plain == name, code).otherwise(out)
    return out


def answer_translations(answer: Column, count: Column) -> Column:
    """The translations (array<string>) of a JSON answer; null unless it holds exactly ``count`` strings."""
    got = F.from_json(answer, "translations array<string>")["translations"]
    return F.when((F.size(got) == count) & ~F.exists(got, lambda t: t.isNull()), got)


def answer_text(answer: Column) -> Column:
    """The text parts of a nested JSON answer's first candidate, joined; empty if there are none."""
    got = F.from_json(answer, "candidates array<struct<content: struct<parts: array<struct<text: string>>>>>")["candidates"]
    texts = F.filter(F.transform(F.get(got, F.lit(0))["content"]["parts"], lambda p: p["text"]), lambda t: t.isNotNull())
    return F.coalesce(F.array_join(texts, ""), F.lit(""))


def glossary_lines(terms: Column) -> Column:
    """Terms (source, target, policy, note) as lines of a request; those without source or target are passed over,
    and a term that is kept repeats its source."""
    t = F.filter(terms, lambda x: (F.trim(x["source"]) != "") & (F.trim(x["target"]) != ""))

    def line(x: Column) -> Column:
        note = F.trim(F.coalesce(x["note"], F.lit("")))
        source = F.trim(x["source"])
        to = F.when(F.trim(x["policy"]) == "keep_english", F.concat(F.lit("KEEP ENGLISH EXACTLY AS: "), source)).otherwise(F.trim(x["target"]))
        return F.concat(F.lit("- "), source, F.lit(" => "), to, F.when(note != "", F.concat(F.lit(" ("), note, F.lit(")"))).otherwise(""))

    lines = F.array_join(F.transform(t, line), "\n")
    return F.when(F.coalesce(lines, F.lit("")) == "", "- none supplied").otherwise(lines)


def without_assets(blocks: Column) -> Column:
    """Blocks of an array without their field ``asset``, which no checkpoint holds."""
    return F.transform(blocks, lambda b: b.dropFields("asset"))
