"""Terms that must outlive a provider, by a glossary for each document: found by one automaton for each glossary."""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import protect as P

#: Characters of all glossaries together that may be sent to every task, and automata that a task keeps.
LARGEST, AT_HAND = 16_000_000, 64
_PLACEHOLDER = re.compile(P.PLACEHOLDER)


class Terms:
    """All terms of a glossary in one automaton: a text is read once, however many terms there are. Of the terms that
    start at one place the longest is taken, from the left, without overlap."""

    def __init__(self, terms: Sequence[str]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t in terms:
            self.automaton.add_word(t, len(t))
        self.some = bool(terms)
        self.automaton.make_automaton()

    def spans(self, text: str) -> Iterator[tuple[int, int]]:
        if self.some:
            for last, n in self.automaton.iter_long(text):
                yield last + 1 - n, last + 1

    def exchanged(self, text: str) -> tuple[str, list[str]]:
        """The text with tokens in place of placeholders and terms, and those in order. Placeholders come first: no term
        reaches into one."""
        kept: list[str] = []
        out: list[str] = []

        def keep(held: str) -> None:
            out.append(P.TOKEN.format(len(kept)))
            kept.append(held)

        def part(gap: str) -> None:
            at = 0
            for start, end in self.spans(gap):
                out.append(gap[at:start])
                keep(gap[start:end])
                at = end
            out.append(gap[at:])

        at = 0
        for m in _PLACEHOLDER.finditer(text):
            part(text[at : m.start()])
            keep(m.group())
            at = m.end()
        part(text[at:])
        return "".join(out), kept


def protected_by(
    items: DataFrame, glossaries: DataFrame, text: str = "source", keep: Sequence[str] = ("doc_id", "pos"), by: str = "glossary_id", largest: int = LARGEST
) -> DataFrame:
    """items' ``keep`` columns with ``safe``, the text with a token for each placeholder and each term of its own glossary, and
    ``kept``, what the tokens stand for: :func:`~quirespark.functions.protect.restored` puts it back.

    glossaries has rows (``by``, term); terms are trimmed, blank ones and repeats go, case counts. A null or unknown glossary
    has no terms; a null text stays null. Glossaries go to all tasks if they are small by count of characters; else each
    row gets its glossary's terms by a join. Either way texts are not gathered, and a glossary's automaton is built once in a
    task that meets it (the last few are kept).
    """
    clean = glossaries.select(by, F.trim("term").alias("term")).where((F.col("term") != "") & F.col(by).isNotNull()).distinct()
    lists = clean.groupBy(by).agg(F.collect_set("term").alias("terms"))
    small = (clean.agg(F.sum(F.length("term"))).first()[0] or 0) <= largest
    spark = items.sparkSession
    shared = spark.sparkContext.broadcast({r[by]: r.terms for r in lists.collect()}) if small else None
    kinds = dict(items.dtypes)
    ddl = ", ".join([*(f"{c} {kinds[c]}" for c in keep), "safe string, kept array<string>"])
    schema = to_arrow_schema(StructType.fromDDL(ddl))
    rows = items.select(*keep, text, by) if small else items.select(*keep, text, by).join(lists, by, "left").select(*keep, text, by, "terms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built: OrderedDict = OrderedDict()

        def of(key: object, terms: Sequence[str] | None) -> Terms:
            if key not in built:
                built[key] = Terms((shared.value.get(key, ()) if small else terms) or ())
                if len(built) > AT_HAND:
                    built.popitem(last=False)
            built.move_to_end(key)
            return built[key]

        n = len(keep)
        for batch in batches:
            terms = batch.column(n + 2) if not small else None
            made = []
            for i, (t, key) in enumerate(zip(batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True)):
                known = key in built or small
                made.append((None, None) if t is None else of(key, None if known else terms[i].as_py()).exchanged(t))
            columns = [*batch.columns[:n], pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return rows.mapInArrow(run, ddl)
