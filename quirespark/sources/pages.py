"""Raw web pages as rows of text, and a table function that cuts a page's text into blocks."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

_BOX = r"(?i)<(?:h[1-6]|p|li|td)(?:\s[^>]*)?>[^<]+"


def page_texts(pages: DataFrame) -> DataFrame:
    """(page_id, ord, tag, text) of the headings, paragraphs, list items and cells of pages (page_id, html), in order: the
    text up to the next tag, blanks collapsed. One pass of a pattern, in the JVM; null pages give none."""
    parts = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit(_BOX), F.lit(0))).alias("ord", "p"))
    text = F.trim(F.regexp_replace(F.regexp_replace("p", "^<[^>]*>", ""), r"\s+", " "))
    return parts.select("page_id", "ord", F.lower(F.regexp_extract("p", "(?i)^<(h[1-6]|p|li|td)", 1)).alias("tag"), text.alias("text"))


@F.udtf(returnType=StructType().add("ord", IntegerType()).add("kind", StringType()).add("text", StringType()))
class PageBlocks:
    """A page's text as blocks: lines, with the kind that their look suggests. For use in SQL, lateral to a table."""

    def eval(self, text: str | None) -> Iterator[tuple[int, str, str]]:
        for n, line in enumerate((text or "").split("\n")):
            flat = " ".join(line.split())
            if flat:
                kind = "list_item" if flat[0] in "•-–*" else "section" if len(flat) <= 60 and flat[-1] not in ".!?,;:" else "paragraph"
                yield n, kind, flat
