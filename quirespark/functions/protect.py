"""Terms and placeholders that must outlive a provider: exchanged for tokens, and put back under a check."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text as X

PLACEHOLDER = r"\[\[MATH_[0-9]+\]\]"
TOKEN = "QZKEEP{}ZQ"
_TOKEN_RE = "(?i)QZKEEP([0-9]{1,9})ZQ"


def pattern(terms: Sequence[str]) -> str:
    """Placeholders and each different term, longer ones first. A glossary is bounded, so it fits a pattern."""
    kept = sorted(dict.fromkeys(t.strip() for t in terms if t.strip()), key=len, reverse=True)
    return "|".join([PLACEHOLDER, *map(re.escape, kept)])


def _joined(gaps: Column, between: Column) -> Column:
    """gaps with between[i] after the i-th; the last gap has none. What a lambda names is worked out for each element, so
    between is worked out before."""
    joined = lambda b: F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get(b, i), F.lit("")))), "")
    return X.let(between, joined)


def held(text: Column, terms: Sequence[str]) -> Column:
    """What is to be protected, in order; repeated terms each count."""
    return F.regexp_extract_all(text, F.lit(f"({pattern(terms)})"), F.lit(0))


def protected(text: Column, terms: Sequence[str]) -> Column:
    """The text with token i in the place of held(text)[i]."""
    before, after = TOKEN.split("{}")
    tokens = F.transform(held(text, terms), lambda _, i: F.concat(F.lit(before), i.cast("string"), F.lit(after)))
    return _joined(F.split(text, pattern(terms), -1), tokens)


def restore_fault(out: Column, kept: Column) -> Column:
    """Why a result can't be restored: ``unknown`` token, ``missing`` token, ``leftover`` of one; null if it can."""
    got = F.transform(F.regexp_extract_all(out, F.lit(_TOKEN_RE), F.lit(1)), lambda x: x.cast("int"))
    want = F.transform(kept, lambda _, i: i)
    rest = F.lower(F.regexp_replace(out, _TOKEN_RE, ""))
    return F.when(F.size(F.array_except(got, want)) > 0, "unknown").when(F.size(F.array_except(want, got)) > 0, "missing").when(rest.contains("qzkeep"), "leftover")


def restored(out: Column, kept: Column) -> Column:
    """The result with what was protected put back; null if restore_fault finds a reason."""
    got = X.let(kept, lambda k: F.transform(F.regexp_extract_all(out, F.lit(_TOKEN_RE), F.lit(1)), lambda x: F.get(k, x.cast("int"))))
    return F.when(restore_fault(out, kept).isNull(), _joined(F.split(out, _TOKEN_RE, -1), got))
