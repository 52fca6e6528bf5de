"""Words whose first letter was read as a section sign, restored from the measured text."""

from __future__ import annotations

import re
from itertools import takewhile

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from . import text as X

#: Words after a section sign that are commands of the formula transport, not misread words.
RESERVED = (
    "math", "mathcal", "mathbf", "boldsymbol", "mathrm", "text", "textsf", "textbf", "textit", "operatorname", "frac", "sqrt",
    "rho", "gamma", "theta", "sigma", "pi", "phi", "psi", "omega", "alpha", "beta", "delta", "lambda", "mu", "nu", "tau",
)

_WORD = re.compile(r"[^\W\d_]+")


def _runs(text: str) -> list[str]:
    """Maximal runs of letters; ``\\w`` also has numbers that are not digits."""
    found = _WORD.findall(text)
    return found if all(map(str.isalpha, found)) else "".join(c if c.isalpha() else " " for c in text).split()


def _head(text: str) -> str:
    """The run of letters that a text starts with."""
    m = _WORD.match(text)
    return "" if m is None else m[0] if m[0].isalpha() else "".join(takewhile(str.isalpha, m[0]))


def _folded(text: str) -> str:
    out = text.lower()
    if not out.isascii():
        for letter, spelt in X.FOLDS.items():
            out = out.replace(letter, spelt)
    return out


def _mended(text: str, source: str) -> str:
    """Words go into one table by their folded tails, so both texts are read once, however long they are."""
    words = _runs(source)
    only: dict[str, str | None] = {}
    for word, tail in zip(words, _folded(" ".join([w[1:] for w in words])).split(" "), strict=False):
        only[tail] = None if tail in only else word
    first, *rest = text.split("§")
    asked, out = [_head(p) for p in rest], [first]
    for piece, tail, key in zip(rest, asked, _folded(" ".join(asked)).split(" "), strict=True):
        word = only.get(key) if tail and key not in RESERVED else None
        out += (word, piece[len(tail) :]) if word and len(word) == len(tail) + 1 else ("§", piece)
    return "".join(out)


@F.pandas_udf(StringType())
def _by_tails(text: pd.Series, source: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else _mended(t, s or "") for t, s in zip(text, source, strict=True)], dtype=object)


def repaired(text: Column, source: Column) -> Column:
    """``text`` with each §word replaced by the one word of ``source`` that is a letter longer and ends in it, cases
    folded. A word that the source has twice, or two words that fit, repair nothing; commands and lone signs stay."""
    some = text.contains("§")
    return F.when(some, _by_tails(F.when(some, text), F.when(some, source))).otherwise(text)
