"""TeX rules: brace balance as a Column, token parsers as Arrow-batched functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

_OPEN = re.compile(r"[§\\$]math\{")
_BRACE = re.compile(r"[{}]")
_TOKEN = re.compile(r"\\[A-Za-z]+|\\.|\s+|.", re.S)


def brace_error(math: Column) -> Column:
    """What is wrong with a formula's groups, or null. Escaped braces are characters, not groups; a null formula gives null."""
    braces = F.regexp_replace(F.regexp_replace(math, r"\\[{}]", ""), r"[^{}]", "")
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.struct(depth.alias("depth"), F.least(a["least"], depth).alias("least"))

    end = F.aggregate(F.split(braces, ""), start, step)
    return F.when(end["least"] < 0, "extra closing brace").when(end["depth"] > 0, F.concat(end["depth"].cast("string"), F.lit(" unmatched opening brace(s)")))


def _closing(text: str, begin: int) -> int:
    """The place after the group that opens at ``begin``, or -1."""
    depth = 0
    for m in _BRACE.finditer(text, begin):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return m.end()
    return -1


def wrapped_parts(text: str) -> list[tuple[str, str]]:
    """Text and math parts of prose in which math wrappers were left; wrappers around wrappers are taken off."""
    parts, at, look = [], 0, 0
    while m := _OPEN.search(text, look):
        end = _closing(text, m.end() - 1)
        if end < 0:
            look = m.start() + 1
            continue
        inner = text[m.end() : end - 1]
        while (n := _OPEN.match(inner)) and _closing(inner, n.end() - 1) == len(inner):
            inner = inner[n.end() : -1]
        parts += [("text", text[at : m.start()])] * (m.start() > at) + [("math", inner)]
        at = look = end
    return parts + [("text", text[at:])] * (at < len(text) or not parts)


class _Scripts:
    """Recursive descent over a formula's tokens; an atom that gets a second script of a kind is grouped first."""

    def __init__(self, text: str):
        self.tokens, self.at = _TOKEN.findall(text), 0

    def peek(self) -> str:
        return self.tokens[self.at] if self.at < len(self.tokens) else ""

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1]

    def atom(self) -> str:
        out = self.take()
        if out == "{":
            return out + self.row(inside=True)
        if re.fullmatch(r"\\[A-Za-z]+", out):
            while self.peek() == "{":
                out += self.atom()
        return out

    def row(self, inside: bool = False) -> str:
        out = ""
        while token := self.peek():
            if token in "_^" or token.isspace():
                out += self.take()
            elif token == "}" and inside:
                return out + self.take()
            else:
                out += self.scripted()
        return out

    def scripted(self) -> str:
        out, seen = self.atom(), set()
        while True:
            k = self.at + self.peek().isspace()
            mark = self.tokens[k] if k < len(self.tokens) else ""
            j = k + 1 + (k + 1 < len(self.tokens) and self.tokens[k + 1].isspace())
            if mark not in ("_", "^") or j >= len(self.tokens) or self.tokens[j] in "_^}":
                return out
            self.at = j
            if mark in seen:
                out, seen = "{" + out + "}", set()
            out += mark + self.atom()
            seen.add(mark)


def grouped_scripts(text: str) -> str:
    """C_A_B becomes {C_A}_B, so that no atom has two scripts of one kind; nothing is dropped."""
    return _Scripts(text).row()


@F.pandas_udf(ArrayType(StructType().add("kind", StringType()).add("content", StringType())))
def split_wrapped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else [{"kind": k, "content": c} for k, c in wrapped_parts(t)])


@F.pandas_udf(StringType())
def group_scripts(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else grouped_scripts(t))
