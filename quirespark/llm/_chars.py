"""Texts as arrays of folded letters, for character statistics in numpy."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """For each code point: its lower-case code point if it is a letter, else 0."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint32)
    for c in range(sys.maxunicode + 1):
        s = chr(c)
        if s.isalpha():
            low = s.lower()
            out[c] = ord(low[0])
    return out


@lru_cache(maxsize=1)
def latin() -> np.ndarray:
    """For each code point: 1 to 26 for a letter whose base is a to z, else 0."""
    out = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    for c in range(0x2100):
        base = unicodedata.normalize("NFD", chr(c).lower())[:1]
        if "a" <= base <= "z":
            out[c] = ord(base) - 96
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def slices(texts: list[str | None], chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """Ranges of texts with about so many characters; a longer text is a range of its own."""
    start = size = 0
    for i, t in enumerate(texts):
        n = len(t or "") + 1
        if i > start and size + n > chars:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
