"""The boundary to text providers: batches, an ordered chain, bisection on failure, revalidation."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame

_PLACEHOLDER = re.compile(r"\[\[MATH_\d+\]\]")
OUT = "provider string, translated string, calls int, reason string"


class ProviderError(Exception):
    """A failed call. ``kind``: ``output`` (this batch is bad: halve it) or ``down`` (skip to the next provider)."""

    def __init__(self, kind: str, message: str = ""):
        super().__init__(message or kind)
        self.kind = kind


class Identity:
    """Returns texts as they are; the provider that ships."""

    name = "identity"

    def __call__(self, texts: list[str]) -> list[str]:
        return list(texts)


Provider = Callable[[list[str]], list[str]]


def fault(source: str, out: str | None) -> str | None:
    """Why a result can't be used: empty where the source is not, or other placeholders (as a multiset)."""
    if not out:
        return "empty" if source else None
    return None if Counter(_PLACEHOLDER.findall(source)) == Counter(_PLACEHOLDER.findall(out)) else "placeholders"


def batches(texts: Sequence[str], max_items: int, max_chars: int) -> Iterator[list[int]]:
    held, size = [], 0
    for i, t in enumerate(texts):
        if held and (len(held) >= max_items or size + len(t) > max_chars):
            yield held
            held, size = [], 0
        held.append(i)
        size += len(t)
    if held:
        yield held


def run_chain(texts: list[str], providers: Sequence[Provider], max_items: int = 10, max_chars: int = 4200, singly: bool = False) -> list[tuple]:
    """(provider, result, calls its batches took, reason) for each text. A provider gets what those before it
    could not do; a batch with a fault is halved until the bad text stands alone, so n texts take at most
    2n - 1 calls of a provider; with ``singly`` its texts are asked for one by one at once. What no provider can do keeps its source and the last reason."""
    out: list[tuple] = [(None, t, 0, "none") for t in texts]
    left = list(range(len(texts)))
    for provider in providers:
        name, failed, down = getattr(provider, "name", type(provider).__name__), [], False
        stack = [[left[i] for i in b] for b in batches([texts[i] for i in left], max_items, max_chars)][::-1]
        while stack:
            batch = stack.pop()
            reason, got = "down", []
            if not down:
                try:
                    got = provider([texts[i] for i in batch])
                    reasons = [fault(texts[i], g) for i, g in zip(batch, got)] if len(got) == len(batch) else ["count"]
                    reason = next((r for r in reasons if r), None)
                except ProviderError as e:
                    reason, down = e.kind, e.kind == "down"
                for i in batch:
                    out[i] = (out[i][0], out[i][1], out[i][2] + 1, reason)
            if reason is None:
                for i, g in zip(batch, got, strict=True):
                    out[i] = (name, g, out[i][2], None)
            elif len(batch) > 1 and not down:
                cut = 1 if singly else len(batch) // 2
                stack += [batch[k : k + cut] for k in range(0, len(batch), cut)][::-1] if singly else [batch[cut:], batch[:cut]]
            else:
                failed += batch
                for i in batch:
                    out[i] = (None, texts[i], out[i][2], reason)
        left = sorted(failed)
        if not left:
            break
    return out


def translate(items: DataFrame, providers: Sequence[Provider], text: str = "source", keep: Sequence[str] = ("doc_id", "pos", "item_id"), max_items: int = 10, max_chars: int = 4200) -> DataFrame:
    """items' ``keep`` columns with provider, translated, calls and reason; null texts count as empty.

    Rows go through the chain where they are, without a shuffle. A task that runs again calls the providers again.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in frames:
            got = run_chain([t or "" for t in df[text]], providers, max_items, max_chars)
            yield pd.concat([df[list(keep)].reset_index(drop=True), pd.DataFrame(got, columns=["provider", "translated", "calls", "reason"])], axis=1)

    kinds = dict(items.dtypes)
    return items.select(*keep, text).mapInPandas(run, ", ".join([*(f"{c} {kinds[c]}" for c in keep), OUT]))
