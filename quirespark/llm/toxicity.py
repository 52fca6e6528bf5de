"""Toxicity scores of texts restored by noisy-channel decoding."""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import code_points, latin, slices
from ._common import fold, sliced

# Characters that stand for letters in obfuscated words.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
SEPARATORS = set(".-_*~'`,:;/\\^\"#%&=<>[]{}?)")
PREFIXES = (4, 5, 6, 7)

#: Log costs of the channel: a symbol read as a letter, a symbol dropped, a repeated letter dropped, one kept.
COST = {"leet": -1.0, "drop": -1.5, "collapse": -0.2, "repeat": -2.0}


@dataclass(frozen=True)
class ToxicityModel:
    """weights: evidence (log likelihood ratio) of a word or prefix; rate: evidence against, for each word of a
    text; prior: log odds before any evidence; char_log_p: log P(c | a, b) of letters 0 (word end) to 26."""

    weights: dict[str, float]
    char_log_p: np.ndarray
    rate: float = 0.0
    prior: float = -4.0


def char_counts(docs: DataFrame) -> np.ndarray:
    """Counts of letter trigrams (27 x 27 x 27) over the whole texts of all rows, added up in each task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for batch in sliced(batches):
            texts = batch.column(0).to_pylist()
            for a, b in slices(texts):
                c = latin()[code_points("\x00".join(t or "" for t in texts[a:b]) + "\x00")].astype(np.int32)
                c = np.concatenate((np.zeros(2, np.int32), c))
                total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["gram", "n"])

    rows = docs.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(27**3)
    out[rows["gram"].to_numpy(dtype=np.int64)] = rows["n"].to_numpy()
    return out.reshape(27, 27, 27)


def char_model(counts: np.ndarray, words: dict[str, float], share: float = 0.05) -> np.ndarray:
    """log P(c | a, b), with the words' own trigrams making up about ``share`` of the mass."""
    own = np.zeros_like(counts)
    for w, weight in words.items():
        c = [0, 0, *latin()[code_points(w)].tolist(), 0]
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            own[x, y, z] += weight
    if own.sum():
        own *= share * max(counts.sum(), 1.0) / own.sum()
    joint = counts + own
    bi = joint.sum(axis=0) + 0.5
    bi /= bi.sum(axis=1, keepdims=True)
    tri = (joint + 2 * bi[None]) / (joint.sum(axis=2, keepdims=True) + 2)
    return np.log(tri)


def decode(noisy: str, log_p: np.ndarray | list, spaces: bool = False, collapse: bool = True) -> str:
    """Viterbi decoding of one obfuscated word of any length: the likeliest letters under the character model.

    The lattice has, for each character, its letters (a letter is itself, a symbol any letter that it
    stands for), and arcs that drop it: symbols at a cost, repetitions of the letter before nearly free.
    A state is the last two letters; ties go to the first reading. With ``spaces`` a word may end after each letter,
    and the reading has a blank there; without ``collapse`` repeated letters stay.
    """
    table = latin()
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # text: (text before, letter)
    before = ""
    for ch in noisy:
        code = int(table[ord(ch)])
        options = [(code, ch, 0.0)] if code else [(ord(x) - 96, x, COST["leet"]) for x in LEET.get(ch, "")]
        new: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def put(key: tuple[int, int], value: float, text: tuple | None, new: dict = new) -> None:
            if key not in new or value > new[key][0]:
                new[key] = (value, text)

        for (a, b), (value, text) in states.items():
            if not code:
                put((a, b), value + COST["drop"] * (1 if ch in LEET else 0.2), text)
            for c, letter, cost in options:
                repeated = collapse and b == c and (ch == before or not code)
                if repeated:
                    put((a, b), value + COST["collapse"], text)
                put((b, c), value + cost + log_p[a][b][c] + COST["repeat"] * repeated, (text, letter))
        if spaces:
            for (a, b), (value, text) in list(new.items()):
                if b:
                    put((b, 0), value + log_p[a][b][0], (text, " "))
        states, before = new, ch
    text = max(((v + (log_p[a][b][0] if b or not a else 0.0), t) for (a, b), (v, t) in states.items()), key=lambda x: x[0])[1]
    out: list[str] = []
    while text is not None:
        text, letter = text
        out.append(letter)
    return "".join(reversed(out))


_EDGE = re.compile(r"^[^\w@$!|+(€£¡]+|[^\w]+$|^[|+(]+(?=\w)|_+$")
_OUTSIDE = re.compile(r"^[^\w@$!|+(€£¡]+|[^\w@$!|+(€£¡]+$|_+$")  # marks at the ends that stand for no letter
_DOUBLE = re.compile(r"(.)\1")
_DOUBLES = re.compile(r"(.)\1+")
_CLOSING = ".,;:!?\"')"
_WORDS = re.compile(r"[^\W\d_]+").findall
_PARTS = re.compile("[" + re.escape("".join(sorted(SEPARATORS))) + "]+").split


def restore(token: str, log_p: np.ndarray | list) -> str:
    """The letters of one token without white space: as they are, or decoded if it looks obfuscated."""
    token = token.lower()
    if not token.isalpha():
        core = _EDGE.sub("", token)
        if not core.isalpha():
            if not any(c.isalpha() for c in core):
                return ""
            first, last = core[0].isalpha(), core[-1].isalpha()
            if all(c.isalpha() or c in SEPARATORS for c in core) and first and last and len(core) > 2 * sum(c in SEPARATORS for c in core) + 1:
                return core  # a compound such as well-known: its parts are read one by one
            return decode(core, log_p)
        token = core
    doubles = _DOUBLE.findall(token)
    if len(doubles) > 1 and (len(doubles) * 4 >= len(token) or re.search(r"(.)\1\1", token)):
        return decode(token, log_p)
    return token


def readings(token: str, log_p: np.ndarray | list) -> list[list[str]]:
    """The ways to read one token without white space, each a list of words: as it is if it has letters only; else
    decoded with every sign at its ends that may stand for a letter (the lattice drops those that do not), with and without
    repeated letters; its plain core; the words between separators, each decoded if it holds symbols, and all its runs of
    letters. A token without any letter is a number or a mark, and has none."""
    if token.isalpha():
        return [[token.lower()]]
    whole = _OUTSIDE.sub("", token.lower())
    core = _EDGE.sub("", whole)
    if not any(c.isalpha() for c in core):
        return []
    ways = [whole] if core.isalpha() or core == whole else [whole, core]
    out = [[decode(x, log_p, collapse=c)] for x in ways if not x.isalpha() for c in ((True, False) if _DOUBLE.search(x) else (True,))]
    if core.isalpha():
        return [*out, [core]]
    for parts in (_PARTS(core), _WORDS(core)):
        if len(parts) > 1:
            out.append([x if x.isalpha() else decode(x, log_p) for x in parts if any(c.isalpha() for c in x)])
    return out


def features(word: str) -> Iterator[str]:
    """A restored word and its prefixes, in the form in which they are learned."""
    if len(word) >= 3:
        yield word
    for k in PREFIXES:
        if len(word) > k:
            yield word[:k] + "*"


def fit_lexicon(
    sample: list[tuple[str, int]], share: float = 0.2, least: int = 5, texts_least: int = 3, floor: float = 1.0
) -> tuple[dict[str, float], float]:
    """Words and prefixes that mark toxic texts, with their evidence, and their rate in such texts.

    The two hypotheses are Poisson: a toxic text has a marking word at ``share`` times the rate that toxic
    texts of the sample have it (so that texts with few of them are found too), a clean text at the clean
    rate. Occurrences are counted as distinct contexts (the word and its neighbour on either side): the many
    copies of one text are one context, so what they happen to contain is no evidence.
    """
    def occurrences(text: str) -> Iterator[tuple[str, int]]:
        words = ["", *_WORDS(text.lower()), ""]
        for left, w, right in zip(words, words[1:], words[2:], strict=False):
            yield w, hash((left, w, right))

    texts: Counter[str] = Counter()
    every = [array("q"), array("q")]
    for text, label in sample:
        every[label > 0].extend(h for _, h in occurrences(text))
        if label:
            texts.update(list(dict.fromkeys(f for w in _WORDS(text.lower()) for f in features(w))))
    n_clean, n_toxic = (len(np.unique(np.asarray(x))) for x in every)
    del every
    ratio = n_clean / max(1, n_toxic)

    toxic: dict[str, set[int]] = {f: set() for f, n in texts.items() if n >= texts_least}
    for text, label in sample:
        if label:
            for w, h in occurrences(text):
                for f in features(w):
                    if f in toxic:
                        toxic[f].add(h)
    # A feature of more clean contexts than this has too little evidence, so no more of them are kept.
    most = {f: share * ratio * len(x) / math.exp(floor) * (1 + 1e-9) for f, x in toxic.items() if len(x) >= least}
    clean: dict[str, set[int]] = {f: set() for f, n in most.items() if n >= 1}
    for text, label in sample:
        if not label:
            for w, h in occurrences(text):
                for f in features(w):
                    if (seen := clean.get(f)) is not None:
                        seen.add(h)
                        if len(seen) + 1 > most[f]:
                            del clean[f]
    out: dict[str, float] = {}
    covered: set[int] = set()
    for f, seen in clean.items():
        evidence = math.log(max(share * ratio * len(toxic[f]) / (len(seen) + 1), 1e-9))
        if evidence >= floor:
            out[f] = evidence
            covered |= toxic[f]
    return out, share * len(covered) / max(1, n_toxic)


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = 2000, strictness: float = 0.8) -> ToxicityModel:
    """Learn from labelled rows whose crc32(doc_id as text) mod 4 is not 2.

    The lexicon is fitted in one task on at most ``bound`` labelled texts of each class (those of least
    hash of doc_id); class rates and the
    character model are counted over all rows. strictness lowers the log odds of every text. Rows without label, doc_id or text teach nothing.
    """
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # Labels meet ids only, so no text is shuffled; then a bounded list of ids fetches the sample's texts.
    ids = docs.where(F.col("text").isNotNull() & (fold("doc_id", 4) != 2)).select("doc_id").distinct().join(known, "doc_id")
    n = {r["y"]: r["n"] for r in ids.groupBy((F.col("toxic") > 0).cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    drawn = None
    for k in (0, 1):
        part = ids.where((F.col("toxic") > 0) == F.lit(bool(k))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)
        drawn = part if drawn is None else drawn.union(part)
    texts = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(drawn), "doc_id")
    sample = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    toxic = (n.get(1, 0) + 0.5) / (sum(n.values()) + 5)

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(t, int(y > 0)) for b in sliced(batches) for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        got, rate = fit_lexicon(rows)
        names, values = ["", *got], [rate, *got.values()]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(values, pa.float64())], names=["f", "v"])

    weights = {r["f"]: r["v"] for r in sample.select("text", "toxic").coalesce(1).mapInArrow(fit, "f string, v double").collect()}
    rate = weights.pop("", 0.0)
    log_p = char_model(char_counts(docs), {f: math.exp(v) for f, v in weights.items() if f[-1] != "*"})
    return ToxicityModel(weights, log_p, rate, math.log(toxic / (1 - toxic)) - strictness)


class _Scorer(dict):
    """The words with evidence in each raw token, and that evidence, memoised in one task."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.model = model
        self.log_p = model.char_log_p.tolist()  # lists are read faster than an array, one number at a time
        self.starts = {f[:4] for f in model.weights}
        self.whole = [f for f in model.weights if f[-1] != "*"]
        self.longest = max(map(len, self.whole), default=0)
        self.pieces = {f[i:j] for f in self.whole for i in range(len(f)) for j in range(i + 1, len(f) + 1)} - set(self.whole)
        self.heads = {f[:j] for f in self.whole for j in range(1, len(f) + 1)}
        self.join = lru_cache(100_000)(lambda x: decode(x, self.log_p))
        self.read = lru_cache(100_000)(lambda x: restore(x, self.log_p) or x)
        self.run = lru_cache(100_000)(lambda x: self.broken(x.split(" ")))
        self.part: dict[str, bool] = {}  # fragment() of tokens seen
        self.single = {_DOUBLES.sub(r"\1", s) for s in self.starts}  # beginnings without repeated letters
        self.telling = [pa.array(sorted(x), pa.large_string()) for x in (self.starts, self.pieces)]

    def notable(self, tokens: pa.Array) -> np.ndarray:
        """Which tokens need a closer look. The others are letters with at most marks behind, without repeated
        letters, and neither begin like a word of the lexicon nor are a piece of one: no evidence and no fragment."""
        low = pc.utf8_lower(tokens)
        core = pc.utf8_rtrim(low, _CLOSING)
        points = code_points("\n".join(core.to_pylist()) + "\n")
        at = np.flatnonzero(points == 10)
        twice = np.flatnonzero(points[1:] == points[:-1])
        doubled = np.zeros(len(core), bool)
        doubled[np.searchsorted(at, twice)] = True
        plain = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False) & ~doubled
        begins = pc.is_in(pc.utf8_slice_codeunits(core, 0, 4), self.telling[0])
        piece = pc.or_(pc.is_in(core, self.telling[1]), pc.less_equal(pc.utf8_length(tokens), 1))
        return ~plain | pc.or_(begins, piece).to_numpy(zero_copy_only=False)

    def word(self, w: str) -> float:
        if w[:4] not in self.starts:
            return 0.0
        return max((self.model.weights.get(f, 0.0) for f in features(w)), default=0.0)

    def hit(self, w: str) -> tuple[str, float]:
        """A word and its evidence; one with doubled letters is looked up decoded and as it is."""
        ways = [w]
        if _DOUBLE.search(w):
            once = _DOUBLES.sub(r"\1", w)  # decoding only drops repeated letters
            if any(once[:k] in self.single for k in range(1, 5)):
                ways = [decode(w, self.log_p), w]
        return max(((x, self.word(x)) for x in ways), key=lambda x: x[1])

    def __missing__(self, token: str) -> list[tuple[str, float]]:
        """Of the token's readings the one of most evidence, with every word of it that has any."""
        ways = ([h for w in way if (h := self.hit(w))[1]] for way in readings(token, self.log_p))
        hits = max(ways, key=lambda way: sum(v for _, v in way), default=[])
        if len(self) > 300_000:
            self.clear()
            self.part.clear()
        self[token] = hits
        return hits

    def spaced(self, letters: str) -> list[tuple[str, float]]:
        """The toxic words in the reading of a run of single characters, repeated letters dropped or, if that has
        more evidence, kept."""
        ways = [decode(letters.lower(), self.log_p, True, c) for c in ((True, False) if _DOUBLE.search(letters.lower()) else (True,))]
        return max((self.segments(x.split()) for x in ways), key=lambda x: sum(v for _, v in x))

    def segments(self, words: list[str]) -> list[tuple[str, float]]:
        """The toxic words of most evidence that do not overlap in a run read as ``words``.

        Lexicon words of more than three letters count anywhere, those of three where the reading begins and ends
        words, prefixes where it begins one.
        """
        text = "".join(words)
        bounds = {0, *np.cumsum([len(w) for w in words]).tolist()}
        arcs: dict[int, list[tuple[int, str, float]]] = defaultdict(list)  # by end: (start, word, evidence)
        for at in bounds:
            for k in PREFIXES:
                if at + k < len(text) and (v := self.model.weights.get(text[at : at + k] + "*")):
                    arcs[at + k].append((at, text[at : at + k], v))
        for f in self.whole:
            at = text.find(f)
            while at >= 0:
                if len(f) > 3 or (at in bounds and at + len(f) in bounds):
                    arcs[at + len(f)].append((at, f, self.model.weights[f]))
                at = text.find(f, at + 1)
        best = [0.0] * (len(text) + 1)
        taken: list[tuple[int, str, float] | None] = [None] * (len(text) + 1)
        for end in range(1, len(text) + 1):
            best[end] = best[end - 1]
            for arc in arcs.get(end, ()):
                if best[arc[0]] + arc[2] > best[end]:
                    best[end], taken[end] = best[arc[0]] + arc[2], arc
        out, end = [], len(text)
        while end:
            if arc := taken[end]:
                out.append(arc[1:])
            end = arc[0] if arc else end - 1
        return out

    def fragment(self, token: str) -> bool:
        """Whether a token may be a piece of a word of the lexicon: one character, or letters within such a word."""
        if len(token) == 1:
            return True
        if token.isalpha() and not _DOUBLE.search(w := token.lower()):
            return w in self.pieces and not self[token]
        w = restore(token, self.log_p)
        return len(w) < self.longest and w in self.pieces and not self[token]

    def broken(self, tokens: list[str]) -> list[tuple[str, float]]:
        """The toxic words in a run of fragments: lexicon words made of whole tokens, from the left the longest first;
        single characters between them, three at least, are read as a run of their own."""
        out: list[tuple[str, float]] = []
        read = [self.read(t) for t in tokens]
        singles: list[str] = []

        def flush() -> None:
            if len(singles) >= 3:
                out.extend(self.spaced("".join(singles)))
            singles.clear()

        i = 0
        while i < len(tokens):
            found = 0
            j, size = i + 1, len(read[i])
            plain, begun = read[i], tokens[i].isalpha() and read[i] in self.heads
            odd = not tokens[i].isalpha()  # symbols or doubled letters: the join may be read otherwise than its parts
            many = len(tokens[i]) > 1
            while j < len(tokens) and size < 2 * self.longest:
                odd = odd or not tokens[j].isalpha() or plain[-1:] == read[j][:1]
                plain, size, many = plain + read[j], size + len(read[j]), many or len(tokens[j]) > 1
                begun = begun and plain in self.heads
                j += 1
                if not (begun or odd):
                    break  # a longer join is no word either, unless symbols or doubles follow
                if many:
                    for joined in (plain, self.join("".join(tokens[i:j]).lower())) if odd else (plain,):
                        if joined in self.model.weights:
                            found, word = j, joined
                            break
            if found:
                flush()
                out.append((word, self.word(word)))
                i = found
            else:
                if len(tokens[i]) == 1:
                    singles.append(tokens[i])
                else:
                    flush()
                i += 1
        flush()
        return out


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """Add score (0 to 1) to all rows of docs (text, ...), from the whole text alone.

    Each token, of any length, is restored (leetspeak, separators, repetition; runs of three or more single
    characters, and of pieces of lexicon words, are read together) and looked up, with its prefixes, in the lexicon; one that separators divide
    may be read in parts, which all count. The log odds are the prior, plus the
    evidence of each different word found, times 1 + ln(its occurrences), less the rate for each token.
    Null, empty and wordless texts have the prior alone. Other columns pass through; one named score, in any case, is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "score"]
    plain = docs.select(kept)
    at = kept.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _Scorer(model)
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            odds = np.full(len(texts), model.prior)
            for a, b in slices(texts):
                words = pc.utf8_split_whitespace(pa.array([t or "" for t in texts[a:b]], pa.large_string()))
                ends = words.offsets.to_numpy()
                coded = words.values.dictionary_encode()
                names = coded.dictionary.to_pylist()
                if len(scorer) > 200_000:
                    scorer.clear()
                    scorer.part.clear()
                closer = np.flatnonzero(scorer.notable(coded.dictionary)).tolist()  # the others say nothing
                hits: dict[int, list[tuple[str, float]]] = {}
                part = np.zeros(len(names), bool)
                for i in closer:
                    if got := scorer[names[i]]:
                        hits[i] = got
                    if (known := scorer.part.get(names[i])) is None:
                        known = scorer.part[names[i]] = scorer.fragment(names[i])
                    part[i] = known
                toxic = np.zeros(len(names), bool)
                toxic[list(hits)] = True
                codes = coded.indices.to_numpy()
                owner = lambda i, ends=ends: np.searchsorted(ends, i, side="right") - 1
                found: dict[int, dict[str, list[float]]] = defaultdict(dict)

                def note(d: int, word: str, value: float, found: dict = found) -> None:
                    hit = found[d].setdefault(word, [value, 0])
                    hit[1] += 1

                for i in np.flatnonzero(toxic[codes]):
                    for word, value in hits[codes[i]]:
                        note(int(owner(i)), word, value)
                piece = part[codes]
                first = np.zeros(len(piece) + 1, bool)  # where a text begins, and the end: runs do not go on there
                first[ends] = True
                begun = np.flatnonzero(piece & (first[:-1] | ~np.concatenate(([False], piece[:-1]))))
                past = np.flatnonzero(piece & (first[1:] | ~np.concatenate((piece[1:], [False])))) + 1
                long = past - begun >= 2
                begun, past = begun[long], past[long]
                for i, j, d in zip(begun.tolist(), past.tolist(), owner(begun).tolist(), strict=True):
                    for word, value in scorer.run(" ".join(names[c] for c in codes[i:j])):
                        note(d, word, value)
                odds[a:b] -= model.rate * np.diff(ends)
                for d, own in found.items():
                    odds[a + d] += sum(value * (1 + math.log(n)) for value, n in own.values())
            scores = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    return plain.mapInArrow(run, f"{plain._jdf.schema().toDDL()}, score double")
