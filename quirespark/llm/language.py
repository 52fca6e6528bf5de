"""Language identification as mixture inference over n-gram likelihoods."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._chars import code_points, letters, slices
from ._common import fold, sliced

BUCKETS = 1 << 16


@dataclass(frozen=True)
class LanguageModel:
    """names: languages in order; log_p: log probability of each hashed trigram (bucket, language)."""

    names: tuple[str, ...]
    log_p: np.ndarray


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed letter trigrams of texts, with a boundary before and after each word.

    Returns the buckets, the position where each word's trigrams begin, and each word's text number.
    """
    joined = code_points("\x00".join(t or "" for t in texts) + "\x00")
    low = letters()[joined]
    inside = low > 0
    c = np.concatenate((np.zeros(1, np.uint32), low, np.zeros(1, np.uint32))).astype(np.uint64)
    h = c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) * np.uint64(31) + c[2:] * np.uint64(0xC2B2AE3D) * np.uint64(961)
    h ^= h >> np.uint64(23)
    buckets = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)).astype(np.int64)[inside]
    begins = inside & ~np.concatenate((np.zeros(1, bool), inside[:-1]))
    position = np.cumsum(inside)[begins] - 1
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    return buckets, position, np.searchsorted(ends, np.flatnonzero(begins), side="right")


def fit_language_model(docs: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Count trigrams by language over all rows of docs (text, lang) that have both.

    Each task adds up BUCKETS counters per language, so what is shuffled and what the driver gathers
    (BUCKETS x languages) does not grow with the input.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            texts = batch.column(0).to_pylist()
            for lang in set(langs):
                own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                total = seen.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for a, b in slices(own):
                    total += np.bincount(trigrams(own[a:b])[0], minlength=BUCKETS)
        for lang, total in seen.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(total[at], pa.int64())],
                names=["lang", "bucket", "n"],
            )

    rows = (
        docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select("text", "lang")
        .mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket")
        .agg(F.sum("n").alias("n"))
        .toPandas()
    )
    names = tuple(sorted(rows["lang"].unique()))
    table = np.full((BUCKETS, len(names)), smoothing)
    for j, name in enumerate(names):
        own = rows[rows["lang"] == name]
        table[own["bucket"].to_numpy(), j] += own["n"].to_numpy()
    return LanguageModel(names, np.log(table / table.sum(axis=0)).astype(np.float32) if names else table.astype(np.float32))


def mixture(word_ll: np.ndarray, begins: np.ndarray, rounds: int = 8, penalty: float = 1.0) -> np.ndarray:
    """Language proportions of documents whose words have the log likelihoods word_ll (word, language).

    begins: the first word of each document (each has one at least). Expectation-maximisation over all
    languages ranks them; nested sets of the best 1, 2, ... languages are then refitted for a few
    rounds and the set of the highest log likelihood less penalty/2 * (set size) * log(words) is kept,
    the smaller one on a tie. Returns (document, language), rows adding up to 1.
    """
    n_docs, n_lang = len(begins), word_ll.shape[1]
    count = np.diff(np.append(begins, len(word_ll)))
    owner = np.repeat(np.arange(n_docs), count)
    top = word_ll.max(axis=1, keepdims=True)
    like = np.exp(word_ll - top)
    top_sum = np.add.reduceat(top[:, 0].astype(np.float64), begins)

    def em(theta: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        for _ in range(steps):
            resp = like * theta[owner]
            resp /= np.maximum(resp.sum(axis=1, keepdims=True), 1e-30)
            theta = np.add.reduceat(resp, begins, axis=0) / count[:, None]
        fit = np.log(np.maximum((like * theta[owner]).sum(axis=1), 1e-30)).astype(np.float64)
        return theta, np.add.reduceat(fit, begins) + top_sum

    full, _ = em(np.full((n_docs, n_lang), 1 / n_lang, dtype=np.float32), rounds)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.zeros((n_docs, n_lang))
    score = np.full(n_docs, -np.inf)
    for size in range(1, n_lang + 1):
        theta = np.zeros_like(full)
        np.put_along_axis(theta, order[:, :size], np.take_along_axis(full, order[:, :size], 1) + 1e-3, 1)
        theta /= theta.sum(axis=1, keepdims=True)
        theta, fit = em(theta, 0 if size == 1 else 3)
        gain = fit - penalty * 0.5 * size * np.log(count + 1.0)
        better = gain > score
        best[better], score[better] = theta[better], gain[better]
    return best


def identify_languages(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """Add lang_pred, score and mixture to all rows of docs (doc_id, text, ...).

    A word's likelihood under a language is the product of its letter trigrams' probabilities. score
    is the chosen language's estimated proportion of the words; mixture maps each selected language to
    its proportion. lang_pred is ``und`` with score 0 if text is null, empty or without letters, or if
    the model has no language. Ties go to the first name in order. Other columns pass through, except
    that columns named like the new ones, in any case, are replaced.
    """
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "mixture")]
    plain = docs.select(kept)
    schema = f"{plain._jdf.schema().toDDL()}, lang_pred string, score double, mixture map<string,double>"
    at = kept.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = model.names
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            pred: list[str] = ["und"] * len(texts)
            score = np.zeros(len(texts))
            mixes: list[list[tuple[str, float]]] = [[] for _ in texts]
            for a, b in slices(texts) if names else ():
                buckets, position, owner = trigrams(texts[a:b])
                if not len(position):
                    continue
                word_ll = np.add.reduceat(model.log_p[buckets], position, axis=0)
                begins = np.flatnonzero(np.concatenate((np.ones(1, bool), owner[1:] != owner[:-1])))
                theta = mixture(word_ll, begins)
                first = theta.argmax(axis=1)
                for row, i in enumerate((owner[begins] + a).tolist()):
                    pred[i], score[i] = names[first[row]], min(1.0, theta[row, first[row]])
                    mixes[i] = [(names[j], float(theta[row, j])) for j in np.flatnonzero(theta[row])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(mixes, pa.map_(pa.string(), pa.float64()))],
                names=[*batch.schema.names, "lang_pred", "score", "mixture"],
            )

    return plain.mapInArrow(predict, schema)


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows of docs to learn from: crc32(doc_id as text) mod 3 is not 1."""
    return docs.where(fold("doc_id", 3) != 1)
