"""Queries that apply the operators of this subpackage to the synthetic tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import fold, small_batches
from ._common import table as read
from .changes import apply_changes
from .chat import ROTATION_SQL, rotate_perspectives
from .language import fit_language_model, identify_languages, training_rows
from .licences import licences_sql, scan_licences
from .mixing import mix_sources, mixing_sql
from .neighbours import nearest_neighbours
from .packing import pack_documents
from .pieces import encode_documents
from .resampling import resample_to_target, resampling_sql
from .sharding import shard_documents
from .simhash import simhash_components
from .toxicity import fit_toxicity, score_toxicity
from .vectors import near_duplicate_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a job over texts."""
    if name == "documents":
        small_batches(spark)
    return read(spark, sf_dir, name)


@lru_cache
def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), n_shards=24)


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    scored = score_toxicity(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_language_model(training_rows(docs))
    named = identify_languages(docs.select("doc_id", "text"), model)
    return named.select(
        "doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", F.size("mixture").alias("n_languages")
    )


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"), words=3, radius=2)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"), capacity=2048)


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest_neighbours(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op9_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"), digests=True)


def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample_to_target(docs, target, least=1, most=1, buckets=10_000, percent=10, min_words=20, seed=2024)


def op12_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(table(spark, sf_dir, "documents"), weights=(3, 1, 2), percent=150, cap=2)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op13_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = apply_changes(table(spark, sf_dir, "client_changes"), batches=10, origin=19723, span=160, patience=8)
    cents = F.floor(100 * F.col("balance") + 0.5).cast("long").alias("cents")
    return made.select("change_id", "client_id", "status", "batch", "missed", "city", cents, "current")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_sharding, op2_embedding_dedup, op3_toxicity, op4_language, op5_simhash,
        op6_packing, op7_nearest, op8_chat, op9_pieces, op10_licences, op11_resampling, op12_mixing, op13_changes, pipeline,
    )
}

ORACLE_SQL: dict[str, str] = {"op8_chat": ROTATION_SQL, "op10_licences": licences_sql(), "op11_resampling": resampling_sql(), "op12_mixing": mixing_sql()}
