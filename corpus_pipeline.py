"""A corpus pipeline of four stages: language ID, toxicity, SimHash near-dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirespark.llm._common import materialize, small_batches, table
from quirespark.llm.language import fit_language_model, identify_languages, training_rows
from quirespark.llm.packing import pack_documents
from quirespark.llm.queries import tokenizer_file
from quirespark.llm.simhash import keep_representatives
from quirespark.llm.toxicity import fit_toxicity, score_toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
TOXIC_AT = 0.3


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents in which a language is found; null texts and texts without letters go."""
    small_batches(spark)
    model = fit_language_model(training_rows(docs))
    return identify_languages(docs.select(*COLUMNS), model).where("lang_pred <> 'und'").select(*COLUMNS)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that score below TOXIC_AT."""
    small_batches(spark)
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs.select(*COLUMNS), model).where(F.col("score") < TOXIC_AT).select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each SimHash component: the one of smallest doc_id (null ids last), and one of its
    repeated rows."""
    small_batches(spark)
    return keep_representatives(docs.select(*COLUMNS))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens: one row per piece."""
    small_batches(spark)
    return pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("simhash_dedup", dedup_stage),
    ("packing", packing_stage),
]

#: Learned models and packing are not SQL; tests hold run() against a plain version on a small fixture.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each stage returns is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
