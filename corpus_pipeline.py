"""The training-data pipeline over ``documents``: language ID, near duplicates, benchmark leaks, secrets, packing.

Every stage takes all documents that the one before kept and returns documents with the same columns; the last returns
the pieces of the packed sequences. Empty tables pass through; null texts have no language and go in the first stage; rows
without doc_id and rows with a repeated one are told apart by their text; further columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from photolake.llm import decontaminate, langid, ngram_join, packing, secrets
from photolake.llm.base import bounded, table, text_mark, written

#: Words whose ids a worker keeps in memory while it packs, beside what the stages before have left there.
KEPT_WORDS = 150_000


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the model's languages, with a posterior above the limit, stay."""
    verdict = langid.identify(langid.document_texts(docs.select(_identity().alias("doc_id"), "text", "lang", "source")))
    rejected = bounded(written(verdict.where("NOT accepted").select(F.col("id").alias("rejected")).distinct()))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _identity().alias("identity"))
    return rows.join(rejected, F.col("identity") == F.col("rejected"), "left_anti").select("row.*")


def _identity():
    """What a verdict on language depends on."""
    return F.struct(F.col("doc_id"), text_mark().alias("mark"), F.col("lang"), F.col("source"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return ngram_join.deduplicate(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, edited or not, go."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in them are replaced."""
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences."""
    return packing.pack(docs, keep=KEPT_WORDS)


STAGES = [
    ("language_id", identify_language),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_benchmark_leaks),
    ("secret_scan", redact_secrets),
    ("packing", pack),
]

#: Stages beyond SQL: text likelihoods, MinHash, alignment, tokenizers. Tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
