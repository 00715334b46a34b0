"""Corpus pipeline: stages of training-data operators over ``documents``.

Each stage takes what the one before kept and returns the columns of ``documents``; the
last returns, for each document, what the mix takes of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lexiquarry.llm import decontaminate, mixing, ngram_join, quality, secret_scan
from lexiquarry.llm.common import materialise, release


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go."""
    return quality.keep_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five words, similarity 0.8)."""
    return ngram_join.keep_firsts(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Found secrets are replaced in the text; the documents stay."""
    return secret_scan.redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, with its text."""
    return mixing.mix_sources(docs, keep=("source", "lang", "text"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("n-gram Jaccard join", ngram_jaccard),
    ("benchmark decontamination", benchmark_decontamination),
    ("secret scans", secret_scans),
    ("mixing sources", source_mix),
]

#: Classifier and automata are trained models; SQL can't express them.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; what each keeps is written and read again.

    The result has a row ``(doc_id, size, source_size, target, taken, source, lang, text)``
    for every document kept. Null and empty texts are judged by the classifier, match
    nothing else and give no words; rows without a doc_id pass the stages that tell
    documents apart by it; of repeated rows one stays. Ties are settled as the operators
    say. Long texts go through whole. Empty tables give an empty result; without labels all
    documents have the same evidence, without a benchmark none is contaminated.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        kept = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            kept = materialise(kept)
            if i:
                release(docs)  # what the stage before wrote has been read for the last time
        docs = kept
    return docs
