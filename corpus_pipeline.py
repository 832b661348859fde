"""The corpus pipeline: quality, toxicity, near duplicates, decontamination, packing.

Each stage takes all rows that the one before kept, as ``(spark, docs, sf_dir)``; all but the last return the
columns of ``documents``. The caller writes a stage's rows as Parquet and reads them again.
"""

from __future__ import annotations

import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sourceloom.llm import decontamination, ngram_join, packing, quality_classifier, toxicity  # noqa: E402
from sourceloom.llm.common import settle, table  # noqa: E402


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose quality score reaches 0.3."""
    scored = quality_classifier.judged(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 1").select(*docs.columns)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows whose toxicity score is below 0.7."""
    scored = toxicity.judged(docs, table(spark, sf_dir, "labels"))
    return scored.where("predicted = 0").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of texts linked by 0.8 of their five-word shingles: the smallest id."""
    return ngram_join.representatives(docs, ngram_join.Settings(words=5, num=80, den=100))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps rows without a passage of the benchmark."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the kept documents with their sequences and places."""
    return packing.packed(settle(packing.pieces(docs)))


STAGES = [
    ("quality_classifier", quality),
    ("toxicity", toxic),
    ("ngram_join", near_duplicates),
    ("decontamination", benchmark),
    ("packing", pack),
]

#: Trained models, token ids and best fit are not SQL; tests/llm compares the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
