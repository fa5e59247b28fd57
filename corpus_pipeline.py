"""The corpus pipeline: raw documents to a training mixture.

Every stage takes ``(spark, docs, sf_dir)`` and works on all rows the stage before it kept. All
but the last return the columns of documents; the last returns the mixture.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ringsight.llm.common import remove_stored, stored, stored_so_far, table
from ringsight.llm.decontaminate import decontaminated
from ringsight.llm.jaccard_join import one_per_class
from ringsight.llm.mixing import mix_sources
from ringsight.llm.personal_data import redact
from ringsight.llm.quality import resample


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling keeps."""
    return resample(docs, table(spark, sf_dir, "labels")).where("kept").select(*docs.columns)


def distinct_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    return one_per_class(docs)


def unseen_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a copied benchmark item."""
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def private_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return redact(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents drawn for training, with epoch and place."""
    return mix_sources(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", good_documents),
    ("ngram_jaccard_join", distinct_documents),
    ("benchmark_decontamination", unseen_documents),
    ("pii", private_documents),
    ("source_mixing", mixture),
]

# Importance weights, Jaccard verification and learned identifiers have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What the stages before stored on their way is removed as soon as a stage's own result is written."""
    docs, since = table(spark, sf_dir, "documents"), stored_so_far()
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs)
            remove_stored(spark, since)
    return docs
