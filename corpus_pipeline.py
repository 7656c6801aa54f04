"""A corpus through five operators: quality, toxicity, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a frame; all but the last return the columns of documents. Classifiers are fitted on the rows that
their stage gets, with the labels of ``sf_dir``. Rejected documents go; one document of each near-duplicate group stays; repeated passages are cut out of
texts; what is left is packed into sequences.

A stage returns a lazy frame that is to be computed with at most 1,000 texts in an Arrow batch, so a stage that is called on its own leaves the session with that
setting. ``run`` writes the result of every stage once to the folder that all executors share, reads it as the next one's input, and leaves the session as it was.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from eigenloom.llm.frames import small_batches, text_batches, written
from eigenloom.llm.packing import pack_documents
from eigenloom.llm.quality import fit_quality
from eigenloom.llm.simhash import keep_first
from eigenloom.llm.substring_dedup import strip_repeats
from eigenloom.llm.toxicity import fit_toxicity


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fit_quality(docs, _labels(spark, sf_dir)).accept(docs)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return fit_toxicity(docs, _labels(spark, sf_dir)).score(docs, reject=True)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return keep_first(docs)


def repeated_passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return strip_repeats(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), added=True)


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("repeated_passages", repeated_passage_stage),
    ("packing", packing_stage),
]
#: Classifiers, XXH64 and tokenizers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with text_batches(spark):
        for name, stage in STAGES:
            docs = written(stage(spark, docs, sf_dir), name)
    return docs
