"""A corpus of documents made ready for training: filtered, deduplicated, redacted and packed.

Each stage takes what the one before has kept, written as Parquet and read again. All but the last
return the columns of ``documents``; the last returns a row for each piece of a packed sequence.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ratingloom.llm import packing, pii, quality, shingle_join, storage, suffix_dedup


def _ready(spark: SparkSession) -> None:
    """What every stage begins with: small Arrow batches, and a driver without what the stage before has left."""
    storage.small_batches(spark)
    storage.settled(spark)


def _measured(docs: DataFrame) -> DataFrame:
    """docs with n_chars as their texts are now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression classifier, learnt from the labels, doesn't reject."""
    _ready(spark)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.accepted(docs, model, 0.5)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that share 0.8 of their five-word shingles, the document of the smallest id."""
    _ready(spark)
    return shingle_join.one_of_each(docs, width=5, similarity=(4, 5))


def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 200 bytes and more that repeat."""
    _ready(spark)
    return _measured(suffix_dedup.without_repeats(docs, length=200))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind."""
    _ready(spark)
    return _measured(pii.redact(docs, pii.fit(docs)))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces with their places in sequences of at most 4096 tokens."""
    _ready(spark)
    cut = packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)
    return packing.pack(cut, capacity=4096)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("repeats", repeats_stage),
    ("pii", pii_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that all stages, in order, make of the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = storage.stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
