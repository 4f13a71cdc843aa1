"""Corpus pipeline: documents in, packed token sequences out.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and reread as the next one's docs. All but
the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textsim.llm import mixing, ngram_join, packing, secret_forest, toxicity_pu
from textsim.llm.words import apart
from textsim.session import ensure_checkpoint_dir
from textsim.sources.tables import load

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the operator's threshold; it learns from all labels."""
    labels = load(spark, sf_dir, "labels", "doc_id", "toxic")
    return apart(docs, ("doc_id", "text"), lambda d: toxicity_pu.toxicity(d, labels).where(
        F.col("score") < toxicity_pu.TOXIC_AT).drop("score"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: five-word shingles, Jaccard 0.8 or more."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret in a text replaced; n_chars follows the text."""
    def hide(d: DataFrame) -> DataFrame:
        changed = F.length("text") != F.col("length before")
        return secret_forest.redact(d.withColumn("length before", F.length("text"))).withColumn(
            "n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).drop("length before")
    return apart(docs, ("text", "n_chars"), hide)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all packed sequences with their token ids."""
    return packing.pack(docs).select("sequence_id", "offset", "doc_id", "start", "length", "doc_tokens", "ids",
                                     F.crc32("ids").alias("ids_crc32"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_copies),
    ("secrets", hide_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned classifiers and a tokenizer are beyond SQL; tests/llm/test_pipeline.py checks every stage by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        path = f"{base}/{i}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
