"""The corpus pipeline: quality classifier, toxicity, near-duplicates, packing. Each stage works on all its predecessor kept.

``STAGES`` lists ``(name, function)``; a function takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and
read again as the next one's ``docs``. All but the last return the columns of ``docs``, extra ones included. The classifiers learn from
``labels`` and the ``documents`` they belong to, outside the held-out fifth of ids. Rows with a NULL or empty text are scored like any
other; rows with a NULL id are near-duplicates of nothing and stay; rows that repeat an id stay or go together. Empty tables pass through
every stage: without labels the classifiers keep every document.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tabloom.llm import minhash, packing, quality, toxicity
from tabloom.llm.common import written

QUALITY_LEAST, TOXICITY_LEAST = 0.3, 0.5


def _labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.3 or more."""
    return docs.where(quality.fit_quality(*_labelled(spark, sf_dir)).score(F.col("text")) >= QUALITY_LEAST)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.5."""
    return docs.where(toxicity.fit_toxicity(*_labelled(spark, sf_dir)).score(F.col("text")) < TOXICITY_LEAST)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles, similarity 0.8 or more)."""
    groups = minhash.near_duplicates(docs, "doc_id", "text", percent=80)
    gone = groups.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == F.col("gone"), "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2,048 tokens: ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset)``."""
    pieces = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("packing", pack)]

# trained models and tokenisers are not expressible in SQL; tests/llm compares the stages with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = written(docs, name)
    return docs
