"""A corpus pipeline over ``documents``: quality rules, toxicity, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir), where docs is all that its predecessor kept. ``run`` writes every
stage's result as Parquet into the shared folder and reads it back for the next one. All stages but the
last return the columns of documents; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quakespark.llm import neardup, packing, pii, quality, toxicity
from quakespark.llm.common import table
from quakespark.llm.queries import vocabulary_file
from quakespark.session import materialise


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return quality.keep_quality(docs)


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.5 or more go; the network learns from the labelled rows of its input."""
    return toxicity.keep_harmless(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return neardup.keep_one(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind; n_chars follows the text."""
    from pyspark.sql import functions as F

    redacted = pii.redact(docs)
    if "n_chars" in redacted.columns:
        redacted = redacted.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return redacted


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Windows of at most 2048 tokens."""
    return packing.piece_digests(packing.pack(docs, vocabulary_file("word_bpe_49k.json")))


STAGES = [
    ("quality_rules", quality_rules),
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: The network, the sampling and the tokenizer have no SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
