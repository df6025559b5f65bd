"""From raw documents to packed training sequences: language identification, near-duplicate removal, redaction of personal data, packing.

Each stage takes what its predecessor kept and returns the columns of ``documents``; the last returns the pieces of the sequences. Rows are written as Parquet and read
again between stages.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantloom.llm import jaccard, language, packing, private
from quantloom.llm.common import stored, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go: no letters, noise, or a language that no label names."""
    model = language.calibrated(docs, language.fit(docs))
    names = ("_lang_pred", "_lang_score", "_lang_coverage", "_lang_grams")
    return language.accepted(language.identify(docs, model, "text", *names), model, *names).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5 words, similarity 0.75) stays: the one with the smallest identifier, once."""
    return jaccard.deduplicated(docs).select(*docs.columns)


def redact_private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; every document stays."""
    found = private.find(docs, private.fit(docs)).withColumn("text", private.redact("text"))
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language", identify_language),
    ("near duplicates", drop_near_duplicates),
    ("private data", redact_private),
    ("packing", pack_sequences),
]

#: SQL can express none of the stages; tests run them beside brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
