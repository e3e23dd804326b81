"""The documents through five stages: quality, near-duplicates, pseudonyms, mixture, tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import minhash, mixing, pieces, pii, repetition
from lodestone.llm.common import pseudonym_key, read, stage


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return repetition.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return minhash.filter_documents(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal values are permuted within their formats."""
    return pii.pseudonymise(docs, pseudonym_key(spark), report=False)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the target weights ask."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each copy's number of tokens and the hashes of its ids and of the decoded text."""
    return pieces.pipeline_stage(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("pseudonyms", pseudonyms), ("mixture", mixture), ("tokens", tokens)]

#: Suffix arrays, minhashes and BPE are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage_of) in enumerate(STAGES):
        docs = stage_of(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, f"pipeline-{name}")
    return docs
