"""The queries of the training-data operators, one for each, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lodestone.llm import crf, hilbert, mixing, minhash, nndescent, pii, pieces, repetition, weak, ziplang
from lodestone.llm.common import pseudonym_key, read


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(read(spark, sf_dir, "documents"))


def op2_hilbert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.shard_hilbert(read(spark, sf_dir, "documents"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.query(read(spark, sf_dir, "documents"))


def op4_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_nndescent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.query(read(spark, sf_dir, "embeddings"))


def op6_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(read(spark, sf_dir, "documents"), pseudonym_key(spark))


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.query(read(spark, sf_dir, "documents"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(read(spark, sf_dir, "documents"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ziplang.query(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak.query(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_mixing, op2_hilbert, op3_repetition, op4_crf, op5_nndescent, op6_pseudonyms, op7_pieces, op8_minhash, op9_language, op10_toxicity)} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL = {"op1_mixing": mixing.ORACLE_SQL}
