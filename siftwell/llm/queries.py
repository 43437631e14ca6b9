"""The registered queries of the training-data operators, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, centroids, decontaminate, language, lattice, merkle, mixing, quality, resample, shards, simhash, substring, token_files
from .common import read_table
from .oracle import ORACLE_SQL  # noqa: F401


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(read_table(spark, sf_dir, "documents"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary = bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digest(read_table(spark, sf_dir, "documents"), vocabulary, public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.digest(read_table(spark, sf_dir, "documents"))


def op3_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resampled(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op4_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(read_table(spark, sf_dir, "documents"))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.held_out_prediction(read_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.written_and_read(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.held_out_scores(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.sharded(read_table(spark, sf_dir, "documents"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.digest(read_table(spark, sf_dir, "embeddings")).drop("scans")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(read_table(spark, sf_dir, "documents"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.digest(read_table(spark, sf_dir, "documents"))


_ALL = (
    op1_byte_bpe, op2_simhash, op3_importance_resampling, op4_substring, op5_decontaminate, op6_quality_rules, op7_token_files,
    op8_language_id, op9_subword_lattice, op10_balanced_shards, op11_centroid_clustering, op12_merkle_manifest, op13_source_mixing,
)
QUERIES = {f.__name__: f for f in _ALL}
