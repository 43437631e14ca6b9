"""Corpus cleaning pipeline: each stage works on all that its predecessor kept.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that the runner writes as Parquet and reads back as the next
one's documents. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from siftwell.llm import bpe, decontaminate, near_copies, quality, substring
from siftwell.llm.common import read_table, written


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the compression bands reject go."""
    return quality.kept(docs)


def first_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash or its widened search, at a five-word similarity of 0.8 or more, the one with the smallest doc_id stays."""
    return near_copies.first_of_each(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of 20-word windows that start earlier in the corpus go; documents cut to fewer words than the quality rules ask for go.

    So do those of which more than half is benchmark before anything is cut: the next stage can't see benchmark words that go here as copies.
    """
    apart = decontaminate.covered(docs, read_table(spark, sf_dir, "benchmark"))
    return substring.cleaned(docs, min_words=quality.Bands().min_words, apart=apart)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words inside benchmark windows go; documents of which more than half is benchmark go."""
    return decontaminate.cleaned(docs, read_table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of what is left, with the digests of ids and decoded bytes."""
    vocabulary = bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digest(docs, vocabulary, public_tokenizers.PATTERN)


STAGES = [("quality_rules", rules), ("simhash", first_copies), ("substring", passages), ("decontaminate", leaks), ("byte_bpe", tokens)]

#: SQL has neither zstandard nor XXH64: the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
