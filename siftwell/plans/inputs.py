"""The given tables in the roles of the data model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks; a source is a project."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("project"), "text", "lang")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stated query set: rows whose id is divisible by 100, with their whole text and their own vector."""
    asked = chunks(spark, sf_dir).where("chunk_id % 100 = 0")
    own = vectors(spark, sf_dir).where("chunk_id % 100 = 0")
    return asked.join(own, "chunk_id", "left").select(F.col("chunk_id").alias("query_id"), "project", F.col("text").alias("query_text"), F.col("embedding").alias("query_vector"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages: user and assistant turns, ids in (conversation, turn) order."""
    return table(spark, sf_dir, "conversations").where("role in ('user', 'assistant')").select(F.col("conv_id").alias("chat_id"), F.col("turn").alias("id"), "role", F.col("text").alias("content"))
