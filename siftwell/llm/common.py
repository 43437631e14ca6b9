"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.shared import shared_folder

#: Bytes that separate words in the contracts: space, \t, \n, \v, \f, \r. ``bytes.split()`` uses the same set.
SPACES = b" \t\n\x0b\x0c\r"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back: a lineage cut that outlives executors."""
    spark = df.sparkSession
    path = shared_folder(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(nullable(df.schema)).parquet(path)


def nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def in_tasks(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """``df.mapInArrow(run, schema)`` whose Python workers, which Spark keeps for later tasks, hand back memory after each task."""

    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            release_memory()

    return df.mapInArrow(tidy, schema)


def release_memory() -> None:
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def id_bucket(buckets: int, column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo ``buckets``; null ids count as bucket 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % buckets, F.lit(0))


def text_bytes(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def long_ids(docs: DataFrame) -> DataFrame:
    """``docs`` with a long ``doc_id``; as it is where it has one, so that equal reads of it stay equal for Spark to reuse."""
    return docs if docs.schema["doc_id"].dataType == T.LongType() else docs.withColumn("doc_id", F.col("doc_id").cast("long"))


def slices(batches: Iterator[pa.RecordBatch], most: int = 6 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Batches cut so that each has about ``most`` bytes of text (one text may have more)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_pylist()
        start = total = 0
        for at, size in enumerate(sizes):
            if total and total + size > most:
                yield batch.slice(start, at - start)
                start, total = at, 0
            total += size
        if len(sizes) > start:
            yield batch.slice(start)


def gathered(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Batches put together to ``rows`` rows or more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def ranked(df: DataFrame, order: list[Column], label: str) -> DataFrame:
    """``df`` with ``rank``: 0-based position in the global order, found without a one-task sort.

    Rows are range-partitioned and sorted once and written; each row keeps (partition, place in it) from
    ``monotonically_increasing_id``. The sizes of the partitions, a row per task, give each its offset.
    Rows equal in every order column get distinct ranks in no stated order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id())
    table = written(placed, label).withColumn("_part", F.shiftright("_at", 33))
    sizes = table.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).collect()  # one row per task
    offset, offsets = 0, {}
    for r in sorted(sizes):
        offsets[r["_part"]] = offset
        offset += r["_n"]
    starts = spark.createDataFrame(list(offsets.items()), "_part long, _start long")
    return (
        table.join(F.broadcast(starts), "_part")
        .withColumn("rank", F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_at", "_part", "_start")
    )


def with_length(docs: DataFrame) -> DataFrame:
    """``docs`` whose ``n_chars``, where there is such a column, is the length of ``text``."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs
