"""Versioned tables: readers see one version whole, writers publish the next by one small file.

A table is a folder. ``data/`` holds parts, each a folder of Parquet files for some buckets of the key; ``manifest/`` holds a file per version, which names
the live part of each bucket. A version is committed by creating its file where none may be: of two writers that start from one version the second
fails and has to start again. Parts are never changed, so a reader that has opened a version keeps it, whatever is committed meanwhile; what no
recent version names is removed by ``vacuum``. The folder may be on any file system that Spark writes to.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets of a table's key: a swap rewrites those that it touches.
BUCKETS = 64


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _manifest(table: str, version: int) -> str:
    return f"{table}/manifest/{version:010d}.json"


def versions(spark: SparkSession, table: str) -> list[int]:
    return sorted(int(n.split(".")[0]) for n in _names(spark, f"{table}/manifest") if n.endswith(".json") and n.split(".")[0].isdigit())


def live(spark: SparkSession, table: str, version: int | None = None) -> tuple[int, dict[int, str]]:
    """The newest version, or that one, and the part of each of its buckets; -1 and no parts before the first.

    A manifest that another writer is still writing isn't there yet.
    """
    for v in reversed(versions(spark, table)) if version is None else [version]:
        files, path = _files(spark, _manifest(table, v))
        stream = files.open(path)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        try:
            return v, {int(k): part for k, part in json.loads(text).items()}
        except ValueError:
            if version is not None:
                raise
    return -1, {}


def commit(spark: SparkSession, table: str, base: int, parts: dict[int, str]) -> int:
    """Publishes ``parts`` as the version after ``base``, unless another writer has published one since."""
    files, path = _files(spark, _manifest(table, base + 1))
    try:
        stream = files.create(path, False)
    except Py4JJavaError as e:
        if "exist" in str(e.java_exception).lower():
            raise Conflict(f"version {base + 1} of {table} is there") from e
        raise
    try:
        stream.write(bytearray(json.dumps(parts, sort_keys=True).encode()))
    finally:
        stream.close()
    return base + 1


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def _write(rows: DataFrame, table: str, key: str) -> str:
    """``rows`` as a new part; a bucket with many keys is spread over tasks."""
    part = f"data/{uuid.uuid4().hex}"
    spread = F.pmod(F.xxhash64(key, F.lit("spread")), F.lit(4))
    rows.withColumn("bucket", bucket_of(key)).repartition(F.col("bucket"), spread).write.partitionBy("bucket").parquet(f"{table}/{part}")
    return part


def read(spark: SparkSession, table: str, schema: str, version: int | None = None) -> DataFrame:
    """The rows of the newest version, or of that one, as they are now and stay."""
    return _read(spark, table, schema, live(spark, table, version)[1])


def _read(spark: SparkSession, table: str, schema: str, parts: dict[int, str]) -> DataFrame:
    folders = [f"{table}/{part}/bucket={bucket}" for bucket, part in sorted(parts.items()) if part]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _parts(spark: SparkSession, table: str, part: str, buckets: list[int]) -> dict[int, str]:
    """Of ``buckets``, those that the part has rows of; the others are empty now."""
    there = {int(n.split("=")[1]) for n in _names(spark, f"{table}/{part}") if n.startswith("bucket=")}
    return {b: part if b in there else "" for b in buckets}


def replace(table: str, rows: DataFrame, key: str) -> int:
    """All of the table is ``rows`` in the next version."""
    spark = rows.sparkSession
    base, _ = live(spark, table)
    return commit(spark, table, base, _parts(spark, table, _write(rows, table, key), list(range(BUCKETS))))


def swap(table: str, new: DataFrame, keys: DataFrame, key: str, schema: str) -> int:
    """The next version: rows of ``keys`` (key) are those in ``new``, others stay. Only the buckets of those keys are read and written."""
    spark = new.sparkSession
    base, parts = live(spark, table)
    touched = sorted(r[0] for r in keys.select(bucket_of(key).alias("b")).distinct().collect())  # BUCKETS numbers at most
    old = _read(spark, table, schema, {b: p for b, p in parts.items() if b in set(touched)})
    names = [f.name for f in old.schema]
    after = old.join(keys.select(key).distinct(), key, "left_anti").select(names).unionByName(new.join(keys.select(key).distinct(), key, "left_semi").select(names))
    return commit(spark, table, base, parts | _parts(spark, table, _write(after, table, key), touched))


def vacuum(spark: SparkSession, table: str, keep: int = 2) -> list[str]:
    """Removes manifests but the newest ``keep``, and the parts that none of these names; gives the parts' names.

    Parts of a writer at work are named by none yet: call it when no swap is running.
    """
    kept = versions(spark, table)[-keep:]
    used = {part for v in kept for part in live(spark, table, v)[1].values()}
    dead = [f"data/{n}" for n in _names(spark, f"{table}/data") if f"data/{n}" not in used]
    for name in [*(_manifest("", v)[1:] for v in versions(spark, table) if v not in kept), *dead]:
        files, path = _files(spark, f"{table}/{name}")
        files.delete(path, True)
    return dead
