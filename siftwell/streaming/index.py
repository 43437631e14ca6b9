"""The index kept up by passes: each takes the projects that asked, reconciles them with their folders and indexes what is pending.

The state is a folder: ``files/version=N`` has a row per file after pass N, ``contents/batch=N`` the chunks and
vectors of contents first met in pass N, ``ledger/batch=N`` a row per such content. A pass lists sizes and times; only files that these make suspect are
read and hashed, once. Contents are kept by their hash, so a copy, a
moved file or one whose time alone changed is not embedded again, and replacing a file's chunks moves its hash only. A pass
reads what passes before it wrote and overwrites its own, so one that is repeated after a failure gives the same state.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as X
from ..operators.attribution import hash_embed
from ..operators.passages import CHUNK_TOKENS, OVERLAP_TOKENS, TEXTS, chunk_text, word_spans
from ..sources import versions as V

FILES = "project string, rel_path string, size long, mtime double, hash string, status string, error string"
CONTENTS = "hash string, ord int, text string, line_start int, line_end int, vector array<float>, error string"
LEDGER = "hash string, n_chunks int, error string"
KEY = ["project", "rel_path"]

Embedder = Callable[[list[str]], np.ndarray]


def embedded_chunks(texts: DataFrame, make: Callable[[], Embedder] | None = None, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS) -> DataFrame:
    """Chunks with vectors of ``texts`` (hash, text). A text without chunks gives one row without ``ord``, one that fails such a row with ``error``."""

    def rows(digest: str, text: str | None, model: Embedder) -> list[tuple]:
        try:
            found = chunk_text(text or "", limit, overlap, word_spans)
            vectors = model([c["text"] for c in found]) if found else []
            return [(digest, k, c["text"], c["line_start"], c["line_end"], v, None) for k, (c, v) in enumerate(zip(found, vectors, strict=True))] or [(digest, *[None] * 6)]
        except Exception as e:  # one bad file must not stop the others
            return [(digest, *[None] * 5, f"{type(e).__name__}: {e}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make() if make else hash_embed
        names = [part.split()[0] for part in CONTENTS.split(", ")]
        for frame in frames:
            for at in range(0, len(frame), TEXTS):  # vectors of few texts are held at once
                out = [r for digest, text in zip(frame.hash[at : at + TEXTS], frame.text[at : at + TEXTS], strict=True) for r in rows(digest, text, model)]
                yield pd.DataFrame(out, columns=names, dtype=object)

    return texts.select("hash", "text").mapInPandas(run, CONTENTS)


def files_after(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """The files after pass ``batch_id``; none before the first."""
    return spark.read.schema(FILES).parquet(f"{state}/files/version={batch_id}") if batch_id >= 0 else spark.createDataFrame([], FILES)


def chunks_after(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """``project, rel_path, hash, ord, text, line_start, line_end, vector`` of the indexed files after pass ``batch_id``."""
    parts = spark.read.schema(f"{CONTENTS}, batch long").parquet(f"{state}/contents").where((F.col("batch") <= batch_id) & F.col("ord").isNotNull())
    return files_after(spark, state, batch_id).where("status = 'indexed'").select(*KEY, "hash").join(parts.drop("batch", "error"), "hash").select(*KEY, "hash", "ord", "text", "line_start", "line_end", "vector")


def clean(spark: SparkSession, state: str, batch_id: int) -> int:
    """Gives up contents that no file has after pass ``batch_id``, and what served that pass and those before it alone; the number of contents given up.

    The contents still in use become those of batch ``batch_id``, in parts of their own that replace the older ones. Later passes embed a
    content that comes back as a new one. Call it between passes; readers of earlier versions are gone by then.
    """
    used = files_after(spark, state, batch_id).where("status = 'indexed'").select("hash").distinct()
    contents = spark.read.schema(f"{CONTENTS}, batch long").parquet(f"{state}/contents").drop("batch")
    ledger = spark.read.schema(f"{LEDGER}, batch long").parquet(f"{state}/ledger").drop("batch")
    dead = ledger.join(used, "hash", "left_anti").count()
    for name, rows in (("contents", contents), ("ledger", ledger)):
        rows.join(used, "hash", "left_semi").write.mode("overwrite").parquet(f"{state}/kept-{name}/batch={batch_id}")
    files, _ = V._files(spark, state)
    path = spark._jvm.org.apache.hadoop.fs.Path
    for name in ("contents", "ledger"):  # the old ones stay aside until the new ones are there
        files.rename(path(f"{state}/{name}"), path(f"{state}/old-{name}"))
        files.rename(path(f"{state}/kept-{name}"), path(f"{state}/{name}"))
    for name in ("old-contents", "old-ledger", "read", "decided"):
        files.delete(path(f"{state}/{name}"), True)
    for old in V._names(spark, f"{state}/files"):
        if old.startswith("version=") and int(old.split("=")[1]) < batch_id:
            files.delete(path(f"{state}/files/{old}"), True)
    return dead


def _ledger(spark: SparkSession, state: str, batch_id: int) -> DataFrame:
    """Contents known before pass ``batch_id`` without an error."""
    if batch_id == 0:
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(f"{LEDGER}, batch long").parquet(f"{state}/ledger").where((F.col("batch") < batch_id) & F.col("error").isNull()).drop("batch")


def suspects(files: DataFrame, listing: DataFrame) -> DataFrame:
    """``project, rel_path`` of the listed files whose contents have to be looked at: new ones, other sizes or times, and those that no pass has finished."""
    known = files.select(*KEY, F.struct("size", "mtime", "status").alias("f"))
    same = F.struct("f.size", "f.mtime").eqNullSafe(F.struct("size", "mtime")) & ~F.col("f.status").isin("indexing", "pending")
    return listing.join(known, KEY, "left").where(F.col("f").isNull() | ~same).select(*KEY)


def index_pass(state: str, batch_id: int, notices: DataFrame, listing: DataFrame, read: Callable[[DataFrame], DataFrame], failed: DataFrame, make: Callable[[], Embedder] | None = None) -> None:
    """Pass ``batch_id`` (0, 1, ...) for the projects of ``notices`` (project); repeats of a notice count once.

    ``listing`` (project, rel_path, size, mtime) is what the folders hold now. ``read`` gives the contents (project, rel_path, text, error) of the files it
    is asked for (project, rel_path), with the reason where one could not be read; it is asked for the suspects, once. ``failed`` (project, place) are places that could not be listed: what was known under them stays. A null text is an
    empty one. Files that an earlier pass left as ``indexing`` or ``pending`` are indexed again. Other projects stay as they are.
    """
    spark = notices.sparkSession
    asked = notices.select("project").distinct()
    before = files_after(spark, state, batch_id - 1)
    mine = before.join(asked, "project", "left_semi")
    listed = listing.join(asked, "project", "left_semi")
    found = read(suspects(mine, listed)).select(*KEY, F.coalesce("text", F.lit("")).alias("text"), "error").withColumn("hash", X.content_hash(F.col("text")))
    found.write.mode("overwrite").parquet(f"{state}/read/batch={batch_id}")  # as they were when they were hashed
    contents = spark.read.schema("project string, rel_path string, text string, error string, hash string").parquet(f"{state}/read/batch={batch_id}")
    there = listed.join(contents.select(*KEY, "hash", "error"), KEY, "left")

    actions = X.reconcile(mine, there.select(*KEY, "size", "mtime", "hash"), failed).where("action <> 'delete'")
    known = mine.select(*KEY, F.struct("size", "mtime", "hash", "status", "error").alias("f"))
    seen = there.select(*KEY, F.struct("size", "mtime", "hash", "error").alias("d"))
    current = actions.join(known, KEY, "left").join(seen, KEY, "left")
    waiting = F.col("action").isin("add", "requeue") | (F.col("f.status").eqNullSafe("pending") & F.col("d").isNotNull())
    moved = waiting | (F.col("action") == "touch")
    decided = current.select(
        *KEY,
        *(F.when(moved, F.col(f"d.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("size", "mtime")),
        *(F.when(waiting, F.col(f"d.{c}")).otherwise(F.col(f"f.{c}")).alias(c) for c in ("hash", "error")),
        F.when(waiting, "indexing").otherwise(F.col("f.status")).alias("status"),
        waiting.alias("waiting"),
    )
    decided.write.mode("overwrite").parquet(f"{state}/decided/batch={batch_id}")
    decided = spark.read.schema(f"{FILES}, waiting boolean").parquet(f"{state}/decided/batch={batch_id}")

    todo = decided.where("waiting")
    readable = todo.where(F.col("error").isNull() & (F.col("size") <= X.MAX_BYTES))
    earlier = _ledger(spark, state, batch_id)
    # one place of each content that is new: no text is read twice, and copies meet as hashes only
    places = readable.groupBy("hash").agg(F.min(F.struct(*KEY)).alias("at")).join(earlier, "hash", "left_anti").select("at.*")
    embedded_chunks(contents.join(places, KEY, "left_semi"), make).write.mode("overwrite").parquet(f"{state}/contents/batch={batch_id}")
    new = spark.read.schema(CONTENTS).parquet(f"{state}/contents/batch={batch_id}")
    new.groupBy("hash").agg(F.count("ord").cast("int").alias("n_chunks"), F.max("error").alias("error")).write.mode("overwrite").parquet(f"{state}/ledger/batch={batch_id}")

    ledger = earlier.unionByName(spark.read.schema(LEDGER).parquet(f"{state}/ledger/batch={batch_id}")).withColumnRenamed("error", "said")
    parsed = todo.join(ledger, "hash", "left").select(F.struct(*KEY, "size", "mtime").alias("id"), "size", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), F.coalesce("error", "said").alias("error"), F.lit(None).cast("string").alias("note"), "hash")
    done = X.index_disposition(parsed).select("id.*", F.col("content_hash").alias("hash"), "status", "error")
    after = before.join(asked, "project", "left_anti").unionByName(decided.where("not waiting").drop("waiting")).unionByName(done)
    after.write.mode("overwrite").parquet(f"{state}/files/version={batch_id}")
