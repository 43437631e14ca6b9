"""Folders and the index in step: reconcile listings, queues, states and overviews of files and projects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import ascii_fold

# Fixed values of the data model.
STATUSES = ["pending", "indexing", "indexed", "failed", "skipped"]
MAX_BYTES = 200 * 1024 * 1024
TOO_LARGE, NO_TEXT = "file too large (over 200 MB)", "no text found"


def protect_unreadable(known: DataFrame, failed: DataFrame) -> DataFrame:
    """Known paths (project, rel_path) that are not at or under a failed place (project, place); "." protects a whole project.

    A path is compared with its own ancestors by equality, so the join is on (project, place), not on every pair.
    """
    parts = F.split("rel_path", "/")
    ancestors = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    under = known.select("project", "rel_path", F.explode(F.array_append(ancestors, F.lit("."))).alias("place")).join(failed, ["project", "place"], "left_semi")
    return known.join(under.select("project", "rel_path").distinct(), ["project", "rel_path"], "left_anti")


def reconcile(files: DataFrame, disk: DataFrame, failed: DataFrame) -> DataFrame:
    """``project, rel_path, action``: add, delete, requeue, touch or keep, for each path of table or disk.

    Both sides are (project, rel_path, size, mtime, hash), files with status as well. The disk's hash is looked at only where
    size or time differ and the table has a hash. Paths gone from disk under an unreadable place are kept.
    """
    a = files.select("project", "rel_path", F.struct("size", "mtime", "hash", "status").alias("f"))
    b = disk.select("project", "rel_path", F.struct("size", "mtime", "hash").alias("d"))
    both = a.join(b, ["project", "rel_path"], "full_outer")
    gone = protect_unreadable(both.where("d is null").select("project", "rel_path"), failed).withColumn("gone", F.lit(True))
    differ = ~F.struct("f.size", "f.mtime").eqNullSafe(F.struct("d.size", "d.mtime"))
    action = (
        F.when(F.col("f").isNull(), "add")
        .when(F.col("d").isNull(), F.when(F.col("gone"), "delete").otherwise("keep"))
        .when(F.col("f.status") == "indexing", "requeue")
        .when(differ & (F.col("f.hash").isNull() | ~F.col("f.hash").eqNullSafe(F.col("d.hash"))), "requeue")
        .when(differ, "touch")
        .otherwise("keep")
    )
    return both.join(gone, ["project", "rel_path"], "left").select("project", "rel_path", action.alias("action"))


def stale_files(files: DataFrame, disk: DataFrame) -> DataFrame:
    """Paths of one side only: ``side`` is table or disk."""
    key = ["project", "rel_path"]
    return files.select(key).join(disk, key, "left_anti").withColumn("side", F.lit("table")).unionByName(disk.select(key).join(files, key, "left_anti").withColumn("side", F.lit("disk")))


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def index_disposition(files: DataFrame) -> DataFrame:
    """``id, status, error, keeps_chunks, content_hash`` after parsing rows (id, size, n_chunks, error, note, hash)."""
    status = F.when(F.col("size") > MAX_BYTES, "skipped").when(F.col("error").isNotNull(), "failed").when(F.col("n_chunks") == 0, "skipped").otherwise("indexed")
    said = F.when(F.col("size") > MAX_BYTES, TOO_LARGE).when(F.col("error").isNotNull(), F.col("error")).when(F.col("n_chunks") == 0, F.coalesce("note", F.lit(NO_TEXT))).otherwise(F.col("note"))
    return files.select("id", status.alias("status"), said.alias("error"), (status == "indexed").alias("keeps_chunks"), F.when(status == "indexed", F.col("hash")).alias("content_hash"))


def pending_queue(files: DataFrame, projects: DataFrame, model: str, blocked: DataFrame) -> DataFrame:
    """Pending files of projects with the current model that are not blocked; read in the order of ``id``."""
    current = projects.where(F.col("model") == model).select("project").join(blocked, "project", "left_anti")
    return files.where("status = 'pending'").join(current, "project", "left_semi")


def searchable_projects(projects: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """``project, searchable, stale``: an indexed file and the current model; an indexed file and another model."""
    indexed = files.where("status = 'indexed'").select("project").distinct().withColumn("has", F.lit(True))
    current = F.col("model") == model
    return projects.join(indexed, "project", "left").select("project", (current & F.col("has").isNotNull()).alias("searchable"), (~current & F.col("has").isNotNull()).alias("stale"))


def status_counts(projects: DataFrame, files: DataFrame) -> DataFrame:
    """Files per status; every status has a column, and every project a row."""
    counts = files.groupBy("project").pivot("status", STATUSES).count()
    return projects.select("project").join(counts, "project", "left").na.fill(0, STATUSES)


def project_overview(projects: DataFrame, files: DataFrame, model: str) -> DataFrame:
    """``name, indexed_files, stale``; read in the order of the folded name."""
    counts = status_counts(projects, files).select("project", F.col("indexed").alias("indexed_files"))
    return projects.join(counts, "project").select(F.col("project").alias("name"), "indexed_files", (F.col("model") != model).alias("stale"))


def problem_files(files: DataFrame, k: int = 50) -> DataFrame:
    """The first ``k`` files of each project, by path, that have an error or note."""
    return files.where("error is not null").withColumn("n", F.row_number().over(Window.partitionBy("project").orderBy("rel_path"))).where(F.col("n") <= k)


def changed_sources(sources: DataFrame, files: DataFrame, disk: DataFrame) -> DataFrame:
    """Saved sources (source_id, file_id, kind, hash) with ``changed``: no file, row gone, hash, size or time differ; notes never change."""
    now = files.select(F.col("id").alias("file_id"), "project", "rel_path", F.col("hash").alias("now_hash"), F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"), F.lit(True).alias("there"))
    there = disk.select("project", "rel_path", F.col("size").alias("disk_size"), F.col("mtime").alias("disk_mtime"))
    joined = sources.join(now, "file_id", "left").join(there, ["project", "rel_path"], "left")
    differs = F.col("file_id").isNull() | F.col("there").isNull() | ~F.col("now_hash").eqNullSafe(F.col("hash")) | ~F.col("now_size").eqNullSafe(F.col("disk_size")) | ~F.col("now_mtime").eqNullSafe(F.col("disk_mtime"))
    return joined.select("source_id", ((F.col("kind") != "notes") & differs).alias("changed"))


def source_projects(sources: DataFrame, files: DataFrame) -> DataFrame:
    """Each source's current project name, null once its file has left."""
    return sources.join(files.select(F.col("id").alias("file_id"), "project"), "file_id", "left").select("source_id", "project")


def folder_overlaps(projects: DataFrame) -> DataFrame:
    """Pairs (a, b), a < b, of projects (id, folder) of which one's folder is the other's or lies in it.

    Each folder meets its ancestors by equality.
    """
    parts = F.split("folder", "/")
    up = projects.select(F.col("id").alias("inner"), F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).alias("folder"))
    met = up.join(projects.select(F.col("id").alias("outer"), "folder"), "folder").where(F.col("inner") != F.col("outer"))
    return met.select(F.least("inner", "outer").alias("a"), F.greatest("inner", "outer").alias("b")).distinct()


def dedupe_names(projects: DataFrame) -> DataFrame:
    """Names (id, name) equal ignoring A-Z case: all but the smallest id become ``name (id)``."""
    first = F.min("id").over(Window.partitionBy(ascii_fold(F.col("name"))))
    return projects.withColumn("first", first).select("id", F.when(F.col("id") == F.col("first"), F.col("name")).otherwise(F.concat("name", F.lit(" ("), F.col("id").cast("string"), F.lit(")"))).alias("name"))
