"""Registered queries of files and projects. Two states of a folder are derived from documents by arithmetic on the ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import files as X
from . import inputs

MODEL = "m1"


def _files(s: SparkSession, d: str) -> DataFrame:
    return inputs.table(s, d, "documents").where("doc_id % 10 <> 3").selectExpr(
        "doc_id id", "source project", "concat('d', doc_id % 7, '/f', doc_id, '.txt') rel_path", "n_chars size", "cast(doc_id as double) mtime",
        "if(doc_id % 9 = 0, null, sha2(text, 256)) hash", "element_at(array('failed','skipped','pending','indexing','indexed','indexed','indexed'), cast(doc_id % 7 + 1 as int)) status",
        "if(doc_id % 7 < 2, concat('e', doc_id % 3), null) error",
    )


def _disk(s: SparkSession, d: str) -> DataFrame:
    return inputs.table(s, d, "documents").where("doc_id % 10 <> 5").selectExpr(
        "source project", "concat('d', doc_id % 7, '/f', doc_id, '.txt') rel_path", "n_chars + if(doc_id % 6 = 0, 1, 0) size",
        "doc_id + if(doc_id % 4 = 0, 1.0D, 0.0D) mtime", "sha2(concat(text, if(doc_id % 6 = 0, 'x', '')), 256) hash",
    )


def _failed(s: SparkSession, d: str) -> DataFrame:
    """Places that could not be read: a folder of some projects, all of others."""
    return inputs.table(s, d, "documents").selectExpr("source project", "if(source like '%2', '.', if(source like '%3', 'd4', 'none')) place").distinct()


def _projects(s: SparkSession, d: str) -> DataFrame:
    return inputs.table(s, d, "documents").groupBy(F.col("source").alias("project")).agg(F.when(F.max("doc_id") % 3 != 0, "m1").otherwise("m0").alias("model"))


def _sources(s: SparkSession, d: str) -> DataFrame:
    return inputs.table(s, d, "documents").selectExpr("doc_id source_id", "if(doc_id % 13 = 0, null, doc_id) file_id", "if(doc_id % 17 = 0, 'notes', 'text') kind", "if(doc_id % 9 = 0, null, sha2(concat(text, if(doc_id % 19 = 0, 'y', '')), 256)) hash")


def reconcile(s: SparkSession, d: str) -> DataFrame:
    return X.reconcile(_files(s, d), _disk(s, d), _failed(s, d))


def protect_unreadable(s: SparkSession, d: str) -> DataFrame:
    return X.protect_unreadable(_files(s, d).select("project", "rel_path"), _failed(s, d))


def stale_files(s: SparkSession, d: str) -> DataFrame:
    return X.stale_files(_files(s, d), _disk(s, d))


def content_hash(s: SparkSession, d: str) -> DataFrame:
    return inputs.table(s, d, "documents").select("doc_id", X.content_hash(F.col("text")).alias("content_hash"))


def index_disposition(s: SparkSession, d: str) -> DataFrame:
    rows = inputs.table(s, d, "documents").selectExpr("doc_id id", "if(doc_id % 8 = 1, 209715201L, n_chars) size", "if(doc_id % 5 = 2, 0, 1) n_chunks", "if(doc_id % 6 = 4, 'broken', null) error", "if(doc_id % 10 = 7, 'needs OCR', null) note", "sha2(text, 256) hash")
    return X.index_disposition(rows)


def pending_queue(s: SparkSession, d: str) -> DataFrame:
    blocked = _projects(s, d).where("project like '%7'").select("project")
    return X.pending_queue(_files(s, d), _projects(s, d), MODEL, blocked).select("id", "project")


def searchable_projects(s: SparkSession, d: str) -> DataFrame:
    return X.searchable_projects(_projects(s, d), _files(s, d), MODEL)


def status_counts(s: SparkSession, d: str) -> DataFrame:
    return X.status_counts(_projects(s, d), _files(s, d))


def project_overview(s: SparkSession, d: str) -> DataFrame:
    return X.project_overview(_projects(s, d), _files(s, d), MODEL)


def problem_files(s: SparkSession, d: str) -> DataFrame:
    return X.problem_files(_files(s, d)).select("project", "rel_path", "error", "n")


def changed_sources(s: SparkSession, d: str) -> DataFrame:
    return X.changed_sources(_sources(s, d), _files(s, d), _disk(s, d))


def source_projects(s: SparkSession, d: str) -> DataFrame:
    return X.source_projects(_sources(s, d), _files(s, d))


def folder_overlaps(s: SparkSession, d: str) -> DataFrame:
    """Each document's folder, inside one for each source and thousand ids; some have that one itself."""
    folders = inputs.table(s, d, "documents").selectExpr("doc_id id", "if(doc_id % 97 < 9, concat('/', source, '/', doc_id div 1000), concat('/', source, '/', doc_id div 1000, '/', doc_id)) folder")
    return X.folder_overlaps(folders)


def dedupe_names(s: SparkSession, d: str) -> DataFrame:
    return X.dedupe_names(inputs.table(s, d, "documents").selectExpr("doc_id id", "if(doc_id % 2 = 0, upper(concat(source, '-', doc_id % 400)), concat(source, '-', doc_id % 400)) name"))


QUERIES = {f.__name__: f for f in (reconcile, protect_unreadable, stale_files, content_hash, index_disposition, pending_queue, searchable_projects, status_counts, project_overview, problem_files, changed_sources, source_projects, folder_overlaps, dedupe_names)}

_WITH = """WITH files AS (SELECT doc_id AS id, source AS project, 'd' || doc_id % 7 || '/f' || doc_id || '.txt' AS rel_path, doc_id % 7 AS m, n_chars AS size, CAST(doc_id AS DOUBLE) AS mtime,
    CASE WHEN doc_id % 9 <> 0 THEN sha256(text) END AS hash, (['failed','skipped','pending','indexing','indexed','indexed','indexed'])[doc_id % 7 + 1] AS status,
    CASE WHEN doc_id % 7 < 2 THEN 'e' || doc_id % 3 END AS error FROM documents WHERE doc_id % 10 <> 3),
  disk AS (SELECT source AS project, 'd' || doc_id % 7 || '/f' || doc_id || '.txt' AS rel_path, n_chars + CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 0 END AS size,
    doc_id + CASE WHEN doc_id % 4 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS mtime, sha256(text || CASE WHEN doc_id % 6 = 0 THEN 'x' ELSE '' END) AS hash FROM documents WHERE doc_id % 10 <> 5),
  safe AS (SELECT *, project LIKE '%2' OR (project LIKE '%3' AND m = 4) AS protected FROM files),
  projects AS (SELECT source AS project, CASE WHEN max(doc_id) % 3 <> 0 THEN 'm1' ELSE 'm0' END AS model FROM documents GROUP BY source),
  sources AS (SELECT doc_id AS source_id, CASE WHEN doc_id % 13 <> 0 THEN doc_id END AS file_id, CASE WHEN doc_id % 17 = 0 THEN 'notes' ELSE 'text' END AS kind,
    CASE WHEN doc_id % 9 <> 0 THEN sha256(text || CASE WHEN doc_id % 19 = 0 THEN 'y' ELSE '' END) END AS hash FROM documents)
"""
_COUNTS = "SELECT project, " + ", ".join(f"count(*) FILTER (WHERE status = '{x}') AS {x}" for x in X.STATUSES) + " FROM projects LEFT JOIN files USING (project) GROUP BY project"
ORACLE_SQL = {
    "reconcile": _WITH + """SELECT coalesce(f.project, k.project) AS project, coalesce(f.rel_path, k.rel_path) AS rel_path, CASE WHEN f.id IS NULL THEN 'add'
        WHEN k.rel_path IS NULL THEN CASE WHEN protected THEN 'keep' ELSE 'delete' END WHEN status = 'indexing' THEN 'requeue'
        WHEN (f.size <> k.size OR f.mtime <> k.mtime) AND (f.hash IS NULL OR f.hash <> k.hash) THEN 'requeue' WHEN f.size <> k.size OR f.mtime <> k.mtime THEN 'touch' ELSE 'keep' END AS action
        FROM safe f FULL JOIN disk k ON f.project = k.project AND f.rel_path = k.rel_path""",
    "protect_unreadable": _WITH + "SELECT project, rel_path FROM safe WHERE NOT protected",
    "stale_files": _WITH + "SELECT project, rel_path, 'table' AS side FROM files ANTI JOIN disk USING (project, rel_path) UNION ALL SELECT project, rel_path, 'disk' FROM disk ANTI JOIN files USING (project, rel_path)",
    "content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "index_disposition": """SELECT id, status, CASE WHEN big THEN 'file too large (over 200 MB)' WHEN bad THEN 'broken' WHEN none THEN coalesce(note, 'no text found') ELSE note END AS error, status = 'indexed' AS keeps_chunks,
        CASE WHEN status = 'indexed' THEN hash END AS content_hash FROM (SELECT *, CASE WHEN big THEN 'skipped' WHEN bad THEN 'failed' WHEN none THEN 'skipped' ELSE 'indexed' END AS status FROM (
        SELECT doc_id AS id, doc_id % 8 = 1 AS big, doc_id % 6 = 4 AS bad, doc_id % 5 = 2 AS none, CASE WHEN doc_id % 10 = 7 THEN 'needs OCR' END AS note, sha256(text) AS hash FROM documents))""",
    "pending_queue": _WITH + "SELECT id, project FROM files JOIN projects USING (project) WHERE status = 'pending' AND model = 'm1' AND project NOT LIKE '%7'",
    "searchable_projects": _WITH + "SELECT project, model = 'm1' AND has AS searchable, model <> 'm1' AND has AS stale FROM (SELECT project, model, project IN (SELECT project FROM files WHERE status = 'indexed') AS has FROM projects)",
    "status_counts": _WITH + _COUNTS,
    "project_overview": _WITH + f"SELECT project AS name, indexed AS indexed_files, model <> 'm1' AS stale FROM projects JOIN ({_COUNTS}) USING (project)",
    "problem_files": _WITH + "SELECT project, rel_path, error, row_number() OVER (PARTITION BY project ORDER BY rel_path) AS n FROM files WHERE error IS NOT NULL QUALIFY n <= 50",
    "changed_sources": _WITH + """SELECT source_id, kind <> 'notes' AND (file_id IS NULL OR f.id IS NULL OR f.hash IS DISTINCT FROM s.hash OR f.size IS DISTINCT FROM k.size OR f.mtime IS DISTINCT FROM k.mtime) AS changed
        FROM sources s LEFT JOIN files f ON f.id = s.file_id LEFT JOIN disk k ON k.project = f.project AND k.rel_path = f.rel_path""",
    "source_projects": _WITH + "SELECT source_id, project FROM sources LEFT JOIN files ON id = file_id",
    "folder_overlaps": """WITH p AS (SELECT doc_id AS id, source, doc_id % 97 < 9 AS root FROM documents)
        SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM p a JOIN p b ON a.source = b.source AND a.id // 1000 = b.id // 1000 AND a.id <> b.id WHERE a.root""",
    "dedupe_names": """WITH p AS (SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN upper(source || '-' || doc_id % 400) ELSE source || '-' || doc_id % 400 END AS name FROM documents)
        SELECT id, CASE WHEN id = min(id) OVER (PARTITION BY lower(name)) THEN name ELSE name || ' (' || id || ')' END AS name FROM p""",
}
