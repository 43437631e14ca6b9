"""Registered queries that write files, tables or streams and read them back: their work grows with the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import postings, search
from ..sources import files as S
from ..sources import versions as V
from ..sources.shared import shared_folder
from ..streaming import index as I
from ..streaming import watch as W
from . import file_queries, inputs


#: Most documents in a file of the corpus.
FILE_DOCUMENTS = 500


def _corpus(s: SparkSession, d: str) -> str:
    """The documents' texts as text files of bounded size: a folder per source, and a file for some hundred of its documents."""
    folder = shared_folder(s, "corpus")
    rows = inputs.table(s, d, "documents").select("source", F.col("doc_id"), F.col("text").alias("value"))
    parts = F.ceil(F.lit(rows.count()) / FILE_DOCUMENTS).cast("int")
    dealt = rows.repartition(F.col("source"), F.pmod(F.xxhash64("doc_id"), parts)).select("source", "value")
    dealt.write.option("maxRecordsPerFile", FILE_DOCUMENTS).partitionBy("source").text(folder)
    return folder


def scan_corpus(s: SparkSession, d: str) -> DataFrame:
    """Bytes and files per project folder."""
    rows = S.scan_corpus(s, _corpus(s, d))
    return rows.groupBy(F.regexp_extract("rel_path", "source=([^/]+)", 1).alias("project")).agg(F.sum("size").alias("bytes"))


def read_text_files(s: SparkSession, d: str) -> DataFrame:
    """Lines per project folder."""
    rows = S.read_text_files(s, _corpus(s, d)).select(F.regexp_extract("rel_path", "source=([^/]+)", 1).alias("project"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    return rows.groupBy("project").agg(F.count(F.lit(1)).alias("lines"))


def read_questions(s: SparkSession, d: str) -> DataFrame:
    path = shared_folder(s, "questions")
    asked = inputs.questions(s, d).select(F.col("query_id").cast("string").alias("id"), F.lit("en").alias("lang"), F.col("query_text").alias("question"), F.col("project").alias("file"), (F.col("query_id") % 700).cast("int").alias("page"))
    asked.write.json(path)
    return S.read_questions(s, path)


def write_index(s: SparkSession, d: str) -> DataFrame:
    """Chunks, postings and vectors written and read back: what each project has of them."""
    path = shared_folder(s, "index")
    search.write_search_index(inputs.chunks(s, d).select("chunk_id", "project", "text"), inputs.vectors(s, d), path)
    chunks = s.read.parquet(f"{path}/chunks")
    own = chunks.select("chunk_id", "project")
    per = chunks.groupBy("project").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))
    grams = postings.decoded(postings.read_postings(s, f"{path}/postings")).groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.sum("tf").alias("tf"))
    counted = grams.join(own, "chunk_id").groupBy("project").agg(F.sum("n").alias("postings"), F.sum("tf").alias("trigrams"))
    stored = s.read.parquet(f"{path}/vectors").join(own, "chunk_id").groupBy("project").agg(F.count(F.lit(1)).alias("vectors"))
    return per.join(counted, "project", "left").join(stored, "project", "left")


def replace_file_chunks(s: SparkSession, d: str) -> DataFrame:
    """Requeued files' chunks swapped for new ones, published as the next version of the index."""
    files = file_queries._files(s, d).select(F.col("id").alias("file_id"))
    docs = inputs.table(s, d, "documents").select(F.col("doc_id").alias("file_id"), "text")
    old = docs.where("file_id % 4 <> 1").select("file_id", F.lit(0).alias("ord"), F.length("text").alias("chars"))
    new = docs.where("file_id % 3 = 0").select("file_id", F.explode(F.array(F.lit(0), F.lit(1))).alias("ord"), (F.length("text") + 1).alias("chars"))
    path, schema = shared_folder(s, "index"), "file_id long, ord int, chars int"
    V.replace(path, old, "file_id")
    S.swap_file_chunks(path, new, files, schema)
    return V.read(s, path, schema)


def _folders(s: SparkSession, d: str, generation: int) -> DataFrame:
    """What the project folders hold in each of two generations: files come, go, change, are touched; some can't be read."""
    late = f"{generation} = 1"
    return inputs.table(s, d, "documents").where(f"doc_id % 10 <> if({late}, 5, 3)").selectExpr(
        "source project", "concat('d', doc_id % 7, '/f', doc_id, '.txt') rel_path", f"cast(n_chars + if({late} and doc_id % 6 = 0, 1, 0) as long) size",
        f"doc_id + if({late} and doc_id % 4 = 0, 1.0D, 0.0D) mtime", f"concat(coalesce(text, ''), if({late} and doc_id % 6 = 0, 'x', '')) text", "if(doc_id % 11 = 4, 'broken', null) error",
    )


def incremental_index(s: SparkSession, d: str) -> DataFrame:
    """Notices of all projects arrive twice as a stream; each micro-batch is a pass over the folders as they are then."""
    arriving, state = shared_folder(s, "arriving"), shared_folder(s, "stream-index")
    for generation in (0, 1):
        inputs.table(s, d, "documents").selectExpr("source project", f"{generation} generation").distinct().coalesce(1).write.mode("append").parquet(arriving)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        generation = batch.agg(F.max("generation")).first()[0]
        now = _folders(s, d, generation)
        I.index_pass(state, batch_id, batch, now.drop("text", "error"), lambda keys: now.join(keys, ["project", "rel_path"], "left_semi"), file_queries._failed(s, d))

    stream = s.readStream.schema("project string, generation int").option("maxFilesPerTrigger", 1).parquet(arriving)
    W.incremental_index(stream, shared_folder(s, "progress"), refresh).awaitTermination()
    key = ["project", "rel_path"]
    chunked = I.chunks_after(s, state, 1).groupBy(key).agg((F.count(F.lit(1)) > 0).alias("has_chunks"))
    return I.files_after(s, state, 1).join(chunked, key, "left").withColumn("has_chunks", F.coalesce("has_chunks", F.lit(False)))


QUERIES = {f.__name__: f for f in (scan_corpus, read_text_files, read_questions, write_index, replace_file_chunks, incremental_index)}
ORACLE_SQL = {
    "scan_corpus": "SELECT source AS project, sum(strlen(text) + 1) AS bytes FROM documents GROUP BY source",
    "read_text_files": "SELECT source AS project, count(*) AS lines FROM (SELECT source, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE line <> '' GROUP BY source",
    "read_questions": "SELECT CAST(doc_id AS VARCHAR) AS id, 'en' AS lang, text AS question, source AS file, CAST(doc_id % 700 AS INTEGER) AS page FROM documents WHERE doc_id % 100 = 0",
    "write_index": """WITH g AS (SELECT source, doc_id, count(*) AS tf, count(DISTINCT term) AS n FROM (SELECT source, doc_id, substr(t, i, 3) AS term FROM (SELECT source, doc_id, lower(text) AS t, unnest(range(1, length(text) - 1)) AS i FROM documents WHERE length(text) >= 3)) GROUP BY source, doc_id)
        SELECT source AS project, count(*) AS chunks, sum(length(text)) AS chars, any_value(p.n) AS postings, any_value(p.tf) AS trigrams, any_value(v.n) AS vectors FROM documents
        LEFT JOIN (SELECT source, CAST(sum(n) AS BIGINT) AS n, CAST(sum(tf) AS BIGINT) AS tf FROM g GROUP BY source) p USING (source)
        LEFT JOIN (SELECT source, count(*) AS n FROM documents JOIN embeddings ON vec_id = doc_id GROUP BY source) v USING (source) GROUP BY source""",
    "replace_file_chunks": """SELECT doc_id AS file_id, 0 AS ord, length(text) AS chars FROM documents WHERE doc_id % 4 <> 1 AND NOT (doc_id % 3 = 0 AND doc_id % 10 <> 3)
        UNION ALL SELECT doc_id, ord, length(text) + 1 FROM documents, (SELECT unnest([0, 1]) AS ord) WHERE doc_id % 3 = 0 AND doc_id % 10 <> 3""",
    "incremental_index": """SELECT project, rel_path, size, mtime, CASE WHEN status = 'indexed' THEN sha256(t) END AS hash, status,
        CASE status WHEN 'failed' THEN 'broken' WHEN 'skipped' THEN 'no text found' END AS error, status = 'indexed' AS has_chunks
        FROM (SELECT *, CASE WHEN doc_id % 11 = 4 THEN 'failed' WHEN NOT regexp_matches(t, '[^ \\t-\\r]') THEN 'skipped' ELSE 'indexed' END AS status
        FROM (SELECT doc_id, source AS project, 'd' || doc_id % 7 || '/f' || doc_id || '.txt' AS rel_path, CAST(n_chars + CASE WHEN new AND doc_id % 6 = 0 THEN 1 ELSE 0 END AS BIGINT) AS size,
        CAST(doc_id + CASE WHEN new AND doc_id % 4 = 0 THEN 1 ELSE 0 END AS DOUBLE) AS mtime, coalesce(text, '') || CASE WHEN new AND doc_id % 6 = 0 THEN 'x' ELSE '' END AS t
        FROM (SELECT *, doc_id % 10 <> 5 AS new FROM documents) WHERE new OR source LIKE '%2' OR (source LIKE '%3' AND doc_id % 7 = 4)))""",
}
