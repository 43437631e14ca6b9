"""Search of many questions at once: trigram BM25, exact dense search, rank fusion, gate, rerank."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.files import write_index
from ..sources.shared import shared_folder
from .postings import SCORES, Best, keyword_candidates, read_postings, write_postings

# Fixed values of the ranking.
TOP = 30
RRF = 60
GATE = 0.43
#: Most numbers of a query matrix that is broadcast at once (100 MB of doubles).
MATRIX = 12_500_000


def ranked_by(df: DataFrame, keys: list[str], order: list[Column], k: int | None = None, name: str = "rank") -> DataFrame:
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return out.where(F.col(name) <= k) if k else out


def _pieces(text: str | None) -> Counter:
    """The overlapping three-character pieces of a text, counted."""
    return Counter(map("".join, zip(text or "", (text or "")[1:], (text or "")[2:], strict=False)))


def _counted_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each row's pieces with their counts, a few rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            terms, ids, counts = [], [], []
            for chunk, text in zip(batch.column(0)[at : at + 200].to_pylist(), batch.column(1)[at : at + 200].to_pylist(), strict=True):
                found = _pieces(text)
                terms += found
                counts += found.values()
                ids += [chunk] * len(found)
            yield pa.record_batch([pa.array(terms, pa.string()), pa.array(ids, pa.int64()), pa.array(counts, pa.int64())], names=["term", "chunk_id", "tf"])


def _folded(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.lower("text").alias("text"))


def trigram_postings(chunks: DataFrame) -> DataFrame:
    """``term, chunk_id, tf`` over every three characters of the folded text.

    A chunk is one row, so it is counted where it is read: pieces are never exploded one by one nor shuffled to be counted.
    """
    return _folded(chunks).mapInArrow(_counted_grams, "term string, chunk_id long, tf long")


def chunk_lengths(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.greatest(F.length("text") - 2, F.lit(0)).cast("long").alias("dl"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row: number of chunks and their mean trigram count."""
    return chunk_lengths(chunks).agg(F.count(F.lit(1)).alias("n_chunks"), F.avg("dl").alias("avg_dl"))


def term_stats(postings: DataFrame) -> DataFrame:
    return postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def keyword_search(queries: DataFrame, postings: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, chunk_id, score, rank`` by BM25 over any of the query's terms from stored ``postings``; statistics are those of all chunks."""
    return ranked_by(keyword_candidates(queries, postings, k), ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def keyword_topk(queries: DataFrame, chunks: DataFrame, k: int = TOP) -> DataFrame:
    """``keyword_search`` over ``chunks`` (chunk_id, text), whose postings are written first."""
    path = shared_folder(chunks.sparkSession, "postings")
    write_postings(chunks, path)
    return keyword_search(queries, read_postings(chunks.sparkSession, path), k)


def write_search_index(chunks: DataFrame, vectors: DataFrame, path: str) -> None:
    """``chunks`` (chunk_id, project, text) and ``vectors`` (chunk_id, embedding) for later searches: chunks by project, postings and vectors, each in a folder of its own."""
    write_index(chunks, f"{path}/chunks")
    write_postings(chunks, f"{path}/postings")
    vectors.write.parquet(f"{path}/vectors")


def stored_search(queries: DataFrame, path: str, k: int = TOP) -> DataFrame:
    """``hybrid_search`` in a stored index."""
    spark = queries.sparkSession
    dense = dense_topk(queries.where("query_vector is not null"), spark.read.parquet(f"{path}/vectors"), k)
    return rrf_fuse(dense, keyword_search(queries, read_postings(spark, f"{path}/postings"), k))


def dense_topk(queries: DataFrame, vectors: DataFrame, k: int = TOP) -> DataFrame:
    """``query_id, chunk_id, similarity, rank``: the exact nearest vectors by cosine, rounded to 6 digits, ties by id.

    Query vectors (``query_id, query_vector``) go out as a matrix, in blocks of bounded size. A task multiplies slice after slice of its vectors
    with it and keeps the k best of each query all the while; it emits them once, k rows per query and task at most.
    """
    return ranked_by(dense_candidates(queries, vectors, k), ["query_id"], [F.desc("similarity"), F.col("chunk_id")], k)


def dense_candidates(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, similarity``: of each task's vectors the k nearest of each query."""
    spark = queries.sparkSession
    size = queries.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("query_vector")).alias("dim")).first()
    blocks = max(1, -(-size["n"] * max(size["dim"] or 1, k) // MATRIX))
    found = None
    for b in range(blocks):
        block = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        rows = block.select("query_id", "query_vector").collect()
        ids = np.array([r[0] for r in rows], np.int64)
        matrix = np.array([r[1] for r in rows], np.float64).reshape(len(rows), -1)
        norms = np.linalg.norm(matrix, axis=1, keepdims=True)
        shared = spark.sparkContext.broadcast((ids, np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)))

        def nearest(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, matrix = shared.value
            best, step = Best(len(ids), k), max(1, SCORES // max(1, len(ids)))
            for whole in batches:
                for at in range(0, whole.num_rows if len(ids) else 0, step):
                    batch = whole.slice(at, step)
                    v = batch.column(1).flatten().to_numpy().astype(np.float64).reshape(batch.num_rows, -1)
                    norm = np.linalg.norm(v, axis=1, keepdims=True)
                    scores = np.round(np.divide(v, norm, out=np.zeros_like(v), where=norm > 0) @ matrix.T, 6)
                    chunk = batch.column(0).to_numpy()
                    for q in range(len(ids)):
                        best.add(q, chunk, scores[:, q])
            yield from best.rows(ids, "similarity")

        part = vectors.where("embedding is not null").select("chunk_id", F.col("embedding")).mapInArrow(nearest, "query_id long, chunk_id long, similarity double")
        found = part if found is None else found.unionByName(part)
    return found


def union_hits(*lists: DataFrame) -> DataFrame:
    """Bag union of ranked lists; what a list lacks is null."""
    out = lists[0]
    for x in lists[1:]:
        out = out.unionByName(x, allowMissingColumns=True)
    return out


def rrf_fuse(dense: DataFrame, keyword: DataFrame, k: int | None = None) -> DataFrame:
    """``query_id, chunk_id, score, similarity, rank``; hits of the keyword list alone have no similarity."""
    hits = union_hits(dense.select("query_id", "chunk_id", "rank", "similarity"), keyword.select("query_id", "chunk_id", "rank"))
    fused = hits.groupBy("query_id", "chunk_id").agg(F.round(F.sum(1.0 / (RRF + F.col("rank"))), 6).alias("score"), F.max("similarity").alias("similarity"))
    return ranked_by(fused, ["query_id"], [F.desc("score"), F.col("chunk_id")], k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = TOP) -> DataFrame:
    return rrf_fuse(dense_topk(queries.where("query_vector is not null"), vectors, k), keyword_topk(queries, chunks, k))


def similarity_gate(queries: DataFrame, hits: DataFrame, gate: float = GATE) -> DataFrame:
    """``query_id, best, answerable``: best similarity (0 without hits) against the gate."""
    best = hits.groupBy("query_id").agg(F.max("similarity").alias("best"))
    return queries.select("query_id").join(best, "query_id", "left").select("query_id", F.coalesce("best", F.lit(0.0)).alias("best"), (F.coalesce("best", F.lit(0.0)) >= gate).alias("answerable"))


def rerank(hits: DataFrame, scores: DataFrame, k: int, pool: int = 10) -> DataFrame:
    """The first max(k, 10) hits in the order of a given score, stable; the rest, and queries without all scores, stay as they are."""
    n = max(k, pool)
    joined = hits.join(scores.select("query_id", "chunk_id", F.col("score").alias("pair_score")), ["query_id", "chunk_id"], "left")
    query = Window.partitionBy("query_id")
    missing = F.max(((F.col("rank") <= n) & F.col("pair_score").isNull()).cast("int")).over(query)
    joined = joined.withColumn("_missing", missing)
    order = [F.col("rank") > n, F.when((F.col("rank") <= n) & (F.col("_missing") == 0), -F.col("pair_score")), F.col("rank")]
    return joined.withColumn("new_rank", F.row_number().over(query.orderBy(*order))).drop("_missing")


def number_sources(hits: DataFrame, k: int = 4, rank: str = "rank") -> DataFrame:
    """The k best passages, numbered from 1."""
    return ranked_by(hits, ["query_id"], [F.col(rank), F.col("chunk_id")], k, "n")


def first_hit_rank(questions: DataFrame, hits: DataFrame, is_hit: Column) -> DataFrame:
    """Smallest rank that is a hit, null if none is."""
    best = hits.where(is_hit).groupBy("query_id").agg(F.min("rank").alias("rank"))
    return questions.join(best, "query_id", "left")


def page_range_hit(page: Column, page_start: Column, page_end: Column) -> Column:
    """No page asked for, or one inside the chunk's pages; missing bounds are 0."""
    return page.isNull() | page.between(F.coalesce(page_start, F.lit(0)), F.coalesce(page_end, F.lit(0)))


def scope_filter(hits: DataFrame, chats: DataFrame, scopes: DataFrame) -> DataFrame:
    """Hits (chat_id, project) inside the chat's scope; chats without a scope search their home; without both, nothing."""
    home = chats.join(scopes, "chat_id", "left_anti").where("home is not null").select("chat_id", F.col("home").alias("project"))
    return hits.join(scopes.select("chat_id", "project").unionByName(home), ["chat_id", "project"], "left_semi")


def fetch_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks' columns, in hit order by ``rank``; missing ids are dropped."""
    return hits.join(chunks, "chunk_id")


def match_projects_by_name(projects: DataFrame, names: DataFrame) -> DataFrame:
    """``name`` asked for, with the project it means (A-Z ignoring case) or null for an unknown one."""
    folded = projects.withColumn("_key", T.ascii_fold(F.col("name"))).withColumnRenamed("name", "project_name")
    return names.withColumn("_key", T.ascii_fold(F.col("name"))).join(folded, "_key", "left").drop("_key")
