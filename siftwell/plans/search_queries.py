"""Registered queries of search, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as S
from . import inputs


def _md5(column: str) -> F.Column:
    return F.md5(F.array_join(F.array_sort(column), ","))


def trigrams(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.chunks(spark, d).select("chunk_id", T.trigrams(F.col("text")).alias("t"))
    return rows.select("chunk_id", F.size("t").cast("long").alias("n_trigrams"), _md5("t").alias("trigrams_md5"))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    rows = inputs.chunks(spark, d).select("chunk_id", T.query_terms(F.col("text")).alias("t"))
    return rows.select("chunk_id", F.array_join("t", ",").alias("terms"))


def trigram_postings(spark: SparkSession, d: str) -> DataFrame:
    return S.trigram_postings(inputs.chunks(spark, d))


def term_stats(spark: SparkSession, d: str) -> DataFrame:
    c = inputs.chunks(spark, d)
    return S.term_stats(S.trigram_postings(c)).crossJoin(F.broadcast(S.corpus_stats(c))).select("term", "df", "n_chunks", F.round("avg_dl", 6).alias("avg_dl"))


def keyword_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.keyword_topk(inputs.questions(spark, d), inputs.chunks(spark, d))


def _with_vector(spark: SparkSession, d: str) -> DataFrame:
    return inputs.questions(spark, d).where("query_vector is not null")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return S.dense_topk(_with_vector(spark, d), inputs.vectors(spark, d))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    return S.hybrid_search(inputs.questions(spark, d), inputs.chunks(spark, d), inputs.vectors(spark, d))


def rrf_fuse(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of the dense list with the same questions' list inside their own project."""
    dense = dense_topk(spark, d)
    own = inputs.chunks(spark, d).select("chunk_id", "project")
    asked = inputs.questions(spark, d).select("query_id", F.col("project").alias("asked"))
    inside = dense.join(own, "chunk_id").join(asked, "query_id").where("project = asked").select("query_id", "chunk_id", "similarity")
    return S.rrf_fuse(dense, S.ranked_by(inside, ["query_id"], [F.desc("similarity"), F.col("chunk_id")]))


def union_hits(spark: SparkSession, d: str) -> DataFrame:
    keyword = keyword_topk(spark, d).select("query_id", "chunk_id", "rank")
    return S.union_hits(dense_topk(spark, d), keyword)


def similarity_gate(spark: SparkSession, d: str) -> DataFrame:
    return S.similarity_gate(inputs.questions(spark, d), dense_topk(spark, d).where("query_id <> chunk_id"))


def rerank(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the pairs by arithmetic on the ids; every third query lacks one."""
    hits = dense_topk(spark, d).select("query_id", "chunk_id", "rank")
    scores = hits.where("query_id % 300 <> 0 or rank <> 2").select("query_id", "chunk_id", ((F.col("chunk_id") * 7919) % 101 / 101.0).alias("score"))
    return S.rerank(hits, scores, 4).select("query_id", "chunk_id", "rank", "new_rank")


def number_sources(spark: SparkSession, d: str) -> DataFrame:
    return S.number_sources(keyword_topk(spark, d).select("query_id", "chunk_id", "rank"), 4)


def fetch_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.fetch_chunks(dense_topk(spark, d), inputs.chunks(spark, d)).select("query_id", "rank", "chunk_id", "project", F.length("text").cast("long").alias("n_chars"))


def scope_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chats are the questions; their scope is every project of their language's first letter, and every fourth has none."""
    asked = inputs.questions(spark, d)
    chats = asked.select(F.col("query_id").alias("chat_id"), F.when(F.col("query_id") % 800 != 0, F.col("project")).alias("home"))
    scopes = asked.where("query_id % 400 <> 0").select(F.col("query_id").alias("chat_id"), F.explode(F.array("project", F.lit("src1"))).alias("project")).distinct()
    hits = fetch_chunks(spark, d).withColumnRenamed("query_id", "chat_id")
    return S.scope_filter(hits, chats, scopes).select("chat_id", "rank", "chunk_id", "project")


def first_hit_rank(spark: SparkSession, d: str) -> DataFrame:
    """A hit is another chunk of the question's project."""
    asked = inputs.questions(spark, d).select("query_id", F.col("project").alias("expected"))
    hits = fetch_chunks(spark, d).join(asked, "query_id")
    return S.first_hit_rank(asked, hits.drop("expected").join(asked, "query_id"), (F.col("project") == F.col("expected")) & (F.col("chunk_id") != F.col("query_id")))


def page_range_hit(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of 3,000 characters a page; the page asked for is the question's id modulo 4, none for 0."""
    hits = fetch_chunks(spark, d).withColumn("page", F.when(F.col("query_id") % 400 != 0, (F.col("query_id") / 100 % 4).cast("int")))
    end = (F.col("n_chars") / 3000).cast("int")
    return hits.select("query_id", "chunk_id", S.page_range_hit(F.col("page"), F.when(end > 0, F.lit(1)), F.when(end > 0, end)).alias("hit"))


def match_projects_by_name(spark: SparkSession, d: str) -> DataFrame:
    c = inputs.chunks(spark, d)
    projects = c.select(F.col("project").alias("name")).distinct()
    asked = c.select(F.concat(F.upper("project"), F.when(F.col("chunk_id") % 7 == 0, "x").otherwise("")).alias("name")).distinct()
    return S.match_projects_by_name(projects, asked)


QUERIES = {f.__name__: f for f in (hybrid_search, trigrams, query_terms, trigram_postings, term_stats, keyword_topk, dense_topk, rrf_fuse, union_hits, similarity_gate, rerank, number_sources, fetch_chunks, scope_filter, first_hit_rank, page_range_hit, match_projects_by_name)}

# ---- the same in DuckDB's SQL, from shared parts

_WORDS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}\x{0E00}-\x{0E7F}]+')"
_PARTS = {
    "chunks": "SELECT doc_id AS chunk_id, source AS project, text FROM documents",
    "grams": f"""SELECT chunk_id, wi, i, substr(w, i, 3) AS term FROM (
        SELECT chunk_id, wi, w, unnest(range(1, length(w) - 1)) AS i FROM (
          SELECT doc_id AS chunk_id, unnest({_WORDS}) AS w, unnest(range(1, len({_WORDS}) + 1)) AS wi FROM documents) WHERE length(w) >= 3)""",
    "questions": "SELECT d.doc_id AS query_id, source AS project, text, embedding AS v FROM documents d LEFT JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.doc_id % 100 = 0",
    "terms": f"""SELECT query_id, term FROM (SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY min(wi * 1000000 + i)) AS r FROM (
        SELECT query_id, wi, i, substr(w, i, 3) AS term FROM (SELECT query_id, wi, w, unnest(range(1, length(w) - 1)) AS i FROM (
          SELECT query_id, unnest({_WORDS}) AS w, unnest(range(1, len({_WORDS}) + 1)) AS wi FROM questions) WHERE length(w) >= 3)) GROUP BY query_id, term) WHERE r <= 64""",
    "postings": "SELECT term, chunk_id, count(*) AS tf FROM (SELECT chunk_id, substr(t, i, 3) AS term FROM (SELECT doc_id AS chunk_id, lower(text) AS t, unnest(range(1, length(lower(text)) - 1)) AS i FROM documents WHERE length(text) >= 3)) GROUP BY term, chunk_id",
    "stats": "SELECT count(*) AS n_chunks, avg(greatest(length(text) - 2, 0)) AS avg_dl FROM documents",
    "df": "SELECT term, count(*) AS df FROM postings GROUP BY term",
    "keyword": """SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (
        SELECT query_id, p.chunk_id, round(sum(greatest(ln((n_chunks - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * greatest(length(d.text) - 2, 0) / avg_dl))), 6) AS score
        FROM terms JOIN postings p USING (term) JOIN df USING (term) JOIN documents d ON d.doc_id = p.chunk_id, stats GROUP BY query_id, p.chunk_id) QUALIFY rank <= 30""",
    "dense": """SELECT query_id, chunk_id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) AS rank FROM (
        SELECT query_id, vec_id AS chunk_id, round(list_cosine_similarity(CAST(v AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS similarity FROM questions, embeddings WHERE v IS NOT NULL) QUALIFY rank <= 30""",
    "hits": "SELECT query_id, rank, chunk_id, project, length(text) AS n_chars FROM dense JOIN chunks USING (chunk_id)",
}


def _sql(body: str, *parts: str) -> str:
    return "WITH " + ",\n".join(f"{p} AS ({_PARTS[p]})" for p in parts) + "\n" + body


_KEYWORD = ("questions", "terms", "postings", "stats", "df", "keyword")
_DENSE = ("questions", "dense")
_FUSE = "SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + rank)), 6) AS score, max(similarity) AS similarity FROM ({}) GROUP BY query_id, chunk_id)"
ORACLE_SQL = {
    "hybrid_search": _sql(_FUSE.format("SELECT query_id, chunk_id, rank, similarity FROM dense UNION ALL SELECT query_id, chunk_id, rank, NULL FROM keyword"), *_KEYWORD, "dense"),
    "trigrams": _sql("SELECT doc_id AS chunk_id, coalesce(n, 0) AS n_trigrams, md5(coalesce(t, '')) AS trigrams_md5 FROM documents LEFT JOIN (SELECT chunk_id, count(*) AS n, string_agg(term, ',' ORDER BY term) AS t FROM (SELECT DISTINCT chunk_id, term FROM grams) GROUP BY chunk_id) ON chunk_id = doc_id", "grams"),
    "query_terms": _sql("SELECT doc_id AS chunk_id, terms FROM documents LEFT JOIN (SELECT chunk_id, string_agg(term, ',' ORDER BY r) AS terms FROM (SELECT chunk_id, term, row_number() OVER (PARTITION BY chunk_id ORDER BY min(wi * 1000000 + i)) AS r FROM grams GROUP BY chunk_id, term) WHERE r <= 64 GROUP BY chunk_id) ON chunk_id = doc_id", "grams"),
    "trigram_postings": _PARTS["postings"],
    "term_stats": _sql("SELECT term, df, n_chunks, round(avg_dl, 6) AS avg_dl FROM df, stats", "postings", "stats", "df"),
    "keyword_topk": _sql("SELECT * FROM keyword", *_KEYWORD),
    "dense_topk": _sql("SELECT * FROM dense", *_DENSE),
    "rrf_fuse": _sql(_FUSE.format("SELECT query_id, chunk_id, rank, similarity FROM dense UNION ALL SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id), NULL FROM dense JOIN chunks USING (chunk_id) JOIN questions q USING (query_id) WHERE chunks.project = q.project"), *_DENSE, "chunks"),
    "union_hits": _sql("SELECT query_id, chunk_id, similarity, rank FROM dense UNION ALL SELECT query_id, chunk_id, NULL, rank FROM keyword", *_KEYWORD, "dense"),
    "similarity_gate": _sql("SELECT query_id, coalesce(max(similarity), 0.0) AS best, coalesce(max(similarity), 0.0) >= 0.43 AS answerable FROM questions LEFT JOIN (SELECT * FROM dense WHERE query_id <> chunk_id) USING (query_id) GROUP BY query_id", *_DENSE),
    "rerank": _sql("""SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank > 10, CASE WHEN rank <= 10 AND query_id % 300 <> 0 THEN -(((chunk_id * 7919) % 101) / 101.0::DOUBLE) END, rank) AS new_rank FROM dense""", *_DENSE),
    "number_sources": _sql("SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n FROM keyword QUALIFY n <= 4", *_KEYWORD),
    "fetch_chunks": _sql("SELECT * FROM hits", *_DENSE, "chunks", "hits"),
    "scope_filter": _sql("""SELECT h.query_id AS chat_id, rank, chunk_id, h.project FROM hits h JOIN questions q USING (query_id)
        WHERE CASE WHEN query_id % 400 <> 0 THEN h.project IN (q.project, 'src1') ELSE query_id % 800 <> 0 AND h.project = q.project END""", *_DENSE, "chunks", "hits"),
    "first_hit_rank": _sql("SELECT q.query_id, q.project AS expected, min(h.rank) AS rank FROM questions q LEFT JOIN hits h ON h.query_id = q.query_id AND h.project = q.project AND h.chunk_id <> q.query_id GROUP BY q.query_id, q.project", *_DENSE, "chunks", "hits"),
    "page_range_hit": _sql("""SELECT query_id, chunk_id, query_id % 400 = 0 OR (query_id // 100) % 4 BETWEEN CASE WHEN n_chars // 3000 > 0 THEN 1 ELSE 0 END AND n_chars // 3000 AS hit FROM hits""", *_DENSE, "chunks", "hits"),
    "match_projects_by_name": "SELECT DISTINCT upper(a.source) || CASE WHEN a.doc_id % 7 = 0 THEN 'x' ELSE '' END AS name, CASE WHEN a.doc_id % 7 <> 0 THEN a.source END AS project_name FROM documents a",
}
