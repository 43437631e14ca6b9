"""Trigram postings on disk, and BM25 from them: a question reads the pages of its own terms and nothing else.

Chunks are counted where they are read. A task gathers some thousand chunks, a shard, and inverts them in memory: per term one row
with the chunks' places in the shard and their counts, each list in as few bytes a number as it needs. Rows are sorted by term
inside a shard, in small pages with minima and maxima, so that a filter on terms skips all other pages. A shard also has a row with
its chunks' ids and lengths (term -1). Nothing is shuffled to build it; a term of half the corpus is a row in each shard.

A search reads its terms' rows twice: their sizes for the document frequencies, then the lists, which go to their shards' tasks still
encoded. A task scores shard after shard, looks up frequent terms only for chunks that can still be among the best, and keeps the k best chunks of each question all the while; it emits them once.

Terms are the three code points in one long, so they need no dictionary and never collide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from ..functions import text as T
from .passages import few_rows

# Fixed values of the ranking.
K1, B, IDF_FLOOR = 1.2, 0.75, 1e-6
#: Chunks of a shard, and postings at which it is closed earlier.
SHARD_CHUNKS, SHARD_POSTINGS = 4096, 4_000_000
#: Row group and page sizes of the files: small, so that few bytes stand beside a term's own.
GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 4 << 20, 16 << 10, 100
#: Most ranges of terms in a pushed-down filter; nearby terms share one beyond that.
RANGES = 200
#: Most queries whose terms are broadcast at once, and most numbers of a score matrix.
QUERIES, SCORES = 5_000, 4_000_000
#: Postings that are decoded at once.
DECODED = 200_000
#: The term of the row with a shard's chunks.
CHUNKS = -1

SCHEMA = "shard long, term long, n int, total long, places binary, counts binary"
_ARROW = pa.schema([("shard", pa.int64()), ("term", pa.int64()), ("n", pa.int32()), ("total", pa.int64()), ("places", pa.binary()), ("counts", pa.binary())])


def term_number(term: str) -> int:
    a, b, c = map(ord, term)
    return a << 42 | b << 21 | c


def counted_terms(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct terms of a text, in order, and how often it has them."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def packed(values: np.ndarray) -> bytes:
    """Whole numbers in as few bytes each as the largest needs, behind that width."""
    width = next(w for w in (1, 2, 4, 8) if not len(values) or int(values.max()) < 1 << 8 * w - (w == 8))
    return bytes([width]) + values.astype(f"<u{width}").tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk_id, folded text, length before folding) to the rows of shards."""
    part, shards = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    lengths: list[int] = []
    terms: list[np.ndarray] = []
    counts: list[np.ndarray] = []

    def shard() -> Iterator[pa.RecordBatch]:
        nonlocal shards
        place = np.repeat(np.arange(len(ids), dtype=np.int32), [len(t) for t in terms])
        term, count = np.concatenate(terms), np.concatenate(counts)
        terms.clear(), counts.clear()
        order = np.argsort(term, kind="stable")  # places stay in order
        term, count, place = term[order], count[order], place[order]
        del order
        names, starts = np.unique(term, return_index=True)
        ends = np.append(starts, len(term))[1:]
        whole = [packed(np.array(ids, np.int64).view(np.uint64)) if min(ids) >= 0 else b"\x00" + np.array(ids, np.int64).tobytes(), packed(np.array(lengths))]
        columns = [
            pa.array(np.full(len(names) + 1, part << 32 | shards)),
            pa.array(np.append(CHUNKS, names)),
            pa.array(np.append(len(ids), ends - starts).astype(np.int32)),
            pa.array([sum(lengths), *[None] * len(names)], pa.int64()),
            pa.array([whole[0], *(packed(place[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))], pa.binary()),
            pa.array([whole[1], *(packed(count[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))], pa.binary()),
        ]
        shards += 1
        for kept in (ids, lengths, terms, counts):
            kept.clear()
        rows = pa.record_batch(columns, schema=_ARROW)
        for at in range(0, rows.num_rows, 20_000):
            yield rows.slice(at, 20_000)

    held = 0
    for batch in few_rows(batches, 200):
        for chunk, text, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            found, count = counted_terms(text or "")
            ids.append(chunk)
            lengths.append(max(0, (length or 0) - 2))
            terms.append(found)
            counts.append(count.astype(np.int32))
            held += len(found)
            if len(ids) >= SHARD_CHUNKS or held >= SHARD_POSTINGS:
                yield from shard()
                held = 0
    if ids:
        yield from shard()


def _ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<i8", offset=1) if data[0] == 0 else unpacked(data)


def write_postings(chunks: DataFrame, path: str) -> None:
    """The posting files of ``chunks`` (chunk_id, text), case folded; null texts have no terms but count as chunks."""
    rows = chunks.select(F.col("chunk_id").cast("long"), F.lower("text").alias("text"), F.length("text").alias("length")).mapInArrow(_inverted, SCHEMA)
    (
        rows.write.option("compression", "zstd")
        .option("parquet.block.size", GROUP_BYTES)
        .option("parquet.page.size", PAGE_BYTES)
        .option("parquet.page.row.count.limit", PAGE_ROWS)
        .parquet(path)
    )


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def decoded(postings: DataFrame) -> DataFrame:
    """``term, chunk_id, tf`` of stored ``postings``, shard by shard."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks, held = np.zeros(0, np.int64), 0
        for batch in few_rows(batches, 1000):
            terms, sizes, ids, counts = [], [], [], []

            def listed() -> pa.RecordBatch:
                text = pa.array(terms, pa.string()).take(pa.array(np.repeat(np.arange(len(terms), dtype=np.int32), sizes)))
                out = pa.record_batch([text, pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts))], names=["term", "chunk_id", "tf"])
                for kept in (terms, sizes, ids, counts):
                    kept.clear()
                return out

            for term, places, tf in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                if term == CHUNKS:  # the first of its shard
                    chunks = _ids(places)
                    continue
                ids.append(chunks[unpacked(places)])
                counts.append(unpacked(tf))
                sizes.append(len(ids[-1]))
                terms.append("".join(chr(term >> k & 0x1FFFFF) for k in (42, 21, 0)))
                held += sizes[-1]
                if held >= DECODED:
                    yield listed()
                    held = 0
            if terms:
                yield listed()
                held = 0

    n = int(postings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = postings.select("shard", "term", "places", "counts").repartition(n, "shard").sortWithinPartitions("shard", "term")
    return dealt.mapInArrow(rows, "term string, chunk_id long, tf long")


def of_terms(terms: list[int], ranges: int = RANGES) -> Column:
    """A filter on ``term`` that the files' statistics can judge: the terms, or as many ranges that hold them, cut at the widest gaps."""
    terms = sorted(set(terms))
    gaps = sorted(range(1, len(terms)), key=lambda k: terms[k - 1] - terms[k])[: max(0, ranges - 1)]
    edges = [0, *sorted(gaps), len(terms)]
    term = F.col("term")
    parts = [term == terms[a] if b - a == 1 else term.between(terms[a], terms[b - 1]) for a, b in zip(edges, edges[1:], strict=False) if a < b]
    while len(parts) > 1:  # a flat tree of alternatives
        parts = [parts[k] | parts[k + 1] if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
    return parts[0] if parts else F.lit(False)


class Best:
    """The k best chunks of each query over all that was added; ties by id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids = [np.zeros(0, np.int64)] * queries
        self.scores = [np.zeros(0)] * queries

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        own = self.scores[query]
        if len(own) == self.k:  # what ties with the last may still win by its id
            some = scores >= own[-1]
            ids, scores = ids[some], scores[some]
        if not len(ids):
            return
        if len(ids) > self.k:
            some = scores >= np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
            ids, scores = ids[some], scores[some]
        ids, scores = np.concatenate([self.ids[query], ids]), np.concatenate([own, scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[query], self.scores[query] = ids[order], scores[order]

    def rows(self, names: np.ndarray, score: str) -> Iterator[pa.RecordBatch]:
        sizes = [len(x) for x in self.ids]
        if sum(sizes):
            yield pa.record_batch([pa.array(np.repeat(names, sizes)), pa.array(np.concatenate(self.ids)), pa.array(np.concatenate(self.scores))], names=["query_id", "chunk_id", score])


def score_shard(best: Best, chunks: np.ndarray, norm: np.ndarray, held: list[tuple[int, bytes, bytes]], lists: dict[int, list[int]], idf: dict[int, float]) -> None:
    """Adds a shard's chunks to the ``best`` of each query; ``held`` are its postings (term, places, counts) of the queries' terms.

    A query that has k chunks takes no other below the last of them. Its rarer terms are added up first, then frequent ones, the greatest first, until the
    others together can't lift a chunk without them that far; these are looked up for the chunks that they still can. Nothing that may be among the best is left out.
    """
    postings, mine = [], [[] for _ in best.ids]
    for n, (term, places, counts) in enumerate(held):
        places, tf = unpacked(places), unpacked(counts)
        postings.append((places, idf[term] * tf * (K1 + 1) / (tf + norm[places])))
        for q in lists[term]:
            mine[q].append(n)
    most = np.array([part.max() for _, part in postings])
    sizes = np.array([len(places) for places, _ in postings])
    frequent = np.argsort(-sizes, kind="stable")[: SCORES // max(1, len(chunks))]
    frequent = frequent[sizes[frequent] * 16 >= len(chunks)]
    row, dense = np.full(len(postings), -1), np.zeros((len(frequent), len(chunks)))
    for r, n in enumerate(frequent.tolist()):
        row[n] = r
        dense[r, postings[n][0]] = postings[n][1]
    for q, own in enumerate(mine):
        if not own:
            continue
        terms = np.array(own)
        floor = best.scores[q][-1] - 2e-6 if len(best.scores[q]) == best.k else -1.0  # scores are rounded to 6 digits
        if most[terms].sum() < floor:
            continue
        score = np.zeros(len(chunks))
        for n in terms[row[terms] < 0].tolist():
            places, part = postings[n]
            score[places] += part
        terms = terms[row[terms] >= 0]
        terms = terms[np.argsort(-most[terms], kind="stable")]
        rest = np.append(np.cumsum(most[terms][::-1])[::-1], 0.0)  # what terms from here on can add
        added = int(np.argmax(rest < floor)) if floor > 0 and (rest < floor).any() else len(terms)
        for r in row[terms[:added]].tolist():
            score += dense[r]
        hit = np.flatnonzero(score >= floor - rest[added]) if added < len(terms) else np.flatnonzero(score)  # any term in common scores above 0
        found = score[hit]
        while added < len(terms) and len(hit):
            found = found + dense[np.ix_(row[terms[added : added + 8]], hit)].sum(axis=0)
            added = min(len(terms), added + 8)
            able = found >= floor - rest[added]
            hit, found = hit[able], found[able]
        able = found >= floor
        if able.any():
            best.add(q, chunks[hit[able]], np.round(found[able], 6))


def keyword_candidates(queries: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """``query_id, chunk_id, score``: of each task's shards the k best chunks of each query (query_id, query_text), by BM25 over any of its terms.

    Scores are rounded to 6 digits, ties go by id. Queries go out in blocks of ``QUERIES``, 64 terms each at most.
    """
    spark = postings.sparkSession
    size = postings.where(F.col("term") == CHUNKS).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    asked = queries.select("query_id", F.explode(T.query_terms(F.col("query_text"))).alias("term"))
    blocks = max(1, -(-queries.count() // QUERIES))
    found = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        lists = {term_number(r["term"]): r["ids"] for r in block.groupBy("term").agg(F.collect_list("query_id").alias("ids")).collect()}  # 64 x QUERIES numbers at most
        mine = spark.createDataFrame([(t,) for t in lists], ST.StructType([ST.StructField("of", ST.LongType())]))
        there = postings.where(of_terms(list(lists)))
        there = there.join(F.broadcast(mine), F.col("term") == F.col("of"), "left_semi")
        df = dict(there.groupBy("term").agg(F.sum("n")).collect())  # a row per term
        ids = sorted({q for own in lists.values() for q in own})
        place = {q: n for n, q in enumerate(ids)}
        idf = {t: max(float(np.log((size[0] - n + 0.5) / (n + 0.5))), IDF_FLOOR) for t, n in df.items()}
        shared = spark.sparkContext.broadcast(({t: [place[q] for q in own] for t, own in lists.items()}, idf, np.array(ids, np.int64), size[1] / size[0] if size[0] else 0.0))

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lists, idf, names, average = shared.value
            best = Best(len(names), k)
            current, held, chunks, norm = None, [], np.zeros(0, np.int64), np.zeros(0)

            def close() -> None:
                if held:
                    score_shard(best, chunks, norm, held, lists, idf)
                held.clear()

            for batch in batches:
                for shard, term, places, counts in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                    if shard != current:
                        close()
                        current = shard
                    if term == CHUNKS:  # the first of its shard
                        chunks = _ids(places)
                        norm = K1 * (1 - B + B * unpacked(counts) / average)
                    else:
                        held.append((term, places, counts))
            close()
            yield from best.rows(names, "score")

        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        rows = there.unionByName(postings.where(F.col("term") == CHUNKS)).select("shard", "term", "places", "counts")
        part = rows.repartition(n, "shard").sortWithinPartitions("shard", "term").mapInArrow(score, "query_id long, chunk_id long, score double")
        found = part if found is None else found.unionByName(part)
    return found
