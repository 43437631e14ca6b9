"""Stored postings: scores by brute force, pages read, rows that leave the tasks, the running best."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as T
from siftwell.operators import postings as P
from siftwell.operators import search as S


def corpus(n=400):
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefghijklmno", k=rng.randint(3, 7))) for _ in range(300)]
    rows = [(k, " ".join(rng.choices(words, k=rng.randint(0, 60)))) for k in range(n)]
    return rows + [(n, None), (n + 1, ""), (n + 2, "ab"), (n + 3, "ไทย ภาษา ABC İstanbul 漢字仮名"), (n + 4, rows[3][1]), (-5, rows[3][1])]


def brute(queries, rows, k):
    lower = [(i, "".join(c.lower() if c != "İ" else "i̇" for c in t or "")) for i, t in rows]
    grams = {i: [t[j : j + 3] for j in range(len(t) - 2)] for i, t in lower}
    lengths = {i: max(0, len(t or "") - 2) for i, t in rows}
    n, mean = len(rows), sum(lengths.values()) / len(rows)
    out = []
    for q, terms in queries:
        scores = {}
        for t in terms:
            df = sum(t in g for g in grams.values())
            idf = max(math.log((n - df + 0.5) / (df + 0.5)), 1e-6)
            for i, g in grams.items():
                if tf := g.count(t):
                    scores[i] = scores.get(i, 0.0) + idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[i] / mean))
        out += [(q, i, round(s, 6), r) for r, (s, i) in enumerate(sorted(((-round(s, 6), i) for i, s in scores.items()))[:k], 1) for s in [-s]]
    return sorted(out)


def questions(spark, rows):
    asked = spark.createDataFrame([(i, t) for i, t in rows if i % 40 == 0 or t is None or "ไทย" in t], "query_id long, query_text string")
    terms = asked.select("query_id", T.query_terms(F.col("query_text")).alias("t")).where("t is not null").collect()
    return asked, [(r["query_id"], r["t"]) for r in terms]


@pytest.mark.parametrize(("chunks", "scores"), [(4096, 4_000_000), (7, 50)])
def test_stored_search_equals_brute_force(spark, tmp_path, monkeypatch, chunks, scores):
    """One shard a task, and many shards with score matrices of a few rows."""
    monkeypatch.setattr(P, "SHARD_CHUNKS", chunks)
    monkeypatch.setattr(P, "SCORES", scores)
    rows = corpus()
    P.write_postings(spark.createDataFrame(rows, "chunk_id long, text string").repartition(5), str(tmp_path / "p"))
    asked, terms = questions(spark, rows)
    got = sorted(tuple(r) for r in S.keyword_search(asked, P.read_postings(spark, str(tmp_path / "p")), 12).select("query_id", "chunk_id", "score", "rank").collect())
    want = brute(terms, rows, 12)
    assert [(q, i, r) for q, i, _, r in got] == [(q, i, r) for q, i, _, r in want]
    assert [s for *_, s, _ in got] == pytest.approx([s for *_, s, _ in want], abs=2e-6)


def test_stored_postings_are_those_counted(spark, tmp_path):
    rows = spark.createDataFrame(corpus(), "chunk_id long, text string")
    vectors = spark.createDataFrame([(i, [1.0, float(i)]) for i, _ in corpus()[:50]], "chunk_id long, embedding array<double>")
    S.write_search_index(rows.withColumn("project", F.lit("p")), vectors, str(tmp_path / "index"))
    stored = P.decoded(P.read_postings(spark, str(tmp_path / "index/postings")))
    assert sorted(map(tuple, stored.collect())) == sorted(map(tuple, S.trigram_postings(rows).collect()))
    asked = spark.createDataFrame([(1, rows.where("chunk_id = 40").first()["text"], [0.5, 2.0])], "query_id long, query_text string, query_vector array<double>")
    want = S.hybrid_search(asked, rows, vectors, 7)
    assert sorted(map(str, S.stored_search(asked, str(tmp_path / "index"), 7).collect())) == sorted(map(str, want.collect()))


def test_search_of_an_empty_corpus_or_without_terms(spark, tmp_path):
    asked = spark.createDataFrame([(1, "some words"), (2, None), (3, "a b")], "query_id long, query_text string")
    for k, rows in enumerate(([], [(1, None)], [(1, "nothing alike")])):
        P.write_postings(spark.createDataFrame(rows, "chunk_id long, text string"), str(tmp_path / str(k)))
        assert S.keyword_search(asked, P.read_postings(spark, str(tmp_path / str(k))), 5).collect() == []
    assert S.keyword_search(asked.where("query_id > 1"), P.read_postings(spark, str(tmp_path / "2")), 5).collect() == []


def _bytes_read(spark, run):
    """Bytes that the stages of ``run`` read from files."""
    store = spark._jsc.sc().statusStore()

    def stages():
        found = store.stageList(None, *(getattr(store, f"stageList$default${k}")() for k in range(2, 6)))
        return {(s.stageId(), s.attemptId()): s.inputBytes() for s in (found.apply(k) for k in range(found.size()))}

    before = set(stages())
    run()
    spark._jsc.sc().listenerBus().waitUntilEmpty(20_000)
    return sum(v for k, v in stages().items() if k not in before)


def test_a_question_reads_its_terms_pages_only(spark, tmp_path):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(9000)]
    rows = [(k, " ".join(rng.choices(words, k=150))) for k in range(2500)] + [(9999, "zzyzx quux")]
    path = str(tmp_path / "p")
    P.write_postings(spark.createDataFrame(rows, "chunk_id long, text string").coalesce(1), path)
    # reads in threads of their own are not counted
    postings = spark.read.option("parquet.hadoop.vectored.io.enabled", "false").schema(P.SCHEMA).parquet(path)
    whole = _bytes_read(spark, lambda: postings.write.format("noop").mode("overwrite").save())
    one = spark.createDataFrame([(1, "zzyzx")], "query_id long, query_text string")
    read = _bytes_read(spark, lambda: S.keyword_search(one, postings, 5).collect())
    assert S.keyword_search(one, postings, 5).orderBy("rank").first()["chunk_id"] == 9999
    assert whole > 1_000_000 and 0 < read < whole / 4, (read, whole)


def test_filters_hold_all_terms_in_few_ranges(spark):
    rng = random.Random(1)
    terms = [rng.randrange(1 << 40) for _ in range(500)]
    rows = spark.createDataFrame([(t,) for t in terms] + [(1 << 50,)], "term long")
    for ranges in (1, 7, 200, 1000):
        where = P.of_terms(terms, ranges)
        assert rows.where(where).count() == 500
    assert rows.where(P.of_terms([])).count() == 0


def test_tasks_emit_no_more_than_the_best_of_each_query(spark):
    rng = np.random.default_rng(3)
    vectors = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(9000)], "chunk_id long, embedding array<double>").repartition(3)
    asked = spark.createDataFrame([(k, rng.normal(size=8).tolist()) for k in range(20)], "query_id long, query_vector array<double>")
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)  # many batches a task
    try:
        assert S.dense_candidates(asked, vectors, 5).count() == 5 * 20 * 3
        texts = spark.createDataFrame(corpus(3000), "chunk_id long, text string").repartition(3)
        queries = asked.select("query_id", F.lit("abc def ghi jkl").alias("query_text"))
        S.write_postings(texts, path := S.shared_folder(spark, "postings"))
        found = S.keyword_candidates(queries, S.read_postings(spark, path), 5).groupBy(F.spark_partition_id().alias("part"), "query_id").count().collect()
        assert found and all(r["count"] <= 5 for r in found)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)


def test_the_running_best_equals_one_sort():
    rng = np.random.default_rng(6)
    for _ in range(200):
        best, rows = P.Best(1, 4), []
        for _ in range(rng.integers(1, 6)):
            ids, scores = rng.integers(0, 1000, n := rng.integers(1, 9)), rng.integers(0, 4, n) / 2
            rows += zip(ids.tolist(), scores.tolist())
            best.add(0, ids, scores)
        want = sorted(rows, key=lambda r: (-r[1], r[0]))[:4]
        assert list(zip(best.ids[0].tolist(), best.scores[0].tolist())) == want


def test_numbers_keep_their_values_in_few_bytes():
    for values in ([], [0], [255], [256, 3], [70_000], [1 << 33]):
        data = P.packed(np.array(values, np.int64))
        assert P.unpacked(data).tolist() == values
    assert len(P.packed(np.array([255] * 10))) == 11


@pytest.mark.parametrize("scores", [4_000_000, 800, 0])
def test_pruned_scores_equal_plain_sums(monkeypatch, scores):
    monkeypatch.setattr(P, "SCORES", scores)
    rng, adds = np.random.default_rng(4), []

    class Counted(P.Best):
        def add(self, query, ids, scores):
            adds.append(len(ids))
            super().add(query, ids, scores)

    terms = {t: (float(rng.choice([1e-6, 0.3, 1.0, 4.0])), rng.choice([0.02, 0.3, 0.8])) for t in range(60)}
    lists = {t: sorted(set(rng.integers(0, 9, 4).tolist())) for t in terms}
    idf = {t: w for t, (w, _) in terms.items()}
    best, plain, whole = Counted(10, 5), [{} for _ in range(10)], 0  # the tenth query has no term
    for shard in range(8):
        chunks, norm = np.arange(100) * 8 + shard, rng.uniform(0.3, 3, 100)
        held = []
        for t, (_, share) in terms.items():
            places = np.flatnonzero(rng.random(100) < share)
            if len(places):
                counts = rng.integers(1, 4, len(places))
                held.append((t, P.packed(places), P.packed(counts)))
                for q in lists[t]:
                    for at, tf in zip(places.tolist(), counts.tolist()):
                        plain[q][chunks[at]] = plain[q].get(chunks[at], 0.0) + idf[t] * tf * (P.K1 + 1) / (tf + norm[at])
        P.score_shard(best, chunks, norm, held, lists, idf)
    for q, own in enumerate(plain):
        whole += len(own)
        want = sorted(own.items(), key=lambda x: (-round(x[1], 6), x[0]))[:5]
        assert best.ids[q].tolist() == [i for i, _ in want]
        assert best.scores[q] == pytest.approx([s for _, s in want], abs=2e-6)
    assert sum(adds) < whole / 3  # all of them before
