"""Importance resampling: choose documents by the ratio of two hashed n-gram models.

Words and word pairs of the lower-cased text fall by hash into a fixed number of buckets. One bag-of-buckets
model is counted over all documents (raw), one over trusted documents (target: labelled good and not toxic). A document's log ratio
is the sum over its n-grams of log(target / raw). Gumbel noise on the log ratio and a top-k give a sample without
replacement in proportion to the ratio. The noise is a hash of the id, so a run can be repeated.

The target model is smoothed towards the raw one, so n-grams that the trusted documents are too few to judge count little.

Bounds: the models are arrays of ``buckets`` numbers; the target ids are at most ``target_docs`` (those of least hash),
a documented sample of labelled rows; raw counts and scores cover all words of all documents. The top-k is a global ranking over
range partitions.

Defined results: null or empty texts have no n-grams and log ratio 0; repeated rows are scored alike and ranked one after the
other; null ids share one draw of noise; a text of any length is counted whole; without target documents all ratios are 0; an empty table gives an empty table; ties in the key go by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import in_tasks, ranked, text_bytes, written


@dataclass(frozen=True)
class Settings:
    buckets: int = 1 << 15
    target_docs: int = 20_000
    #: Weight of the raw model in the target model, as a share of the target's n-grams.
    smoothing: float = 0.02
    #: Share of the documents chosen.
    share: float = 0.8
    seed: int = 1


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxh64_intdigest(word, 3) >> 1
        return value


def grams(texts: list[bytes | None], hashes: WordHashes, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram of each text, and which text it is from."""
    words: list[int] = []
    ends = []
    for t in texts:
        if t:
            words.extend(map(hashes.__getitem__, t.lower().split()))
        ends.append(len(words))
    w = np.array(words, np.uint64)
    lengths = np.diff(np.array([0, *ends], np.int64))
    doc = np.repeat(np.arange(len(texts)), lengths)
    same = doc[1:] == doc[:-1]
    pair = (w[:-1] * np.uint64(0x9E3779B97F4A7C15) + w[1:])[same] * np.uint64(0xD6E8FEB86659FD93)
    shift = np.uint64(64 - buckets.bit_length() + 1)
    one = w * np.uint64(0xA0761D6478BD642F)
    return (np.concatenate([one, pair]) >> shift).astype(np.int64), np.concatenate([doc, doc[1:][same]])


def model(docs: DataFrame, buckets: int) -> np.ndarray:
    """N-grams per bucket over all of ``docs``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, hashes = np.zeros(buckets, np.int64), WordHashes()
        for batch in batches:
            total += np.bincount(grams(text_bytes(batch), hashes, buckets)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select("doc_id", "text").transform(in_tasks, count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row per bucket
    out = np.zeros(buckets)
    for bucket, n in rows:
        out[bucket] = n
    return out


def log_ratios(raw: np.ndarray, target: np.ndarray, smoothing: float) -> np.ndarray:
    """log(target / raw) per bucket; 0 where nothing is known."""
    if not raw.sum() or not target.sum():
        return np.zeros(len(raw))
    p = raw / raw.sum()
    extra = smoothing * target.sum()
    q = (target + extra * p) / (target.sum() + extra)
    return np.log(np.divide(q, p, out=np.ones(len(raw)), where=p > 0))


def resampled(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id, n_grams, log_ratio, gumbel_key, rank, kept`` per row of ``docs``."""
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    good = labels.where("quality = 1 and toxic = 0 and doc_id is not null").selectExpr("cast(doc_id as long) doc_id").distinct()
    good = good.orderBy(F.xxhash64("doc_id", F.lit("target")), "doc_id").limit(settings.target_docs)
    raw = model(docs, settings.buckets)
    target = model(docs.join(F.broadcast(good), "doc_id", "left_semi"), settings.buckets)
    shared = docs.sparkSession.sparkContext.broadcast(log_ratios(raw, target, settings.smoothing))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            bucket, doc = grams(text_bytes(batch), hashes, settings.buckets)
            sums = np.bincount(doc, weights=shared.value[bucket], minlength=batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(np.bincount(doc, minlength=batch.num_rows)), pa.array(sums)], names=["doc_id", "n_grams", "log_ratio"])

    # written, as the ranking reads it twice: once for the borders of the ranges
    scored = written(docs.transform(in_tasks, score, "doc_id long, n_grams long, log_ratio double"), "resample-scores")
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(settings.seed)), F.lit((1 << 40) - 1)) + 0.5) / float((1 << 40) - 1)
    keyed = scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(uniform)))
    line = ranked(keyed, [F.col("gumbel_key").desc(), F.col("doc_id")], "resample")
    total = line.count()
    return line.withColumn("kept", F.col("rank") < F.floor(F.lit(total) * settings.share))
