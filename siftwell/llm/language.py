"""Language ID by compression: the language whose zstandard dictionary codes a text best.

Training takes a bounded sample of labelled texts per language (whole texts of at most ``Limits.docs`` rows with the smallest
hash, up to ``Limits.dictionary_bytes``); that sample is all that reaches the driver. Each language's sample is a raw-content
dictionary. A text is coded with every dictionary, and the smallest code wins. Prediction is one narrow
pass over whole texts.

Defined results: null text, or text without a letter, gives ``und`` and score 0; ties go to the language
that comes first by name; null ids count as bucket 0; a text of any length is coded whole; with no labelled rows everything is ``und``; repeated rows are predicted alike. Rows with
score below ``Limits.margin`` are marked ``rejected`` and keep their best guess.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bucket, in_tasks


#: ASCII other than letters becomes a space, so that case, digits and marks do not count.
_LETTERS = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in range(256))


def normalised(text: str) -> bytes:
    return text.lower().encode().translate(_LETTERS)


@dataclass(frozen=True)
class Limits:
    docs: int = 200
    dictionary_bytes: int = 96 * 1024
    level: int = 6
    margin: float = 0.02


def dictionaries(train: DataFrame, limits: Limits = Limits()) -> dict[str, bytes]:
    """Raw-content dictionary per language from rows (doc_id, text, lang): whole texts in the order of a hash, up to the bounds.

    The hash is uniform, so the first ``limits.docs`` of a language lie below a share of its range that the language's count
    gives, with some room; only those rows are sorted and taken. The counts, a row per language, are broadcast.
    """
    rows = train.where("lang is not null and text is not null and text rlike '\\\\p{L}'").select("lang", F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40)).alias("h"), "doc_id", "text")
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("all"))
    room = limits.docs + 8 * limits.docs**0.5
    near = rows.join(F.broadcast(counts), "lang").where(F.col("h") <= F.lit(room * (1 << 40)) / F.col("all"))
    cut = near.select("lang", "h", "doc_id", F.substring("text", 1, limits.dictionary_bytes).alias("text"))  # more than a dictionary never takes
    texts: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for r in cut.orderBy("lang", "h", "doc_id", "text").toLocalIterator():
        own = texts.setdefault(r["lang"], [])
        if len(own) < limits.docs and sizes.get(r["lang"], 0) < limits.dictionary_bytes:
            own.append(normalised(r["text"]))
            sizes[r["lang"]] = sizes.get(r["lang"], 0) + len(own[-1]) + 1
    return {k: b"\n".join(v)[: limits.dictionary_bytes] for k, v in texts.items()}


def predicted(docs: DataFrame, train: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score and rejected."""
    samples = docs.sparkSession.sparkContext.broadcast(sorted(dictionaries(train, limits).items()))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coders = []
        for lang, sample in samples.value:
            content = zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=limits.level)
            coders.append((lang, zstandard.ZstdCompressor(level=limits.level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)))
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1).to_pylist():
                if not coders or not text or not any(map(str.isalpha, text)):
                    langs.append("und")
                    scores.append(0.0)
                    continue
                data = normalised(text)
                sizes = sorted((len(c.compress(data)), k) for k, c in coders) if len(coders) > 1 else [(1, coders[0][0]), (2, "")]
                langs.append(sizes[0][1])
                scores.append(1 - sizes[0][0] / sizes[1][0])
            yield pa.record_batch([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    out = docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(in_tasks, predict, "doc_id long, lang_pred string, score double")
    return out.withColumn("rejected", F.col("score") < limits.margin)


def held_out_prediction(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Learns from ids outside crc32 bucket 2 of 4 and predicts every row."""
    out = id_bucket(4) == 2
    return predicted(docs, docs.where(~out), limits).withColumn("held_out", out)
