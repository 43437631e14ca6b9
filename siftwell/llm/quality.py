"""Quality rules: word and line rules, then zstandard compression bands.

``judged`` gives a row of figures per document, ``kept`` the documents that pass with all their columns.
Both read whole texts in one narrow pass: no shuffle, memory bounded by one Arrow batch.

Defined results: a null or empty text has no words, so it fails the base rules; repeated rows are judged
alike, also under null ids; a text of any length is compressed whole and by chunks; an empty table gives an empty table; columns besides ``doc_id`` and ``text`` are never read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import SPACES, in_tasks, text_bytes

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8


@dataclass(frozen=True)
class Bands:
    """Limits of bytes / compressed bytes, each as (bytes below which it holds, least, most).

    The least lies between base64 (0.95 at 120 bytes, 1.08 at 200, 1.19 at 400, 1.30 at 800, 1.35 at 1,500, 1.39 at 8,000)
    and the lowest thousandth of prose (1.13, 1.11, 1.34, 1.47, 1.73, 2.12); most prose stays below 2.8 at any length.
    """

    level: int = 3
    whole: tuple[tuple[float, float, float], ...] = (
        (160, 1.0, 2.5),
        (256, 1.08, 2.5),
        (512, 1.25, 2.7),
        (1024, 1.36, 3.0),
        (4096, 1.45, 3.5),
        (16384, 1.5, 4.0),
        (float("inf"), 1.5, 4.5),
    )
    chunk_bytes: int = 4096
    #: Shorter rests than this share of a chunk are only judged as part of the whole.
    chunk_share: float = 0.5
    chunk: tuple[tuple[float, float, float], ...] = ((3072, 1.42, 3.8), (float("inf"), 1.45, 4.0))
    min_words: int = 20
    max_repeat_percent: int = 30


SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, ratio double, chunk_min double, chunk_max double"
)
_ARROW = pa.schema(
    [("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [("base_failed", pa.bool_()), ("kept", pa.bool_())]
    + [(c, pa.float64()) for c in ("ratio", "chunk_min", "chunk_max")]
)


def repeat_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``window`` words that occur twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    windows = list(zip(*(words[i : n + i] for i in range(window)), strict=True))
    if len(set(windows)) == n:
        return 0
    counts = Counter(windows)
    edges = np.zeros(len(words) + 1, np.int64)
    starts = np.fromiter((i for i, w in enumerate(windows) if counts[w] > 1), np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + window, -1)
    return int((np.cumsum(edges) > 0).sum())


def inside(ratio: float, size: int, limits: tuple[tuple[float, float, float], ...]) -> bool:
    low, high = next((low, high) for below, low, high in limits if size < below)
    return low <= ratio <= high


def figures(text: bytes | None, bands: Bands, zstd: zstandard.ZstdCompressor) -> tuple:
    """One document's figures, in the order of ``SCHEMA`` after ``doc_id``."""
    b = text or b""
    words = b.split()
    n = len(words)
    chars = len(b.decode("utf-8", "replace")) - (len(b) - len(b.translate(None, SPACES)))
    symbols = len(b) - len(b.translate(None, SYMBOLS))
    lines = [x for x in b.split(b"\n") if x.strip()]
    repeated = repeat_words(words)
    failed = n < bands.min_words or 100 * repeated > bands.max_repeat_percent * n
    if not b:
        return (n, chars, symbols, 0, repeated, failed, False, None, None, None)
    ratio = len(b) / len(zstd.compress(b))
    step = bands.chunk_bytes
    parts = [b[i : i + step] for i in range(0, len(b), step)] if len(b) > step else []
    parts = [x for x in parts if len(x) >= step * bands.chunk_share]
    ratios = [len(x) / len(zstd.compress(x)) for x in parts]
    good = inside(ratio, len(b), bands.whole) and all(inside(r, len(x), bands.chunk) for r, x in zip(ratios, parts, strict=True))
    return (n, chars, symbols, len(lines) - len(set(lines)), repeated, failed, good and not failed, ratio, min(ratios, default=ratio), max(ratios, default=ratio))


def judged(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Figures and verdict per row of ``docs``."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            rows = [figures(t, bands, zstd) for t in text_bytes(batch)]
            columns = [batch.column(0), *(zip(*rows, strict=True) if rows else [[]] * (len(_ARROW) - 1))]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _ARROW, strict=True)], schema=_ARROW)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(in_tasks, judge, SCHEMA)


def kept(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """The rows of ``docs`` that pass, with all their columns."""

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        zstd = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            yield batch.filter(pa.array([figures(t, bands, zstd)[6] for t in text_bytes(batch)], pa.bool_()))

    return docs.transform(in_tasks, sift, docs.schema)
