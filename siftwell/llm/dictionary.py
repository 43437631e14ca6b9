"""Work once per distinct word: chunk dictionaries out, values back by chunk.

Documents are taken in chunks of bounded text inside each task. A chunk has a dictionary of its distinct words, numbered
by falling count. ``vocabulary`` gives a row for each word of each dictionary, to be dealt by word so that each distinct
word is worked on once; ``streams`` gives the chunk's documents as word numbers, position by position, coded in few bytes. The
values found for the words return as ``packed`` rows and meet the streams by chunk in ``reassembled``.

A frequent word costs one row per chunk, not one per occurrence. The two functions read the documents
separately and must see the same rows in the same order in each partition, as a table scan gives; a chunk whose
dictionary did not come back whole raises an error rather than giving wrong rows. ``both`` makes the two in one read and
writes them, which costs disk and saves the second read.
"""

from __future__ import annotations

from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_tasks, release_memory, text_bytes, written

#: Most bytes of text in a chunk (one document may be longer).
CHUNK_BYTES = 24 << 20

#: Cuts a text's bytes (never null) into units, and a unit into its words as bytes. Units that recur are cut once per chunk.
Split = tuple[Callable[[bytes], list], Callable[[object], list[bytes]]]


class Numbers(dict):
    """Number of a word in order of arrival."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def _chunks(batches: Iterator[pa.RecordBatch], make_split: Callable[[], Split], chunk_bytes: int) -> Iterator[tuple]:
    """(chunk, doc ids, extra columns, words per document, word numbers, words) for each chunk.

    Words are numbered by falling count, then by arrival.
    """
    units_of, words_of = make_split()
    context = TaskContext.get()
    part, seq = (context.partitionId() if context else 0), 0
    ids, extras, coded, numbers, known, size = [], [], [], Numbers(), {}, 0

    def chunk() -> tuple:
        arrived = np.frombuffer(b"".join(coded), np.int32)
        counts = np.bincount(arrived, minlength=len(numbers))
        order = np.argsort(-counts, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        words = list(numbers)
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        return (part << 24) + seq, ids, extras, lengths.astype(np.int32), place[arrived], [words[k] for k in order.tolist()]

    for batch in batches:
        more = [batch.column(k).to_pylist() for k in range(2, batch.num_columns)]
        for at, (doc, text) in enumerate(zip(batch.column(0).to_pylist(), text_bytes(batch), strict=True)):
            if size and size + len(text or b"") > chunk_bytes:
                yield chunk()
                ids, extras, coded, numbers, known, size = [], [], [], Numbers(), {}, 0
                seq += 1
            units = units_of(text) if text else []
            try:
                line = b"".join(map(known.__getitem__, units))
            except KeyError:
                for u in [u for u in dict.fromkeys(units) if u not in known]:
                    words = words_of(u)
                    known[u] = numbers[words[0]].to_bytes(4, "little") if len(words) == 1 else array("i", map(numbers.__getitem__, words)).tobytes()
                line = b"".join(map(known.__getitem__, units))
            coded.append(line)
            ids.append(doc)
            extras.append([c[at] for c in more])
            size += len(text or b"") + 1
    if ids:
        yield chunk()


def vocabulary(docs: DataFrame, make_split: Callable[[], Split], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``word, chunk, at``: every word of every chunk's dictionary. ``docs`` is (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, _, _, _, _, words in _chunks(batches, make_split, chunk_bytes):
            for part, some in _sorted(words):
                yield pa.record_batch([some, pa.array(np.full(len(part), chunk, np.int64)), pa.array(part)], names=["word", "chunk", "at"])

    return docs.select("doc_id", "text").transform(in_tasks, run, "word binary, chunk long, at int")


def _sorted(words: list[bytes], rows_at_once: int = 50_000) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Numbers of ``words`` and the words, in the words' order: neighbours share bytes in the shuffle."""
    order = sorted(range(len(words)), key=words.__getitem__)
    for k in range(0, len(order), rows_at_once):
        part = order[k : k + rows_at_once]
        yield np.array(part, np.int32), pa.array([words[i] for i in part], pa.binary())


def _coded(flat: np.ndarray) -> tuple[bytes, bytes]:
    """Numbers as a byte each, 255 standing for larger ones, which follow in three byte planes."""
    zstd = zstandard.ZstdCompressor(level=3)
    large = flat[flat >= 255]
    planes = np.concatenate([(large >> s & 255).astype(np.uint8) for s in (0, 8, 16, 24)])
    return zstd.compress(np.minimum(flat, 255).astype(np.uint8).tobytes()), zstd.compress(planes.tobytes())


def _decoded(small: bytes, large: bytes) -> np.ndarray:
    zstd = zstandard.ZstdDecompressor()
    flat = np.frombuffer(zstd.decompress(small), np.uint8).astype(np.int32)
    planes = np.frombuffer(zstd.decompress(large), np.uint8).astype(np.int32).reshape(4, -1)
    flat[flat == 255] = sum(planes[k] << 8 * k for k in range(4))
    return flat


def _stream_row(chunk: int, ids: list, lengths: np.ndarray, flat: np.ndarray, words: list[bytes]) -> tuple[list[pa.Array], list[str]]:
    small, large = _coded(flat)
    columns = [pa.array([chunk]), pa.array([len(words)], pa.int32()), pa.array([ids], pa.list_(pa.int64())), pa.array([lengths.tolist()], pa.list_(pa.int32())), pa.array([small]), pa.array([large])]
    return columns, ["chunk", "n_words", "doc_ids", "lengths", "small", "large"]


def streams(docs: DataFrame, make_split: Callable[[], Split], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """A row per chunk: its documents' ids and lengths in words, and their word numbers in order, coded."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, _, lengths, flat, words in _chunks(batches, make_split, chunk_bytes):
            columns, names = _stream_row(chunk, ids, lengths, flat, words)
            yield pa.record_batch(columns, names=names)

    return docs.select("doc_id", "text").transform(in_tasks, run, "chunk long, n_words int, doc_ids array<long>, lengths array<int>, small binary, large binary")


def both(docs: DataFrame, make_split: Callable[[], Split], classes: int, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, DataFrame]:
    """Vocabulary and streams from one read of ``docs`` (doc_id, text, class), by way of a written table.

    The vocabulary has, besides ``word, chunk, at``, how often the chunk's documents of each class from 1 to ``classes`` have the
    word, as ``n1``, ``n2``, ...; other classes are not counted.
    """
    counts = [f"n{k}" for k in range(1, classes + 1)]
    schema = pa.schema([("chunk", pa.int64()), ("word", pa.binary()), ("at", pa.int32()), *((c, pa.int64()) for c in counts), ("n_words", pa.int32()), ("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int32())), ("small", pa.binary()), ("large", pa.binary())])

    def batch(n: int, columns: dict[str, pa.Array]) -> pa.RecordBatch:
        return pa.record_batch([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk, ids, extras, lengths, flat, words in _chunks(batches, make_split, chunk_bytes):
            kinds = np.repeat(np.array([x[0] or 0 for x in extras], np.int32), lengths)
            n = [np.bincount(flat[kinds == k], minlength=len(words)) for k in range(1, classes + 1)]
            for part, some in _sorted(words):
                yield batch(len(part), {"chunk": pa.array(np.full(len(part), chunk, np.int64)), "word": some, "at": pa.array(part)} | {c: pa.array(x[part].astype(np.int64)) for c, x in zip(counts, n, strict=True)})
            columns, names = _stream_row(chunk, ids, lengths, flat, words)
            yield batch(1, dict(zip(names, columns, strict=True)))

    table = written(docs.transform(in_tasks, run, "chunk long, word binary, at int, " + "".join(f"{c} long, " for c in counts) + "n_words int, doc_ids array<long>, lengths array<int>, small binary, large binary"), "chunks")
    return table.where("word is not null").select("word", "chunk", "at", *counts), table.where("n_words is not null").select("chunk", "n_words", "doc_ids", "lengths", "small", "large")


PACKED = "chunk long, at binary, sizes binary, values binary"


def packed(chunk: np.ndarray, at: np.ndarray, sizes: np.ndarray, values: np.ndarray) -> pa.RecordBatch:
    """Values (``sizes[i]`` of them for entry i of ``at``) as one row per chunk."""
    order = np.argsort(chunk, kind="stable")
    ends = np.cumsum(sizes)
    starts = ends - sizes
    cut = np.flatnonzero(np.diff(chunk[order])) + 1
    rows: list[list] = [[], [], [], []]
    for part in np.split(order, cut) if len(order) else []:
        n = sizes[part]
        total = int(n.sum())
        take = np.arange(total) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[part], n)
        for column, x in zip(rows, (int(chunk[part[0]]), at[part].astype("<i4").tobytes(), n.astype("<u4").tobytes(), values[take].tobytes()), strict=True):
            column.append(x)
    return pa.record_batch([pa.array(rows[0], pa.int64()), *(pa.array(x, pa.binary()) for x in rows[1:])], names=["chunk", "at", "sizes", "values"])


def reassembled(
    streams_: DataFrame, packed_: DataFrame, dtype: str, finish: Callable[[list, np.ndarray, np.ndarray, np.ndarray, np.ndarray], pa.Table], schema: str
) -> DataFrame:
    """Each chunk's streams with its words' values.

    ``finish(doc_ids, lengths, numbers, starts, values)`` gets the documents' word numbers and, by number, where each
    word's values start in ``values`` (a last start ends them).
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        try:
            return whole(left, right)
        finally:
            release_memory()

    def whole(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            raise RuntimeError("values of a chunk that the streams don't have: the documents must be read alike each time")
        (row,) = left.to_pylist()
        at = np.frombuffer(b"".join(right.column("at").to_pylist()), "<i4")
        n = np.frombuffer(b"".join(right.column("sizes").to_pylist()), "<u4").astype(np.int64)
        values = np.frombuffer(b"".join(right.column("values").to_pylist()), dtype)
        if len(at) != row["n_words"] or len(n) != len(at) or int(n.sum()) != len(values) or len(at) and (np.bincount(at, minlength=len(at)) != 1).any():
            raise RuntimeError("a chunk's dictionary did not come back whole: the documents must be read alike each time")
        order = np.argsort(at)
        before = np.cumsum(n) - n
        sizes = n[order]
        ends = np.cumsum(sizes)
        take = np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - sizes, sizes) + np.repeat(before[order], sizes)
        return finish(row["doc_ids"], np.array(row["lengths"], np.int64), _decoded(row["small"], row["large"]), np.concatenate([[0], ends]), values[take])

    return streams_.groupBy("chunk").cogroup(packed_.groupBy("chunk")).applyInArrow(run, schema)


def by_word(vocabulary_: DataFrame) -> DataFrame:
    """``vocabulary`` rows dealt by word, each word's rows together.

    A word has one row per chunk at most, however often it occurs, and a chunk has rows for all its distinct words, so the
    most common word has one in as many rows as a chunk has distinct words: no key is hot.
    """
    n = int(vocabulary_.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return vocabulary_.select("word", "chunk", "at").repartition(n, F.col("word")).sortWithinPartitions("word")
