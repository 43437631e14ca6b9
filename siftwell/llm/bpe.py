"""Byte-level BPE by a global shuffle of distinct pre-tokens.

Pre-tokens are taken with their positions, chunk by chunk; each distinct pre-token of the corpus is encoded once by the
vocabulary's ranks; the ids return to the chunks and are put in place by position (see ``dictionary``). Decoding joins the
token-byte table, which the vocabulary bounds (about 50,000 rows) and which is therefore broadcast.

Defined results: a null or empty text has no ids and decodes to nothing; repeated rows each get their ids;
bytes beyond the vocabulary's pieces cannot occur, as every single byte has a rank; an empty table gives an empty
table; extra columns are not read; null ids stay null; a run without blanks, however long, is one unit and is encoded whole,
with sizes of four bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from . import dictionary
from .common import in_tasks


def ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


#: White space where not every blank starts a match of its own.
_UNEVEN = re.compile(r" \s| $")
#: Blanks that do.
_START = re.compile(r" (?=\S)")
_MARKS = {c: c.encode() for c in ".,;:!?"}


def pre_tokens(pattern: str) -> dictionary.Split:
    """Cuts texts to units and units to pre-tokens.

    A blank before a visible character always starts a new match of the pattern, so what stands between two such blanks
    is a unit, a string without its blank. A text's first unit comes as a tuple, as no blank belongs to it.
    """
    import regex

    findall = regex.compile(pattern).findall

    def units(data: bytes) -> list:
        text = data.decode()
        first, *rest = _START.split(text) if _UNEVEN.search(text) else text.split(" ")
        return [(first,), *rest]

    def tokens(unit: str | tuple[str]) -> list[bytes]:
        if unit.__class__ is tuple:
            return [x.encode() for x in findall(unit[0])]
        if unit.isalpha():  # a letter run and a mark after it are matches of their own
            return [b" " + unit.encode()]
        if (mark := unit[-1]) in _MARKS and (stem := unit[:-1]).isalpha():
            return [b" " + stem.encode(), _MARKS[mark]]
        return [x.encode() for x in findall(" " + unit)]

    return units, tokens


def _encoded(docs: DataFrame, vocabulary: dict[bytes, int], pattern: str, chunk_bytes: int, finish: Callable[[list, np.ndarray, np.ndarray], pa.Table], schema: str) -> DataFrame:
    """What ``finish(doc_ids, ids, ends)`` makes of each chunk: the ids of all its rows in order, and where each row's begin and end."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})._encode_single_piece
        for batch in batches:
            words = batch.column(0)
            new = np.ones(len(words), bool)
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            found = [encoder(w) for w in words.filter(pa.array(new)).to_pylist()]
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            flat = np.fromiter((k for ids in found for k in ids), np.int32, int(sizes.sum()))
            which = np.cumsum(new) - 1
            n = sizes[which]
            take = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat((np.cumsum(sizes) - sizes)[which], n)
            yield dictionary.packed(batch.column(1).to_numpy(), batch.column(2).to_numpy(), n, flat[take])

    def place(doc_ids: list, lengths: np.ndarray, numbers: np.ndarray, starts: np.ndarray, values: np.ndarray) -> pa.Table:
        sizes = np.diff(starts)
        parts, ends = [], [np.zeros(1, np.int64)]
        for k in range(0, len(numbers), 1 << 18):  # in stretches, as the index arrays are larger than the ids
            part = numbers[k : k + (1 << 18)]
            n = sizes[part]
            stop = np.cumsum(n)
            parts.append(values[np.arange(stop[-1]) - np.repeat(stop - n, n) + np.repeat(starts[part], n)])
            ends.append(stop + ends[-1][-1])
        ids = np.concatenate(parts) if parts else values[:0]
        return finish(doc_ids, ids, np.concatenate(ends)[np.concatenate([[0], np.cumsum(lengths)])])

    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")

    def split() -> dictionary.Split:
        return pre_tokens(pattern)

    found = dictionary.by_word(dictionary.vocabulary(docs, split, chunk_bytes)).transform(in_tasks, encode, dictionary.PACKED)
    return dictionary.reassembled(dictionary.streams(docs, split, chunk_bytes), found, "<i4", place, schema)


def encoded(docs: DataFrame, vocabulary: dict[bytes, int], pattern: str, chunk_bytes: int = dictionary.CHUNK_BYTES) -> DataFrame:
    """``doc_id, ids`` per row of ``docs``."""

    def lists(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.Table:
        return pa.table([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return _encoded(docs, vocabulary, pattern, chunk_bytes, lists, "doc_id long, ids array<int>")


def token_bytes(vocabulary: dict[bytes, int]) -> list[bytes]:
    """The token-byte table: bytes by id; ids without a token have none."""
    table = [b""] * (max(vocabulary.values(), default=-1) + 1)
    for piece, rank in vocabulary.items():
        table[rank] = piece
    return table


def digest(docs: DataFrame, vocabulary: dict[bytes, int], pattern: str, chunk_bytes: int = dictionary.CHUNK_BYTES) -> DataFrame:
    """The contract's columns: ``doc_id, n_tokens, ids_sha256, decoded_sha256``, made where a chunk's ids are put in place."""
    shared = docs.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))

    def digests(doc_ids: list, ids: np.ndarray, ends: np.ndarray) -> pa.Table:
        table = shared.value
        decimal = [b"%d" % k for k in range(len(table))]
        ids_sha, text_sha = [], []
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            own = ids[a:b].tolist()
            ids_sha.append(hashlib.sha256(b",".join(map(decimal.__getitem__, own))).hexdigest())
            text_sha.append(hashlib.sha256(b"".join(map(table.__getitem__, own))).hexdigest())
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(np.diff(ends), pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _encoded(docs, vocabulary, pattern, chunk_bytes, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def decoded(rows: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """``doc_id, data`` (the bytes) from ``doc_id, ids``."""
    shared = rows.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            data = [None if ids is None else b"".join(map(table.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return rows.selectExpr("cast(doc_id as long) doc_id", "ids").transform(in_tasks, run, "doc_id long, data binary")
