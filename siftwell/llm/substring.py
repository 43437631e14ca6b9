"""Substring dedup by recompression: words of windows that occur earlier go.

Each document's words get names, and rounds of recompression rename them: first maximal runs of one
symbol, then pairs whose halves fall on different sides of a hash. A name is a hash of what it covers, so equal
passages get equal symbols wherever they stand, except near their edges. With each symbol goes its context:
the words that decided it. Every window of 20 words takes one symbol of the highest round whose context lies inside the
window (the least hash among several), so equal windows take the same symbol at the same place.

The Spark rounds: (1) texts are dealt by doc_id once; all later steps read that exchange. (2) Symbols taken by windows
are dealt by the hash of their context's words; those that occur once end here, which is nearly all of clean text.
(3) The rest return to their documents and are dealt again with the 64-bit hashes of their windows, 128 bits with
the context's, sorted by place: a window seen before in its group is a repeat. In both, what repeats within a task's batch of texts
is settled there and only its first goes to the group, so that a hot passage costs a row per batch. (4) Repeats return to their documents as spans.
Whole copies are known by their text's hash beforehand and skip (2) and (3).

A task holds one Arrow batch of texts, or the hashes of one group's distinct windows.

Defined results: null or empty texts have no words; rows with null doc_id lose nothing and repeat nothing;
rows with the same doc_id count as one document, with the spans of each cut from all; an empty table gives an
empty table; extra columns are not read (``cleaned`` keeps them).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import in_tasks, long_ids, slices, text_bytes, with_length

WINDOW = 20
ROUNDS = 3
_BASE = 0x27D4EB2F165667C5
_U = np.uint64


class WordNames(dict):
    """64-bit name of a word, remembered; never 0, which separates documents."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        name = self[word] = xxh64_intdigest(word, 7) or 1
        return name


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * _U(0x9E3779B97F4A7C15)
    x ^= x >> _U(32)
    x *= _U(0xD6E8FEB86659FD93)
    x ^= x >> _U(29)
    return x


def joined(texts: list[bytes | None], names: WordNames) -> tuple[np.ndarray, np.ndarray]:
    """The names of all texts' words, a 0 before and after each text; and where each text starts."""
    flat = [0]
    starts = []
    for t in texts:
        starts.append(len(flat))
        if t:
            flat.extend(map(names.__getitem__, t.split()))
        flat.append(0)
    return np.array(flat, np.uint64), np.array(starts, np.int64)


class Hashes:
    """Hashes of any stretch of words, independent of where it stands."""

    def __init__(self, names: np.ndarray):
        n = len(names) + 1
        power, inverse = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(mixed(names) * power[:-1])])

    def __call__(self, start: np.ndarray, stop: np.ndarray, salt: int = 0) -> np.ndarray:
        return mixed((self.sums[stop] - self.sums[start]) * self.inverse[start] + _U(salt))


class Symbols:
    """One round's symbols: names, and the [low, high) words of their contexts. 0 names stay apart."""

    def __init__(self, names: np.ndarray):
        self.names = names
        self.low = np.arange(len(names), dtype=np.int32)
        self.high = self.low + np.int32(1)

    def _reach(self, left: np.ndarray, right: np.ndarray) -> None:
        """Contexts take in those of the symbol before (where left) and after (where right)."""
        low, high = self.low, self.high
        self.low = low.copy()
        self.low[1:] = np.where(left[1:], np.minimum(low[1:], low[:-1]), low[1:])
        self.high = high.copy()
        self.high[:-1] = np.where(right[:-1], np.maximum(high[:-1], high[1:]), high[:-1])

    def runs(self) -> Symbols:
        """Maximal runs of a word become one symbol, named by word and length; a word to each side tells that it ends there."""
        names = self.names
        out = Symbols.__new__(Symbols)
        first = np.concatenate([[True], (names[1:] != names[:-1]) | (names[1:] == 0)]) if len(names) else np.zeros(0, bool)
        at = np.flatnonzero(first)
        ends = np.append(at[1:], len(names))
        length = ends - at
        long = length > 1
        out.names = names[at]
        out.names[long] = mixed(out.names[long] + mixed(length[long].astype(np.uint64)))
        out.low, out.high = np.maximum(at - 1, 0).astype(np.int32), np.minimum(ends + 1, len(names)).astype(np.int32)
        return out

    def pairs(self, round_: int) -> Symbols:
        """A symbol on the left side and one on the right side after it become one symbol."""
        names = self.names
        side = (mixed(names ^ _U(2 * round_ + 1)) >> _U(40)) & _U(1)
        left, right = (side == 0) & (names != 0), (side == 1) & (names != 0)
        head, tail = np.zeros(len(names), bool), np.zeros(len(names), bool)
        head[:-1] = left[:-1] & right[1:]
        tail[1:] = head[:-1]
        out = Symbols.__new__(Symbols)
        out.names, out.low, out.high = names.copy(), self.low, self.high
        at = np.flatnonzero(head)
        out.names[at] = mixed(names[at] * _U(3) + mixed(names[at + 1] + _U(round_)))
        out._reach(right & ~tail, left)  # an unpaired symbol depends on the neighbour it might have paired with; a head takes its tail in
        keep = ~tail
        out.names, out.low, out.high = out.names[keep], out.low[keep], out.high[keep]
        return out


def _least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Index of the least of values[first..last] for each range; of equal ones the first."""
    span = last - first + 1
    best = first.copy()
    index, width = np.arange(len(values)), 1
    while True:
        two = span >= 2 * width
        here = (span >= width) & ~two
        a, b = index[first[here]], index[last[here] - width + 1]
        best[here] = np.where(values[b] < values[a], b, a)
        if not two.any():
            return best
        a, b = index[:-width], index[width:]
        index = np.where(values[b] < values[a], b, a) if len(index) > width else index
        width *= 2


def anchors(names: np.ndarray, starts: np.ndarray, window: int = WINDOW, rounds: int = ROUNDS) -> tuple[np.ndarray, ...]:
    """(key, first window, last window) of each stretch of windows that take the same symbol.

    Windows are positions in ``names``; a stretch lies in one document. Key: hash of the words of the symbol's context.
    """
    n = len(names)
    sizes = np.diff(np.append(starts, n))
    todo = np.arange(1, n)
    todo = todo[todo + window <= np.repeat(starts + sizes - 1, sizes)]  # up to each document's 0
    levels = [Symbols(names)]
    levels.append(levels[0].runs())
    for k in range(rounds):
        levels.append(levels[-1].pairs(k))
    hashes = Hashes(names)
    place = np.zeros(n, np.int64)
    key = np.zeros(n, np.uint64)
    taken = todo
    for level in range(len(levels) - 1, -1, -1):
        if not len(todo):
            break
        s = levels[level]
        # symbols from the first that begins its context inside the window to the last that ends there
        first = np.cumsum(np.bincount(s.low, minlength=n + 1))
        first = np.concatenate([[0], first])[todo]
        last = np.cumsum(np.bincount(s.high, minlength=n + 1))[todo + window] - 1
        there = last >= first
        at = _least(mixed(s.names + _U(level)), first[there], last[there])
        place[todo[there]] = at * len(levels) + level
        key[todo[there]] = hashes(s.low[at].astype(np.int64), s.high[at].astype(np.int64), level)
        todo = todo[~there]
    if not len(taken):
        return key[:0], taken, taken
    new = np.concatenate([[True], (place[taken[1:]] != place[taken[:-1]]) | (taken[1:] != taken[:-1] + 1)])
    head = taken[new]
    return key[head], head, taken[np.append(np.flatnonzero(new)[1:], len(taken)) - 1]


_ANCHORS = "key long, doc_id long, low int, high int, known boolean, later boolean"


def _anchor_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    names = WordNames()
    for batch in slices(batches):
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        words, starts = joined(text_bytes(batch), names)
        key, low, high = anchors(words, starts, window)
        doc = np.searchsorted(starts, low, "right") - 1
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        known, later = np.zeros(len(key), bool), np.zeros(len(key), bool)
        known[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(key) else False
        later[order] = np.concatenate([[False], same]) if len(key) else False
        yield pa.record_batch(
            [
                pa.array(key.view(np.int64)),
                pa.array(ids[doc].astype(np.int64)),
                pa.array((low - starts[doc]).astype(np.int32)),
                pa.array((high - starts[doc]).astype(np.int32)),
                pa.array(known),
                pa.array(later),
            ],
            names=["key", "doc_id", "low", "high", "known", "later"],
        )


def _several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key whose key occurs more than once here, or is known to from the batch it came from."""
    rest, known = None, None  # the last row so far, and whether its key has been seen twice
    for batch in batches:
        if not batch.num_rows:
            continue
        if rest is not None:
            batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
        keys = batch.column(0).to_numpy()
        same = keys[1:] == keys[:-1]
        several = np.concatenate([same, [False]]) | np.concatenate([[bool(known)], same])
        known = bool(several[-1])
        rest = batch.slice(batch.num_rows - 1)
        yield _chosen(batch.slice(0, batch.num_rows - 1), several[:-1])
    if rest is not None:
        yield _chosen(rest, np.array([known]))


def _chosen(rows: pa.RecordBatch, several: np.ndarray) -> pa.RecordBatch:
    local = rows.column(4).to_numpy(zero_copy_only=False)
    return rows.select(["key", "doc_id", "low", "high"]).filter(pa.array(several | local))


_HASHED = "key long, doc_id long, low int, hashes array<long>, high int"


def _stretches(doc: np.ndarray, key: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of each stretch of neighbouring windows of one document and key."""
    if not len(at):
        return at, at
    cut = np.flatnonzero((doc[1:] != doc[:-1]) | (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1)) + 1
    return np.concatenate([[0], cut]), np.append(cut, len(at)) - 1


def _hash_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, found: list of (key, low, high)) to windows' hashes, and to repeats that the batch itself shows.

    Of windows that are equal within the batch only the first goes on with its hash; the others are repeats, as [low, high) words
    without hashes.
    """
    names = WordNames()
    for batch in slices(batches):
        words, starts = joined(text_bytes(batch), names)
        hashes = Hashes(words)
        found = batch.column(2)
        row = np.repeat(np.arange(batch.num_rows), found.value_lengths().fill_null(0).to_numpy())
        flat = found.flatten()
        key, low, high = (flat.field(k).to_numpy(zero_copy_only=False) for k in range(3))
        inside = starts[row] + high + window < np.append(starts[1:], len(words))[row]  # rows of one doc_id may differ in length
        row, key, low, high = row[inside], key[inside], low[inside].astype(np.int64), high[inside].astype(np.int64)
        size = high - low + 1
        at = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        row, key = np.repeat(row, size), np.repeat(key, size)
        hashed = hashes(starts[row] + at, starts[row] + at + window)
        doc = batch.column(0).to_numpy(zero_copy_only=False)[row].astype(np.int64)
        order = np.lexsort((at, doc, hashed, key))
        doc, key, at, hashed = doc[order], key[order], at[order], hashed[order]
        new = np.ones(len(at), bool)
        new[1:] = (key[1:] != key[:-1]) | (hashed[1:] != hashed[:-1])
        first = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
        repeat = (doc != doc[first]) | (at != at[first])
        columns: list[list] = [[], [], [], [], []]
        for kind in (False, True):
            mine = np.flatnonzero((new if not kind else repeat))
            mine = mine[np.lexsort((at[mine], key[mine], doc[mine]))]
            a, b = _stretches(doc[mine], key[mine], at[mine])
            lists = pa.ListArray.from_arrays(pa.array(np.append(a, len(mine)), pa.int32()), pa.array(hashed[mine].view(np.int64)))
            for column, x in zip(columns, (key[mine[a]], doc[mine[a]], at[mine[a]].astype(np.int32), lists if not kind else pa.nulls(len(a), lists.type), (at[mine[b]] + window).astype(np.int32)), strict=True):
                column.append(x if isinstance(x, pa.Array) else pa.array(x))
        yield pa.record_batch([pa.concat_arrays(c) for c in columns], names=["key", "doc_id", "low", "hashes", "high"])


def _repeat_rows(batches: Iterator[pa.RecordBatch], window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, doc_id, low) to the word spans of windows seen before under their key; repeats pass on."""
    current, seen = None, {}
    for batch in batches:
        out: list[tuple[int, int, int]] = []
        for key, doc, low, hashes, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if hashes is None:
                out.append((doc, low, high))
                continue
            if key != current:
                current, seen = key, {}
            start = None
            for at, h in enumerate(hashes, low):
                if seen.setdefault(h, (doc, at)) != (doc, at):
                    start = at if start is None else start
                elif start is not None:
                    out.append((doc, start, at - 1 + window))
                    start = None
            if start is not None:
                out.append((doc, start, low + len(hashes) - 1 + window))
        yield pa.record_batch([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "low", "high"])


def copies(docs: DataFrame) -> DataFrame:
    """``doc_id`` of rows whose whole text a smaller doc_id has."""
    texts = docs.where("text is not null and doc_id is not null").select("doc_id", F.md5("text").alias("h"))
    first = texts.groupBy("h").agg(F.min("doc_id").alias("first"))
    return texts.join(first, "h").where("doc_id > first").select("doc_id").distinct()


def with_spans(docs: DataFrame, window: int = WINDOW, apart: DataFrame | None = None) -> DataFrame:
    """``docs`` with ``_copy`` (a smaller doc_id has the whole text) and ``_spans`` (repeats, as [low, high) words).

    Rows that ``apart`` (doc_id, and ``h``, the md5 of the text) names are left out; their windows count all the same.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = long_ids(docs)
    whole = ids.where("doc_id is not null").repartition(n, "doc_id")
    dealt = whole.select("doc_id", "text")
    copied = copies(ids).withColumn("_copy", F.lit(True))
    own = dealt.join(copied.hint("shuffle_hash"), "doc_id", "left").where("_copy is null").select("doc_id", "text")
    taken = own.transform(in_tasks, lambda b: _anchor_rows(b, window), _ANCHORS)
    # what a batch has shown to be shared goes anywhere, one row of each key excepted, so that a hot key is spread
    deal = F.when(F.col("later"), F.xxhash64("key", "doc_id", "low")).otherwise(F.col("key"))
    shared = taken.repartition(n, deal).sortWithinPartitions("key").transform(in_tasks, _several, "key long, doc_id long, low int, high int")
    found = shared.groupBy("doc_id").agg(F.collect_list(F.struct("key", "low", "high")).alias("found"))
    hashed = dealt.join(found.hint("shuffle_hash"), "doc_id").transform(in_tasks, lambda b: _hash_rows(b, window), _HASHED)
    deal = F.when(F.col("hashes").isNull(), F.xxhash64("key", "doc_id", "low")).otherwise(F.col("key"))
    repeats = hashed.repartition(n, deal).sortWithinPartitions("key", "doc_id", "low").transform(in_tasks, lambda b: _repeat_rows(b, window), "doc_id long, low int, high int")
    spans = repeats.groupBy("doc_id").agg(F.collect_list(F.struct("low", "high")).alias("_spans"))
    out = whole.join(copied.hint("shuffle_hash"), "doc_id", "left").join(spans.hint("shuffle_hash"), "doc_id", "left")
    nameless = ids.where("doc_id is null")
    if apart is not None:  # by id, as the texts are dealt already
        of = apart.where("doc_id is not null").groupBy("doc_id").agg(F.collect_set("h").alias("_apart"))
        out = out.join(of.hint("shuffle_hash"), "doc_id", "left").where(F.col("_apart").isNull() | ~F.array_contains("_apart", F.md5("text"))).drop("_apart")
        nameless = nameless.join(apart.where("doc_id is null").select("h"), F.md5("text") == F.col("h"), "left_anti")
    return out.unionByName(nameless, allowMissingColumns=True)


def kept_words(text: bytes | None, copy: bool | None, spans: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and those that stay."""
    words = (text or b"").split()
    if copy and len(words) >= window:
        return len(words), []
    if not spans:
        return len(words), words
    edges = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        edges[min(s["low"], len(words))] += 1
        edges[min(s["high"], len(words))] -= 1
    return len(words), [w for w, c in zip(words, np.cumsum(edges).tolist(), strict=False) if not c]


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The contract's columns: ``doc_id, n_words, n_removed, kept_sha256``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(t, c, s, window) for t, c, s in zip(text_bytes(batch), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.record_batch(
                [
                    batch.column(0),
                    pa.array([n for n, _ in rows], pa.int64()),
                    pa.array([n - len(k) for n, k in rows], pa.int64()),
                    pa.array([hashlib.sha256(b" ".join(k)).hexdigest() for _, k in rows], pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    rows = with_spans(docs.select("doc_id", "text"), window).select("doc_id", "text", "_copy", "_spans")
    return rows.transform(in_tasks, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(docs: DataFrame, window: int = WINDOW, min_words: int = 1, apart: DataFrame | None = None) -> DataFrame:
    """``docs`` without repeated words, other columns as they are; documents left with fewer than ``min_words`` go.

    Rows that ``apart`` (doc_id, and ``h``, the md5 of the uncut text) names go as well; their windows count all the same.
    Texts that lose nothing stay as they are; of others the kept words are joined by spaces. ``n_chars`` follows.
    """
    names = docs.columns
    at, n = names.index("text"), len(names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            for t, c, s in zip(text_bytes(batch), batch.column(n).to_pylist(), batch.column(n + 1).to_pylist(), strict=True):
                count, words = kept_words(t, c, s, window)
                texts.append(t if len(words) == count else b" ".join(words))
                keep.append(len(words) >= min_words or len(words) == count)
            columns = batch.columns[:n]
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.record_batch(columns, names=names).filter(pa.array(keep, pa.bool_()))

    inner = docs.toDF(*(c if c in ("doc_id", "text") else f"c{k}" for k, c in enumerate(names)))  # names that clash with none used here
    return with_length(with_spans(inner, window, apart).select(*inner.columns, "_copy", "_spans").transform(in_tasks, run, docs.schema))
