"""The near-copy stage: SimHash links widened to a similarity of 0.8, all verified on sets of five-word shingles.

Links at 4 of 64 SimHash bits find very near copies only: at a Jaccard similarity of 0.8 fingerprints differ in about ten bits. So the
stage links in three steps, each of which offers pairs of texts that the steps before left in different components. Every
pair is verified: the Jaccard similarity of the whole sets must be 0.8 or more.

1. SimHash over five-word shingles, met by deletion variants (``simhash.links``).
2. Texts with one of ``BANDS`` keys of ``ROWS`` minhashes in common: each with the first text of the meeting, which settles
   large groups of near copies with few pairs a text.
3. What still meets under a key in different components: all such pairs that share one of their rarest fifth of shingles (others can't be
   similar enough), compared on their sets where they meet. Only edges that join two components leave. A meeting with more than ``BLOCK`` shingles is cut into blocks, and each two blocks meet in a
   place of their own, so that no place holds more.

Equal texts (but for case and white space) take part once.

Defined results: texts without words are copies of one another; fewer words than a shingle form one shingle;
rows with null ids link nothing and stay; an empty table gives an empty table; extra columns are kept. A text of any length
counts whole: its set takes four bytes for each distinct shingle, in one row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from . import simhash
from .common import in_tasks, text_bytes, written

SHINGLE = 5
#: Least similarity, in fifths.
FIFTHS = 4
#: A pair at similarity 0.8 shares no key once in some 2,800 times, at 0.85 once in some 37,000.
BANDS, ROWS = 20, 5
#: Shingles in a block.
BLOCK = 4_000_000

_RNG = np.random.default_rng(5)
_FACTORS = _RNG.integers(1, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), dtype=np.uint64)
#: Shingles hashed by all functions at once.
_STRETCH = 2000


def minhashes(hashes: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(hashes), _STRETCH):
        mixed = hashes[k : k + _STRETCH] * _FACTORS + _TERMS
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=1))
    return least


def shingle_set(text: bytes | None) -> np.ndarray:
    """Distinct shingles by 32 bits of their hashes: two unlike shingles pass for one in four billion pairs of them."""
    return np.unique((np.array(simhash.shingle_hashes((text or b"").lower().split(), SHINGLE), np.uint64) >> np.uint64(32)).astype(np.uint32))


def sketch(text: bytes | None) -> tuple[int, int, list[int]]:
    """A hash of the lower-cased words; the SimHash; the bands' keys."""
    words = (text or b"").lower().split()
    whole = xxh64_intdigest(b" ".join(words), 7)
    hashes = simhash.shingle_hashes(words, SHINGLE)
    if not hashes:
        return whole, 0, []
    least = minhashes(np.unique(np.array(hashes, np.uint64)))
    data, width = least.tobytes(), 8 * ROWS
    keys = np.array([xxh64_intdigest(data[width * k : width * (k + 1)], k) for k in range(BANDS)], np.uint64).view(np.int64)
    return whole, simhash.majority(hashes), keys.tolist()


def sketches(texts: DataFrame) -> DataFrame:
    """``id, whole, fp, keys`` of each row of ``texts`` (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, prints, keys = zip(*map(sketch, text_bytes(batch)), strict=True) if batch.num_rows else ((), (), ())
            signed = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (whole, prints)]
            yield pa.record_batch([batch.column(0), *signed, pa.array(keys, pa.list_(pa.int64()))], names=["id", "whole", "fp", "keys"])

    return texts.transform(in_tasks, run, "id long, whole long, fp long, keys array<long>")


def sets(ids: DataFrame, texts: DataFrame) -> DataFrame:
    """``id, n, hashes``: the shingles of those ``texts`` (id, text) that ``ids`` (id) has, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingle_set(t) for t in text_bytes(batch)]
            yield pa.record_batch([batch.column(0), pa.array([len(x) for x in found], pa.int64()), pa.array([x.tobytes() for x in found], pa.binary())], names=["id", "n", "hashes"])

    # dealt by id at every size, as texts are: the plan is the same for few ids and for many
    return written(texts.join(ids.distinct().hint("shuffle_hash"), "id", "left_semi").transform(in_tasks, run, "id long, n long, hashes binary"), "shingles")


def verified(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) of ids whose sets (``of``: id, hashes) are similar enough."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                p, q = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                both = 0
                if 5 * min(len(p), len(q)) >= FIFTHS * max(len(p), len(q)):
                    both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(both > 0 and 5 * both >= FIFTHS * (len(p) + len(q) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(of.selectExpr("id a", "hashes x"), "a").join(of.selectExpr("id b", "hashes y"), "b")
    return written(joined.select("a", "b", "x", "y").transform(in_tasks, near, "a long, b long").distinct(), "near-links")


def _prints_met(one: DataFrame) -> DataFrame:
    """Each text with the first of its fingerprint, and each fingerprint's first with that of the least one it is linked to."""
    least = written(one.groupBy("fp").agg(F.min("id").alias("id")), "prints")
    same = one.join(least.withColumnRenamed("id", "a"), "fp").select("a", F.col("id").alias("b"))
    edges = simhash.links(least.select("fp")).groupBy("b").agg(F.min("a").alias("a"))
    linked = edges.join(least.selectExpr("fp a", "id x"), "a").join(least.selectExpr("fp b", "id y"), "b").selectExpr("x a", "y b")
    return same.unionByName(linked).where("a <> b").selectExpr("least(a, b) a", "greatest(a, b) b").distinct()


def _firsts_met(met: DataFrame) -> DataFrame:
    """Each text of a meeting (key, id, label) with the meeting's first, where their components differ."""
    first = met.groupBy("key").agg(F.min(F.struct("id", "label")).alias("first"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high")
    return met.join(first, "key").where("label <> first.label").selectExpr("least(first.id, id) a", "greatest(first.id, id) b").distinct()


def _met_in_prefixes(flat: np.ndarray, sizes: np.ndarray, starts: np.ndarray) -> Callable[[int], np.ndarray]:
    """Function from a text to the texts that share one of its rarest shingles: all that can be similar enough are among them.

    Of two sets at four fifths or more, the parts of ``size - ceil(FIFTHS / 5 * size) + 1`` rarest shingles, by one order for all, have one in common.
    """
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rarity = np.empty(int(flat.max(initial=0)) + 1, np.int64)
    rarity[np.argsort(np.bincount(flat, minlength=len(rarity)), kind="stable")] = np.arange(len(rarity))
    rank = rarity[flat]
    order = np.lexsort((rank, owner))
    least = sizes - -(-FIFTHS * sizes // 5) + 1
    first = (np.arange(len(order)) - starts[owner]) < least[owner]
    rank, owner = rank[order][first], owner[first]
    order = np.argsort(rank, kind="stable")
    names, at, count = np.unique(rank[order], return_index=True, return_counts=True)
    texts = owner[order]
    own = np.searchsorted(owner, np.arange(len(sizes) + 1))  # each text's part of ``rank``
    place = np.searchsorted(names, rank)

    def met(k: int) -> np.ndarray:
        lists = place[own[k] : own[k + 1]]
        return np.unique(np.concatenate([texts[at[x] : at[x] + count[x]] for x in lists[count[lists] > 1].tolist()] or [np.zeros(0, np.int64)]))

    return met


def _joined(ids: np.ndarray, labels: np.ndarray, blocks: np.ndarray, hashes: list[bytes]) -> Iterator[tuple[int, int]]:
    """Edges between texts of a place that are similar enough, one for each two components that they join.

    Texts of one block are compared with each other if it is alone, else those of two blocks with the other's. Of these only the ones that
    share a rare shingle are looked at: texts under a common boilerplate meet by what is their own.
    """
    flat = np.unique(np.frombuffer(b"".join(hashes), np.uint32), return_inverse=True)[1].astype(np.int32)
    sizes = np.fromiter(map(len, hashes), np.int64, len(hashes)) // 4
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mark = np.zeros(int(flat.max(initial=0)) + 1, np.int32)
    met = _met_in_prefixes(flat, sizes, starts)
    alone = (blocks == blocks[0]).all()
    names, counts = np.unique(labels, return_counts=True)
    most = names[counts.argmax()]  # the largest component's texts need no turn of their own: all others meet them
    for k in range(len(ids)):
        if labels[k] == most or not sizes[k]:
            continue
        rows = met(k)
        other = (labels[rows] != labels[k]) & (5 * np.minimum(sizes[rows], sizes[k]) >= FIFTHS * np.maximum(sizes[rows], sizes[k]))
        other &= (labels[rows] == most) | (rows > k) if alone else blocks[rows] != blocks[k]
        rows = rows[other]
        if not len(rows):
            continue
        mark[flat[starts[k] : ends[k]]] = 1
        both = np.array([mark[flat[starts[r] : ends[r]]].sum() for r in rows.tolist()])
        mark[flat[starts[k] : ends[k]]] = 0
        near = rows[5 * both >= FIFTHS * (sizes[rows] + sizes[k] - both)]
        for r in near.tolist():
            if labels[r] != labels[k]:
                yield int(ids[k]), int(ids[r])
                low, stay = (labels[r], labels[k]) if labels[r] != most else (labels[k], most)
                labels[labels == low] = stay


def _all_met(met: DataFrame, of: DataFrame, block: int = BLOCK) -> DataFrame:
    """Edges between texts of a meeting (key, id, label) whose sets (``of``: id, n, hashes) are similar enough and whose components differ."""

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        current = None

        def edges() -> pa.RecordBatch:
            found = list(_joined(*(np.array([h[k] for h in held], np.int64) for k in (0, 1, 2)), [h[3] for h in held])) if len(held) > 1 else []
            return pa.record_batch([pa.array([min(e) for e in found], pa.int64()), pa.array([max(e) for e in found], pa.int64())], names=["a", "b"])

        for batch in batches:
            for *place, id_, label, own, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if place != current:
                    yield edges()
                    current = place
                    held.clear()
                held.append((id_, label, own, hashes))
        yield edges()

    mixed = met.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("key")
    left = written(met.join(mixed, "key", "left_semi").select("key", "id", "label"), "near-meetings")
    blocks = left.join(of.select("id", "n"), "id").groupBy("key").agg(F.ceil((F.sum("n") + 1) / block).cast("int").alias("blocks"))
    cut = left.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    placed = cut.select("*", other).select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "id", "label", "block")
    n = int(met.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = ["key", "low", "high"]
    dealt = placed.join(of.select("id", "hashes"), "id").repartition(n, *place).sortWithinPartitions(*place, "id")
    return written(dealt.select(*place, "id", "label", "block", "hashes").transform(in_tasks, join, "a long, b long").distinct(), "near-links")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are the least doc_id of their component, with all their columns.

    Null ids stay. Of repeated rows with one id, all stay; a repeated id with several texts is one node.
    """
    texts = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) id", "text")
    rows = written(sketches(texts), "sketches")
    nodes = rows.groupBy("whole").agg(F.min("id").alias("id"))
    one = rows.join(nodes, ["whole", "id"], "left_semi")
    labels = written(nodes.select("id", F.col("id").alias("label")).distinct(), "near-labels")

    keyed = one.select(F.explode("keys").alias("key"), "id")
    several = keyed.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low <> high").select("key")
    shared = written(keyed.join(several, "key", "left_semi"), "near-keys")  # most keys are one text's own

    def met() -> DataFrame:
        """Texts under the keys that they share, with the components so far."""
        return shared.join(labels, "id")

    linked = written(_prints_met(one), "near-pairs")
    # one read of the texts gives the sets of all that meet anywhere
    of = sets(shared.select("id").unionByName(linked.select(F.explode(F.array("a", "b")).alias("id"))), texts)
    for step in (lambda: verified(linked, of), lambda: verified(written(_firsts_met(met()), "near-pairs"), of), lambda: _all_met(met(), of)):
        found = step()
        ends = found.join(labels.selectExpr("id a", "label x"), "a").join(labels.selectExpr("id b", "label y"), "b")
        edges = ends.where("x <> y").selectExpr("x a", "y b").distinct()
        moved = simhash.components(labels.select(F.col("label").alias("fp"), F.col("label").alias("id")).distinct(), edges)
        joined = labels.join(moved.selectExpr("fp label", "component"), "label", "left")
        labels = written(joined.select("id", F.coalesce("component", "label").alias("label")), "near-labels")
    stay = labels.where("id = label").selectExpr("id doc_id")
    return docs.join(stay.hint("shuffle_hash"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
