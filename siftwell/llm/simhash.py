"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint takes the majority of the shingles' XXH64 bits. To find fingerprints at ``BITS`` = 4 or fewer
differing bits, the 64 bits are cut into 3 segments: four differences over three segments leave one segment
with at most one. Each segment is indexed under its one-wildcard variants (the segment without bit k, for each k), so
such segments share a variant. Distinct fingerprints meet by equality of (segment, k, rest of the segment) and
every meeting is verified on all 64 bits. As a variant has 20 bits or so, fingerprints in very great number (``MANY``) are cut
into 6 segments, of which some three together hold one difference at most, and meet by variants of 31 bits; the links are the same.

Within a meeting no list of all pairs is made: verified neighbours are joined to trees by breadth-first search over
what has not been reached yet, and only the trees' edges leave. Trees of all meetings then join to components by
label propagation with pointer jumping, as Spark joins over written tables.

Exact copies share a fingerprint and are never compared: one row per distinct fingerprint is indexed, and the
groups of copies come back in one join at the end, whose large groups Spark can split.

Defined results: a null or empty text has no words and fingerprint zero, linked like any other; fewer words than
a shingle form one shingle; a text of any length is hashed whole; repeated rows get one row each; rows with null ids link nothing and get the
component of their fingerprint, if any; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import in_tasks, text_bytes, written

SHINGLE = 4
BITS = 4
#: (segments, segments taken together): with 4 differing bits one of 3 segments, or some 3 of 6 together, have one at most.
LAYOUTS = ((3, 1), (6, 3))
#: Fingerprints from which the longer keys of the second layout are taken; both find the same links.
MANY = 1 << 27


def shingle_hashes(words: list[bytes], shingle: int) -> list[int]:
    """XXH64 of each shingle of the words, repeats included; fewer words are one shingle."""
    if len(words) <= shingle:
        return [xxh64_intdigest(b" ".join(words), 42)] if words else []
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-shingle] + 1]).tolist()
    return [xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """The bits that over half of the hashes have."""
    if not hashes:
        return 0
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 1 << 16):
        bits = np.unpackbits(np.array(hashes[k : k + (1 << 16)], "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += np.add.reduce(bits, axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes((text or b"").lower().split(), shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t, shingle) for t in text_bytes(batch)], np.uint64).view(np.int64)
            yield pa.record_batch([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").transform(in_tasks, run, "doc_id long, fp long")


def variants(prints: DataFrame, layout: tuple[int, int] = LAYOUTS[0]) -> DataFrame:
    """Each fingerprint under its one-wildcard variants: ``key`` is which segments, which bit is left out, and the rest of them."""
    segments, together = layout
    cuts = [round(64 * k / segments) for k in range(segments + 1)]
    keys = []
    for which in combinations(range(segments), together):
        bits = [b for k in which for b in range(cuts[k], cuts[k + 1])]
        mask = sum(1 << b for b in bits)
        for b in bits:
            rest = F.col("fp").bitwiseAND(F.lit((mask & ~(1 << b)) - (1 << 64 if (mask & ~(1 << b)) >> 63 else 0)))
            # 22 bits fit beside the number of the variant; longer keys are hashed with it
            keys.append(F.shiftrightunsigned(rest, cuts[which[0]]) + F.lit(len(keys) << 24) if together == 1 else F.xxhash64(F.lit(len(keys)), rest))
    return prints.select(F.explode(F.array(*keys)).alias("key"), "fp")


def tree_edges(prints: np.ndarray, bits: int = BITS) -> list[tuple[int, int]]:
    """Edges of spanning trees of the graph that links distinct ``prints`` (uint64) at ``bits`` or fewer."""
    if len(prints) == 2:
        return [(prints[0], prints[1])] if int(prints[0] ^ prints[1]).bit_count() <= bits else []
    edges, rest = [], prints
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= bits
            if near.any():
                found = rest[near]
                edges += [(at, x) for x in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def links(prints: DataFrame, bits: int = BITS, layout: tuple[int, int] | None = None) -> DataFrame:
    """Distinct verified edges ``a, b`` that connect the distinct fingerprints of ``prints`` (fp)."""
    layout = layout or LAYOUTS[prints.count() >= MANY]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest_keys, rest_prints = np.empty(0, np.int64), np.empty(0, np.uint64)

        def edges_of(keys: np.ndarray, prints_: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            ends = np.append(starts[1:], len(keys))
            several = np.flatnonzero(ends - starts > 1)
            pairs = several[(ends - starts)[several] == 2]
            a, b = prints_[starts[pairs]], prints_[starts[pairs] + 1]
            near = np.bitwise_count(a ^ b) <= bits
            found_a, found_b = [a[near]], [b[near]]
            for k in several[(ends - starts)[several] > 2]:
                if e := tree_edges(prints_[starts[k] : ends[k]], bits):
                    x = np.array(e, np.uint64)
                    found_a.append(x[:, 0])
                    found_b.append(x[:, 1])
            return pa.record_batch([pa.array(np.concatenate(x).view(np.int64)) for x in (found_a, found_b)], names=["a", "b"])

        for batch in batches:
            keys = np.concatenate([rest_keys, batch.column(0).to_numpy()])
            prints_ = np.concatenate([rest_prints, batch.column(1).to_numpy().view(np.uint64)])
            cut = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last key may go on in the next batch
            if cut:
                yield edges_of(keys[:cut], prints_[:cut])
            rest_keys, rest_prints = keys[cut:], prints_[cut:]
        if len(rest_keys):
            yield edges_of(rest_keys, rest_prints)

    n = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = variants(prints, layout).repartition(n, "key").sortWithinPartitions("key").transform(in_tasks, meet, "a long, b long")
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``fp, component``: for each node on an edge, the least ``id`` of the nodes it reaches.

    ``nodes`` is (fp, id), with distinct ids. Each round takes the least label of the neighbours and then the label
    of the node that has that label's id (pointer jumping), until no label changes. Rounds are written tables.
    """
    both = written(edges.unionByName(edges.selectExpr("b a", "a b")), "links")
    labels = written(both.select(F.col("a").alias("fp")).distinct().join(nodes, "fp").select("fp", "id", F.col("id").alias("component")), "labels")
    while True:
        near = both.join(labels.select(F.col("fp").alias("b"), "component"), "b").groupBy(F.col("a").alias("fp")).agg(F.min("component").alias("near"))
        least = labels.join(near, "fp").select("fp", "id", F.least("component", "near").alias("next"), "component")
        jumps = labels.select(F.col("id").alias("next"), F.col("component").alias("far"))
        moved = written(
            least.join(jumps, "next").select("fp", "id", F.least("next", "far").alias("component"), (F.least("next", "far") < F.col("component")).alias("moved")),
            "labels",
        )
        labels = moved.drop("moved")
        if not moved.where("moved").limit(1).count():
            return labels.select("fp", "component")


def clustered(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS) -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``."""
    rows = written(fingerprints(docs, shingle), "fingerprints")
    nodes = rows.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"))
    linked = components(nodes, links(nodes.select("fp"), bits))
    # written, so that the last join reads both sides from plain exchanges and Spark can split a hot fingerprint's rows
    of = written(nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "id").alias("component_id")), "fingerprint-components")
    return rows.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def digest(docs: DataFrame) -> DataFrame:
    return clustered(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
