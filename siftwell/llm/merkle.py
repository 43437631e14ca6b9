"""Merkle manifest of a dataset: a digest tree over the rows of each language, and one over the languages' roots.

Nodes are labelled with the interval [lo, hi) of leaf ranks that they cover, so that ancestors are the nodes whose interval
contains a row's rank, and siblings are what is left of a parent's interval beside a node's own. Levels come in buckets of
``LEVELS``: the nodes of a bucket that one node above them covers (2 ** LEVELS at most) are one row, a chunk. Upwards, each bucket's
chunks give the entries of the next. Downwards, a chunk joins the path of the node that contains it, by tree, bucket and interval, and
hands it to its own entries; no join key has more than 2 ** LEVELS rows on either side, whatever share of the rows a tree holds.

Ranks come from range partitions and a table of a row per task and language. Texts are read once, for the leaves.

Defined results: every null field counts as ``-``; rows with null ids stand first in their language and are never tampered with; rows with one id
in a language stand by their leaves, so that repeated rows are leaves of their own; a null language is a tree of its own and comes first, before the empty
one; a text of any length is a digest; one row has no siblings (the digest of nothing as proof) and is leaf, subroot and root;
an empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_tasks, written

#: Levels in a bucket: chunks have 256 entries at most.
LEVELS = 8
#: Rows whose id's crc32 this divides count as tampered with.
TAMPERED = 7

_ENTRY = "rank bigint, digest binary, doc_id bigint, bad binary, name string"


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def _leaf(n_chars: Column) -> Column:
    fields = [F.col("doc_id").cast("long"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.unhex(F.sha2(F.concat(*map(_field, fields)), 256))


def leaves(docs: DataFrame, tampered: int = TAMPERED) -> DataFrame:
    """``tree, doc_id, digest, bad`` per row; ``bad`` is the leaf of the tampered row, null where nothing changes.

    Trees are named by the language behind a 1; 0 is that of null.
    """
    more = (F.col("n_chars").cast("decimal(20,0)") + 1).cast("string")
    touched = (F.crc32(F.col("doc_id").cast("string")) % tampered == 0) & F.col("n_chars").isNotNull()
    return docs.select(
        F.coalesce(F.concat(F.lit("1"), F.col("lang").cast("string")), F.lit("0")).alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        _leaf(F.col("n_chars").cast("long")).alias("digest"),
        F.when(touched, _leaf(more)).alias("bad"),
    )


def _ranked(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (written) with ``rank`` by ``order`` in its ``tree``, and the tree's number of rows, ``n``."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, "tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    table = written(placed.withColumn("part", F.shiftright("at", 33)), "merkle-order")
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("held").over(tree.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = table.groupBy("tree", "part").agg(F.count(F.lit(1)).alias("held"), F.min("at").alias("from"))
    places = counts.select("tree", "part", "from", before.alias("before"), F.sum("held").over(tree).alias("n"))
    return table.join(places, ["tree", "part"]).withColumn("rank", F.col("at") - F.col("from") + F.col("before")).drop("at", "part", "from", "before")


def digest_of(*parts: bytes) -> bytes:
    """The contract's H of digests: sha256 of their hex texts."""
    return hashlib.sha256(b"".join(p.hex().encode() for p in parts)).digest()


def grown(digests: list[bytes], low: int, n: int, level: int) -> list[list[tuple[int, int, bytes]]]:
    """The nodes (lo, hi, digest) of a chunk, level by level, its entries first; of a tree of ``n`` leaves no level is made above the one with a single node.

    Entries are nodes of ``level``, the first of them number ``low`` there.
    """
    nodes = [(k << level, min(k + 1 << level, n), d) for k, d in enumerate(digests, low)]
    out, top = [nodes], min(level + LEVELS, (n - 1).bit_length())
    for above in range(level + 1, top + 1):
        runs: dict[int, list[tuple[int, int, bytes]]] = {}
        for node in nodes:
            runs.setdefault(node[0] >> above, []).append(node)
        nodes = [(run[0][0], run[-1][1], digest_of(*(d for _, _, d in run))) for run in runs.values()]
        out.append(nodes)
    return out


#: A step of a path: where the sibling stands, and its digest; alone means that the node had none and was digested by itself.
_LEFT, _RIGHT, _ALONE, _STEP = b"l", b"r", b"a", 33


def paths(levels: list[list[tuple[int, int, bytes]]], level: int) -> list[bytes]:
    """For each entry of a chunk the steps up to the chunk's own node: siblings by the difference of the parent's interval and the node's."""
    known = [{lo: (hi, d) for lo, hi, d in nodes} for nodes in levels]
    out = []
    for rank, _, _ in levels[0]:
        steps = []
        for k in range(len(levels) - 1):
            lo, above = rank >> level + k << level + k, rank >> level + k + 1 << level + k + 1
            hi, end = known[k][lo][0], known[k + 1][above][0]
            if above < lo:
                steps.append(_LEFT + known[k][above][1])
            elif hi < end:
                steps.append(_RIGHT + known[k][hi][1])
            else:
                steps.append(_ALONE + bytes(_STEP - 1))
        out.append(b"".join(steps))
    return out


def folded(leaf: bytes, path: bytes) -> bytes:
    for k in range(0, len(path), _STEP):
        side, sibling = path[k : k + 1], path[k + 1 : k + _STEP]
        leaf = digest_of(sibling, leaf) if side == _LEFT else digest_of(leaf, sibling) if side == _RIGHT else digest_of(leaf)
    return leaf


def siblings(path: bytes) -> list[bytes]:
    return [path[k + 1 : k + _STEP] for k in range(0, len(path), _STEP) if path[k : k + 1] != _ALONE]


def _chunks(entries: DataFrame, level: int) -> DataFrame:
    """Chunks ``tree, n, lo, hi, bucket, held, digest`` of ``entries`` (tree, n, and the columns of an entry), which are nodes of ``level``, written."""
    schema = f"tree string, n bigint, lo bigint, hi bigint, bucket bigint, held array<struct<{_ENTRY.replace(' ', ':', 1).replace(', ', ',').replace(' ', ':')}>>, digest binary"

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tops = []
            for n, bucket, held in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                tops.append(grown([e["digest"] for e in held], bucket << LEVELS, n, level)[-1][0])
            lo, hi, own = zip(*tops, strict=True) if tops else ((), (), ())
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lo, pa.int64()), pa.array(hi, pa.int64()), batch.column(2), batch.column(3), pa.array(own, pa.binary())], names=["tree", "n", "lo", "hi", "bucket", "held", "digest"])

    held = F.array_sort(F.collect_list(F.struct("rank", "digest", "doc_id", "bad", "name"))).alias("held")
    grouped = entries.withColumn("bucket", F.shiftright("rank", LEVELS)).groupBy("tree", "n", "bucket").agg(held)
    return written(grouped.transform(in_tasks, grow, schema), "merkle-chunks")


def _tiers(entries: DataFrame) -> list[DataFrame]:
    """The chunks of each bucket of levels, from the leaves up: as many buckets as the largest tree needs."""
    nothing = [F.lit(None).cast(kind).alias(name) for name, kind in (("doc_id", "long"), ("bad", "binary"), ("name", "string"))]
    out = [_chunks(entries, 0)]
    while out[-1].where("bucket > 0").limit(1).count():
        level = LEVELS * len(out)
        above = out[-1].where(F.col("n") > 1 << level).select("tree", "n", F.col("bucket").alias("rank"), "digest", *nothing)
        out.append(_chunks(above, level))
    return out


def _ended(tiers: list[DataFrame]) -> list[DataFrame]:
    """Of each bucket of levels the chunks that are whole trees."""
    return [rows.where(F.col("n") <= 1 << LEVELS * (k + 1)) for k, rows in enumerate(tiers)]


_PATH = "tree string, lo bigint, hi bigint, path binary, subroot binary, root binary"


def _descended(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The lowest chunks with the ``path`` above them: containment joins from the top bucket of levels down.

    ``tops`` (tree, path, subroot, root) has what stands above whole trees.
    """
    known = None
    for k in range(len(tiers) - 1, -1, -1):
        whole = _ended(tiers)[k].join(tops, "tree")
        rows = whole.select("tree", "n", "lo", "hi", "bucket", "held", "path", "subroot", "root")
        if known is not None:
            above = known.select(F.col("tree").alias("of"), F.col("lo").alias("from"), F.col("hi").alias("to"), "path", "subroot", "root").withColumn("under", F.shiftright("from", LEVELS * (k + 1)))
            inside = (F.col("tree") == F.col("of")) & (F.col("bucket") == F.col("under")) & (F.col("from") <= F.col("lo")) & (F.col("hi") <= F.col("to"))
            rows = rows.unionByName(tiers[k].join(above, inside).select(*rows.columns))
        known = written(_entry_paths(rows, LEVELS * k), "merkle-paths") if k else rows
    return known


def _entry_paths(chunks: DataFrame, level: int) -> DataFrame:
    """Per entry of the ``chunks`` its interval and its path to the top."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for tree, n, _, _, bucket, held, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                levels = grown([e["digest"] for e in held], bucket << LEVELS, n, level)
                out += [(tree, lo, hi, own + path, subroot, root) for (lo, hi, _), own in zip(levels[0], paths(levels, level), strict=True)]
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            columns = zip(*out, strict=True) if out else [()] * 6
            yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["tree", "lo", "hi", "path", "subroot", "root"])

    return chunks.transform(in_tasks, walk, _PATH)


def _grown_trees(docs: DataFrame) -> tuple[list[DataFrame], list[DataFrame]]:
    """The chunks of the languages' trees and those of the tree over their roots, whose entries bear the languages' trees as names."""
    named = F.lit(None).cast("string").alias("name")
    tiers = _tiers(_ranked(written(leaves(docs).withColumn("name", named), "merkle-leaves"), "doc_id", "digest"))
    ended = [rows.select("tree", "digest") for rows in _ended(tiers)]
    roots = ended[0]
    for rows in ended[1:]:
        roots = roots.unionByName(rows)
    over = roots.select(F.lit("").alias("tree"), F.lit(None).cast("long").alias("doc_id"), "digest", F.lit(None).cast("binary").alias("bad"), F.col("tree").alias("name"))
    return tiers, _tiers(_ranked(written(over, "merkle-roots"), "name"))


def proved(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, path, folded_root`` (binary) per row; ``path`` has the steps of its proof, ``folded_root`` is folded from the leaf of the row as it may have been tampered with."""
    tiers, over = _grown_trees(docs)
    nothing = F.lit(None).cast("binary")
    top = _ended(over)[-1].select("tree", F.lit(b"").alias("path"), nothing.alias("subroot"), F.col("digest").alias("root"))
    by_name = _descended(over, top)
    tops = written(_named_paths(by_name), "merkle-tops")

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, n, _, _, bucket, held, path, subroot, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = paths(grown([e["digest"] for e in held], bucket << LEVELS, n, 0), 0)
                out += [(e["doc_id"], e["digest"], subroot, root, way + path, folded(e["bad"] or e["digest"], way + path)) for e, way in zip(held, own, strict=True)]
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            yield pa.record_batch([pa.array(columns[0], pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["doc_id", "leaf", "subroot", "root", "path", "folded_root"])

    return _descended(tiers, tops).transform(in_tasks, prove, "doc_id long, leaf binary, subroot binary, root binary, path binary, folded_root binary")


def _named_paths(chunks: DataFrame) -> DataFrame:
    """For each tree that an entry of the ``chunks`` names: the path above it, its root as ``subroot``, and the root of all."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for _, n, _, _, bucket, held, path, _, root in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = paths(grown([e["digest"] for e in held], bucket << LEVELS, n, 0), 0)
                out += [(e["name"], way + path, e["digest"], root) for e, way in zip(held, own, strict=True)]
            columns = list(zip(*out, strict=True)) if out else [()] * 4
            yield pa.record_batch([pa.array(columns[0], pa.string()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["tree", "path", "subroot", "root"])

    return chunks.transform(in_tasks, walk, "tree string, path binary, subroot binary, root binary")


def nodes(docs: DataFrame) -> DataFrame:
    """The manifest: ``lang, level, lo, hi, digest`` of every node of the languages' trees; leaves are level 0, and of each the interval of ranks in its language."""
    tiers, _ = _grown_trees(docs)
    out = None
    for k, tier in enumerate(tiers):
        level = LEVELS * k

        def walk(batches: Iterator[pa.RecordBatch], level: int = level) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for tree, n, bucket, held in zip(*(batch.column(c).to_pylist() for c in ("tree", "n", "bucket", "held")), strict=True):
                    made = grown([e["digest"] for e in held], bucket << LEVELS, n, level)
                    # entries above the leaves are the last nodes of the bucket below
                    rows += [(tree, level + j, lo, hi, d) for j, found in enumerate(made) if j or not level for lo, hi, d in found]
                kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                columns = list(zip(*rows, strict=True)) if rows else [()] * 5
                yield pa.record_batch([pa.array(c, kind) for c, kind in zip(columns, kinds, strict=True)], names=["tree", "level", "lo", "hi", "digest"])

        found = tier.transform(in_tasks, walk, "tree string, level int, lo bigint, hi bigint, digest binary")
        out = found if out is None else out.unionByName(found)
    lang = F.when(F.col("tree") != "0", F.substring("tree", 2, 1 << 30))
    return out.select(lang.alias("lang"), "level", "lo", "hi", F.lower(F.hex("digest")).alias("digest"))


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns from ``proved``."""
    def hexed(c: str) -> Column:
        return F.lower(F.hex(c))

    # a path's siblings as hex text: steps without one go, and each step's mark
    step = "substring(path, 33 * k + 1, 33)"
    held = F.expr(f"filter(transform(sequence(0, cast(length(path) / 33 as int)), k -> {step}), s -> length(s) = 33 and substring(s, 1, 1) <> X'61')")
    proof = F.array_join(F.transform(held, lambda s: F.lower(F.hex(F.substring(s, 2, 32)))), "")
    return proved(docs).select(
        "doc_id",
        hexed("leaf").alias("leaf"),
        hexed("subroot").alias("subroot"),
        hexed("root").alias("root"),
        F.sha2(proof, 256).alias("proof_sha256"),
        hexed("folded_root").alias("folded_root"),
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
