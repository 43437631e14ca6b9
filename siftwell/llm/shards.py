"""Balanced label propagation: documents with equal texts move to common shards of even size.

The links join documents of equal text. All rounds work on cells, the (group, first shard) pairs with
their counts, because documents of one cell always move together: a group never has more cells than shards.
In each round a group's cells move to the shard that holds most of the group, as far as that shard's
quota (its even share of all rows, less the linked rows it has) allows; a cell is accepted by hash with
the probability quota / demand. Documents without links fill what room is left. A last global ranking by
(shard, group, doc_id) cuts the rows into ranges whose counts differ by one at most (the ``rows`` law), so
that drift left by the rounds costs one cut group per shard border at most.

Only DataFrame functions are used. Tables over shards (40 rows) are all that is broadcast or collected.

Rounds end when no group is spread or no cell moves (``cut_groups`` gives the groups still cut). A text of any length is a size and a hash.

Groups are told apart by 64 bits of a hash of the text: two unlike texts among a billion pass for one with a chance of 3 in 100, and would only be kept together.

Defined results: a null id is dealt like any other; a null text has size 16, crc32 of nothing (0) and no links; repeated rows are rows of their
own; fewer rows than shards leave shards empty; an empty table gives an empty table; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ranked, written

SHARDS = 40
#: Most rounds; fewer are made when no group is spread any more or no cell moves.
ROUNDS = 12


def _rows(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
        F.when(text.isNotNull(), F.xxhash64(text)).alias("group"),
    )


def _uniform(*columns) -> F.Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 30)) / F.lit(float(1 << 30))


def _moved(cells: DataFrame, share: float, round_: int, shards: int) -> DataFrame:
    """One round: ``cells`` (group, first, shard, n) with new shards."""
    held = dict(cells.groupBy("shard").agg(F.sum("n")).collect())  # a row per shard
    room = {s: max(0.0, share - held.get(s, 0)) for s in range(shards)}
    rooms = F.create_map(*[F.lit(x) for pair in room.items() for x in pair])
    mine = cells.groupBy("group", "shard").agg(F.sum("n").alias("n"))
    liked = mine.where((rooms[F.col("shard")] > 0)).groupBy("group").agg(F.max_by("shard", F.struct("n", F.xxhash64("group", "shard", F.lit(round_)))).alias("liked"))
    wish = cells.join(liked, "group", "left").withColumn("liked", F.coalesce("liked", "shard"))
    demand = dict(wish.where("liked <> shard").groupBy("liked").agg(F.sum("n")).collect())  # a row per shard
    chance = F.create_map(*[F.lit(x) for s in range(shards) for x in (s, min(1.0, room[s] / demand[s]) if demand.get(s) else 0.0)])
    accepted = _uniform("group", "shard", F.lit(round_)) < chance[F.col("liked")]
    return wish.withColumn("shard", F.when(accepted, F.col("liked")).otherwise(F.col("shard"))).drop("liked")


def cut_groups(rows: DataFrame) -> int:
    """Groups of ``rows`` (group, shard) that stand in more than one shard."""
    spread = rows.where(F.col("group").isNotNull()).groupBy("group").agg(F.min("shard").alias("low"), F.max("shard").alias("high"))
    return spread.where("low <> high").count()


def sharded(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` per row of ``docs``."""
    rows = written(_rows(docs).withColumn("first", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int")), "shard-rows")
    cells = rows.where(F.col("group").isNotNull()).groupBy("group", "first").agg(F.count(F.lit(1)).alias("n"))
    linked = cells.groupBy("group").agg(F.sum("n").alias("all")).where(F.col("all") > 1).select("group")
    cells = written(cells.join(linked, "group").select("group", "first", F.col("first").alias("shard"), "n"), "shard-cells")
    total = rows.count()
    for k in range(rounds):
        before = cells
        cells = written(_moved(cells, total / shards, k, shards), "shard-cells")
        if cut_groups(cells) == 0 or not cells.join(before.withColumnRenamed("shard", "was"), ["group", "first"]).where("shard <> was").limit(1).count():
            break

    held = dict(cells.groupBy("shard").agg(F.sum("n")).collect())  # a row per shard
    room = [max(0.0, total / shards - held.get(s, 0)) for s in range(shards)]
    ends = [sum(room[: s + 1]) / (sum(room) or 1.0) for s in range(shards)]
    filler = F.least(F.aggregate(F.array(*map(F.lit, ends)), F.lit(0), lambda n, x: n + (x <= _uniform("doc_id", "size", F.lit("fill"))).cast("int")), F.lit(shards - 1))
    placed = rows.join(cells.select("group", "first", "shard"), ["group", "first"], "left").withColumn("near", F.coalesce("shard", filler)).drop("shard", "first")
    order = [F.col(c) for c in ("near", "group", "doc_id", "size", "text_crc32")]
    base, more = divmod(total, shards)  # the first ``more`` shards have one row more
    line = ranked(placed, order, "shard-ranks")
    large = more * (base + 1)
    shard = F.when(F.col("rank") < large, F.floor(F.col("rank") / (base + 1))).otherwise(more + F.floor((F.col("rank") - large) / max(base, 1)))
    start = F.least(F.col("shard").cast("long"), F.lit(more)) + F.col("shard").cast("long") * base
    return line.withColumn("shard", shard.cast("int")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("rank") - start).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "group"
    )
