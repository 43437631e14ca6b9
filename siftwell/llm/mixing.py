"""Mixing sources to target weights by weighted fair queueing.

Each source gets a target number of words: its weight's share of the budget, at most ``REPEATS`` times its size, the excess reshared by
weight. Its documents stand in a shuffled order and are offered again and again, up to ``REPEATS`` times. A copy's virtual finish time
is the number of the source's words up to its end, divided by the source's target; sources served fairly reach equal times
together. All copies are sorted by that time over the whole corpus and taken until the budget is full. A source's last
copy is cut where its target ends, the last of all where the budget does.

Rows are narrow (no text) once sizes are known. Running sums come from range partitions: a sum inside each, and the sums of those before
from a table of a row per task and source. A source of a third of all rows is many ranges of its own, never one task.

Defined results: a null text has size 0, a document of size 0 is never taken; a null source is one of its own and comes last; null ids are shuffled
like others; repeated rows are rows of their own (equal ones share the shuffle's place in no stated order); a corpus without words has targets of 0; an empty table
gives an empty one; a text of any length is a number; extra columns are not read. Runs agree: the shuffle is a hash of the id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import in_tasks, ranked, written

#: Times that a document is taken at most, and a source's target as a part of its size.
REPEATS = 3
#: Weights of the sources by code point, again from the first after the last.
WEIGHTS = (1, 2, 3)
WORD = r"[^\x20\x09-\x0D]+"


def sizes(docs: DataFrame) -> DataFrame:
    """``doc_id, source, size`` per row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, budget: int | None = None) -> tuple[DataFrame, int]:
    """``source, source_size, weight, target`` of the sources of ``rows`` (source, size), written, and the budget (all words by default).

    The shared level (words per weight) rises while sources reach their caps; each rise is one aggregate over the sources, of which the driver sees two sums.
    """
    of = written(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    # a source takes part in the order as its own text behind a mark, so that null is last and apart from all texts
    of = written(ranked(of.withColumn("last", F.col("source").isNull()), [F.col("last"), F.col("source")], "mix-ranks").select("source", "source_size", weight.alias("weight")), "mix-weights")
    budget = of.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] if budget is None else budget
    full, held, open_ = F.lit(False), 0, None
    while True:
        capped, weighed = of.agg(F.coalesce(F.sum(F.when(full, repeats * F.col("source_size"))), F.lit(0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0))).first()
        if (capped, weighed) == (held, open_) or not weighed:
            break
        held, open_ = capped, weighed
        # capped where weight * (budget - capped) / weighed >= repeats * size, in whole numbers
        full = F.col("weight").cast("decimal(38,0)") * F.lit(budget - capped) >= F.lit(repeats * weighed) * F.col("source_size").cast("decimal(38,0)")
    target = F.when(full, (repeats * F.col("source_size")).cast("double")).otherwise((F.col("weight") * F.lit(budget - capped)).cast("double") / F.lit(float(weighed or 1)))
    return written(of.withColumn("target", target), "mix-targets"), budget


def _summed(rows: DataFrame, label: str, by: list[str], order: list[Column], value: str) -> tuple[DataFrame, DataFrame]:
    """``rows`` in global order, written, with ``part`` and ``upto``: the sum of ``value`` in its part and group up to and with the row; and ``part, by, total``.

    ``by``: columns that the order begins with.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = rows.columns
    at, groups = names.index(value), [names.index(c) for c in by]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            values = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            keys = list(zip(*(batch.column(k).to_pylist() for k in groups), strict=True)) if groups else [()] * len(values)
            upto = np.cumsum(values)
            starts = [0, *(k for k in range(1, len(keys)) if keys[k] != keys[k - 1])]
            held = (upto - values)[starts]  # sums begin again with each group; the first may go on from the batch before
            held[0] -= total if keys[0] == last else 0
            upto -= np.repeat(held, np.diff([*starts, len(keys)]))
            last, total = keys[-1], int(upto[-1])
            yield pa.record_batch([*batch.columns, pa.array(upto)], names=[*names, "part", "upto"])

    placed = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in placed.schema)
    table = written(placed.transform(in_tasks, add, f"{schema}, upto long"), label)
    return table, table.groupBy("part", *by).agg(F.sum(value).alias("total"))


def _copies(docs: DataFrame, weights: tuple[int, ...], repeats: int, budget: int | None) -> tuple[DataFrame, DataFrame, int]:
    """Rows with their sources' figures; the copies offered, with their virtual finish time; the budget."""
    rows = written(sizes(docs), "mix-rows")
    of, budget = targets(rows, weights, repeats, budget)
    shuffled = F.conv(F.substring(F.sha2(F.concat(F.lit("mix:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 15), 16, 10).cast("long")
    keyed = rows.withColumn("last", F.col("source").isNull()).withColumn("turn", shuffled)
    line, parts = _summed(keyed, "mix-line", ["last", "source"], [F.col(c) for c in ("last", "source", "turn", "doc_id", "size")], "size")
    before = F.coalesce(F.sum("total").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = parts.withColumn("before", before).join(of.withColumnsRenamed({"source": "of"}), F.col("source").eqNullSafe(F.col("of"))).select(F.col("part").alias("in_part"), F.col("source").alias("of"), "before", "source_size", "target")
    # the row number follows the written table; equal reads of it give equal numbers
    numbered = line.withColumn("row", F.monotonically_increasing_id())
    served = numbered.join(places, (F.col("part") == F.col("in_part")) & F.col("source").eqNullSafe(F.col("of")))
    served = written(served.select("row", "doc_id", "source", "size", "source_size", "target", (F.col("before") + F.col("upto")).alias("end")), "mix-served")
    copy = F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("copy")
    offered = served.where("size > 0").select("row", "doc_id", "source", "size", "source_size", "target", "end", copy).withColumn("end", F.col("end") + F.col("copy") * F.col("source_size"))
    # a copy that would begin at its source's target or later isn't offered; the one in which the target lies ends there
    cut = F.least(F.col("end"), F.floor("target"))
    words = (cut - F.col("end") + F.col("size")).cast("long")
    offered = offered.withColumn("words", words).where("words > 0").withColumn("finish", cut / F.col("target"))
    return served, offered.select("row", "doc_id", "source", "copy", "words", "finish", "end"), budget


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = REPEATS, budget: int | None = None) -> DataFrame:
    """The mix: ``row, doc_id, source, copy, words, finish, start`` for each copy taken; ``start`` is its first word's place in the mix, ``finish`` its virtual time."""
    return _taken(*_copies(docs, weights, repeats, budget)[1:])


def _taken(offered: DataFrame, budget: int) -> DataFrame:
    line, parts = _summed(offered, "mix-order", [], [F.col(c) for c in ("finish", "source", "end", "row")], "words")
    totals, starts, start = dict(parts.select("part", "total").collect()), [], 0  # a row per task
    for part in sorted(totals):
        starts.append((part, start))
        start += totals[part]
    of = line.sparkSession.createDataFrame(starts, "part int, before long")
    placed = line.join(F.broadcast(of), "part").withColumn("start", F.col("before") + F.col("upto") - F.col("words"))
    return placed.where(F.col("start") < budget).select("row", "doc_id", "source", "copy", F.least("words", F.lit(budget) - F.col("start")).alias("words"), "finish", "start")


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns: each row's size, its source's size and target, and the words that the mix takes of it."""
    served, offered, budget = _copies(docs, WEIGHTS, REPEATS, None)
    taken = _taken(offered, budget).groupBy("row").agg(F.sum("words").alias("taken"))
    return served.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))
