"""Which source passage a piece of an answer comes from, for many answers at once."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.shared import shared_folder, written
from . import passages as P

# Fixed values of the scoring.
OVERLAP_WEIGHT, NUMBER_PENALTY, MAX_PENALTY = 0.2, 0.15, 2
PAIR_BATCH = 32  # pairs that a scorer takes at once
FLOOR, STRONG, MOST = 0.57, 0.83, 3
AUTO_SHARE = 0.5


def hash_embed(texts: list[str], dim: int = 64) -> np.ndarray:
    """Default embedder: distinct lower-case words by crc32 into ``dim`` places, unit length; nothing becomes the first axis."""
    import re
    import zlib

    own = [[zlib.crc32(w.encode()) % dim for w in set(re.findall(r"\w+", text.lower()))] for text in texts]
    rows = np.repeat(np.arange(len(texts)), np.array([len(x) for x in own], np.int64))
    places = rows * dim + np.fromiter((x for row in own for x in row), np.int64)
    out = np.bincount(places, minlength=len(texts) * dim).reshape(-1, dim).astype(np.float32)
    out[~out.any(1), 0] = 1
    return out / np.sqrt((out * out).sum(1, keepdims=True))


def embed(rows: DataFrame, column: str = "text", make: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> Column:
    """Unit vectors of a text column. ``make`` gives an embedder once per Python worker and task."""

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make() if make else hash_embed
        for texts in batches:
            yield pd.Series(list(model([t or "" for t in texts])))

    return run(column)


def pair_scores(pairs: DataFrame, make: Callable[[], Callable[[list[str], list[str]], list[float]]] | None = None, batch: int = PAIR_BATCH) -> DataFrame:
    """``pairs`` (query_text, text) with ``score``: a scorer's, or the share of the query's trigrams in the text.

    ``make`` gives a scorer (query texts, texts) once per Python worker and task; it is called with ``batch`` pairs of like length, so
    that a model that pads its input wastes little. A null text is an empty one.
    """
    if make is None:
        return pairs.withColumn("score", T.trigram_overlap(T.trigrams(F.col("query_text")), T.trigrams(F.col("text"))))

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        score = make()
        for queries, texts in batches:
            asked, given = queries.fillna("").to_numpy(), texts.fillna("").to_numpy()
            order = np.argsort([len(q) + len(t) for q, t in zip(asked, given, strict=True)], kind="stable")
            out = np.empty(len(order))
            for k in range(0, len(order), batch):
                at = order[k : k + batch]
                out[at] = score(list(asked[at]), list(given[at]))
            yield pd.Series(out)

    return pairs.withColumn("score", run("query_text", "text"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def auto_citation(answers: DataFrame, sources: DataFrame, share: float = AUTO_SHARE) -> DataFrame:
    """``answer_id, n``: the source that shares most of an answer's trigrams, the first of equals, if at least half; null for answers that cite one of their sources."""
    own = answers.select("answer_id", "content", T.trigrams(F.col("content")).alias("grams"))
    counts = sources.groupBy("answer_id").agg(F.count(F.lit(1)).cast("int").alias("count"))
    asked = own.join(counts, "answer_id").where((F.size(T.cited_numbers(F.col("content"), F.col("count"))) == 0) & (F.size("grams") > 0))
    pairs = asked.join(sources, "answer_id").withColumn("share", T.trigram_overlap(F.col("grams"), T.trigrams(F.col("text"))))
    best = pairs.groupBy("answer_id").agg(F.max(F.struct("share", -F.col("n"))).alias("best")).where(F.col("best.share") >= share)
    return own.select("answer_id").join(best.select("answer_id", (-F.col("best")["col2"]).cast("int").alias("n")), "answer_id", "left")


def stored_vectors(texts: DataFrame, store: str, make: Callable[[], Callable[[list[str]], np.ndarray]] | None = None) -> DataFrame:
    """``h, vector`` of all contents in the folder ``store``, after those of ``texts`` (h, text) that it lacks were embedded and added.

    ``h`` is a hash of the text. A run adds a folder of its own, whole or not at all; a content that two runs added at once counts once. A store holds the vectors of one model.
    """
    spark, schema = texts.sparkSession, "h string, vector array<float>"
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{store}/run=none")  # so that there is one
    stored = lambda: spark.read.schema(schema).option("recursiveFileLookup", True).parquet(store)
    new = texts.join(stored().select("h"), "h", "left_anti").groupBy("h").agg(F.any_value("text").alias("text"))
    new.select("h", embed(new, "text", make).alias("vector")).write.parquet(f"{store}/run={uuid.uuid4().hex}")
    return stored().groupBy("h").agg(F.any_value("vector").alias("vector"))


def windows_of(sources: DataFrame, make=None, store: str | None = None) -> DataFrame:
    """Windows of sources (message_id, n, text) with vector and numbers.

    Vectors come from the ``store``, by the hash of a window's text: equal texts are embedded once, and with a store that is kept once for all jobs. Every
    window has one; the join is an outer one, as Spark leaves that out where no vector is asked for.
    """
    cut = P.text_windows(sources, ["message_id", "n"])
    cut = written(cut.withColumn("h", F.sha2("text", 256)).withColumn("numbers", T.numbers(F.col("text"))), "windows")
    vectors = stored_vectors(cut.select("h", "text"), store or shared_folder(sources.sparkSession, "vectors"), make)
    return cut.join(vectors, "h", "left").select("message_id", "n", "win", "start", "end", "text", "vector", "numbers")


def known_numbers(selections: DataFrame, windows: DataFrame) -> DataFrame:
    """``selection_id, known, n_sources``: all numbers in the windows of a selection's sources (those of its message, or ``only`` one), and how many sources those are."""
    scope = windows.select("message_id", "n", F.explode_outer("numbers").alias("x")).distinct()
    per = selections.select("selection_id", "message_id", "only").join(scope, "message_id").where(F.col("only").isNull() | (F.col("only") == F.col("n")))
    return per.groupBy("selection_id").agg(F.array_sort(F.collect_set("x")).alias("known"), F.countDistinct("n").alias("n_sources"))


def attribute(selections: DataFrame, windows: DataFrame, make=None) -> DataFrame:
    """``selection_id, n, start, end, label, score``: up to three matches of each selection (selection_id, message_id, content, selection, only).

    Windows are (message_id, n, win, start, end, text, vector, numbers), with trigrams of their own as ``grams`` if there are any.
    Score: cosine + 0.2 x shared trigrams - 0.15 x numbers (2 at most) that some window has but this one lacks. Windows of cited sources
    come first, then by score, source and place; below 0.57 none counts. Strong is a score of 0.83 with every number known to some window. With several sources one window of each is taken,
    with one source windows that don't overlap.
    """
    clean = T.strip_markers(F.col("selection"))
    cited = P.per_row(lambda c, s: P.cited_in(c or "", s or ""), "array<int>", F.col("content"), F.col("selection"))
    asked = selections.select("selection_id", "message_id", "only", cited.alias("cited"), clean.alias("clean"))
    asked = asked.withColumn("s_vector", embed(asked, "clean", make)).withColumn("s_grams", T.trigrams(F.col("clean"))).withColumn("s_numbers", T.numbers(F.col("clean")))
    known = known_numbers(asked, windows)
    pairs = asked.join(known, "selection_id").join(windows, "message_id").where(F.col("only").isNull() | (F.col("only") == F.col("n")))
    cosine = dot(F.col("vector"), F.col("s_vector"))
    near = pairs.where(F.round(cosine + OVERLAP_WEIGHT, 6) >= FLOOR)  # what all trigrams could still bring to the floor
    grams = F.col("grams") if "grams" in windows.columns else T.trigrams(F.col("text"))
    wanted = F.array_intersect("s_numbers", "known")
    missing = F.size(F.array_except(wanted, F.col("numbers")))
    score = F.round(cosine + OVERLAP_WEIGHT * T.trigram_overlap(F.col("s_grams"), grams) - NUMBER_PENALTY * F.least(missing, F.lit(MAX_PENALTY)), 6)
    strong = F.size(F.array_except("s_numbers", "known")) == 0
    scored = near.withColumn("score", score).where(F.col("score") >= FLOOR).select(
        "selection_id", "n", "win", "start", "end", "n_sources", "score", (~F.array_contains("cited", F.col("n"))).alias("uncited"),
        F.when((F.col("score") >= STRONG) & strong, "strong").otherwise("partial").alias("label"),
    )
    scored = written(scored, "attribution")  # read for both kinds of selection
    order = [F.col("uncited"), F.desc("score"), F.col("n"), F.col("win")]
    several = scored.where("n_sources > 1").withColumn("r", F.row_number().over(Window.partitionBy("selection_id", "n").orderBy(*order))).where("r = 1")
    several = several.withColumn("r", F.row_number().over(Window.partitionBy("selection_id").orderBy(*order))).where(F.col("r") <= MOST)

    # From the best on, a window that overlaps none of those taken, three at most.
    best = F.array_sort(F.collect_list(F.struct("uncited", (-F.col("score")).alias("below"), "n", "win", "start", "end", "label", "score")))
    free = lambda kept, w: (F.size(kept) < MOST) & ~F.exists(kept, lambda k: (w["start"] < k["end"]) & (w["end"] > k["start"]))
    apart = F.aggregate("best", F.slice("best", 1, 0), lambda kept, w: F.when(free(kept, w), F.concat(kept, F.array(w))).otherwise(kept))
    listed = scored.where("n_sources = 1").groupBy("selection_id").agg(best.alias("best"))
    single = listed.select("selection_id", F.posexplode(apart).alias("r", "w")).select("selection_id", "w.*", (F.col("r") + 1).alias("r"))
    columns = ["selection_id", "n", "start", "end", "label", "score", "r"]
    return several.select(*columns).unionByName(single.select(*columns))
