"""Quality figures of retrieval, gates, attribution and recognised text."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import passages as P

HIT_AT = (1, 4, 10)


def hit_rates(results: DataFrame) -> DataFrame:
    """Share of answerable questions (lang, rank) with a hit in the first 1, 4 and 10, by language and overall (lang null)."""
    rates = [F.avg(F.coalesce(F.col("rank") <= k, F.lit(False)).cast("int")).alias(f"hit_{k}") for k in HIT_AT]
    return results.groupingSets([["lang"], []], "lang").agg(F.count(F.lit(1)).alias("n"), *rates)


def threshold_sweep(results: DataFrame) -> DataFrame:
    """For 0.20, 0.21 ... 0.80: accuracy of best_similarity >= t against ``answerable``; the winners' range and the middle one.

    Results are counted per hundredth before the thresholds come in, so that the sweep is over 61 rows.
    """
    binned = results.groupBy(F.greatest(F.lit(19), F.least(F.lit(80), F.floor(F.round(F.col("best_similarity") * 100, 6)))).alias("bin")).agg(
        F.sum(F.col("answerable").cast("int")).alias("yes"), F.sum((~F.col("answerable")).cast("int")).alias("no")
    )
    steps = results.sparkSession.range(20, 81).select(F.col("id").cast("int").alias("step"))
    right = F.sum(F.when(F.col("bin") >= F.col("step"), F.col("yes")).otherwise(F.col("no")))
    each = steps.crossJoin(F.broadcast(binned)).groupBy("step").agg((right / F.sum(F.col("yes") + F.col("no"))).alias("accuracy"))  # 61 x 62 rows at most
    best = each.withColumn("best", F.max("accuracy").over(Window.partitionBy())).where("accuracy = best")
    listed = best.groupBy("best").agg(F.array_sort(F.collect_list("step")).alias("steps"))
    return listed.select(
        F.col("best").alias("accuracy"), (F.element_at("steps", 1) / 100).alias("first"), (F.element_at("steps", -1) / 100).alias("last"),
        (F.element_at("steps", (F.floor(F.size("steps") / 2) + 1).cast("int")) / 100).alias("recommended"),
    )


def attribution_summary(cases: DataFrame) -> DataFrame:
    """Per group of cases (group, id, expect, expect_n, label, n): accuracies, rejections and the ids of each kind of mistake; null without such cases."""
    none = F.col("expect") == "none"
    right = F.col("n").eqNullSafe(F.col("expect_n"))
    listed = lambda when: F.array_sort(F.collect_list(F.when(when, F.col("id"))))
    return cases.groupBy("group").agg(
        F.count(F.lit(1)).alias("cases"),
        F.avg(F.when(~none, right.cast("int"))).alias("n_accuracy"),
        F.avg(F.col("label").eqNullSafe(F.col("expect")).cast("int")).alias("label_accuracy"),
        F.avg(F.when(none, (F.col("label") == "none").cast("int"))).alias("rejection_rate"),
        listed(none & (F.col("label") != "none")).alias("false_matches"),
        listed(~none & ~right).alias("wrong_sources"),
        listed(~none & ~right & (F.col("label") == "strong")).alias("strong_on_wrong"),
    )


def _words_hit(truth: str | None, text: str | None) -> float:
    wanted, given = (Counter(re.findall(r"\S+", t or "", re.ASCII)) for t in (truth, text))
    return sum((wanted & given).values()) / max(1, sum(wanted.values()))


def _with_words(pairs: DataFrame) -> DataFrame:
    return pairs.where(F.col("truth").rlike(r"\S"))


def _word_hit() -> Column:
    return P.per_row(_words_hit, "double", F.lower("truth"), F.lower("text"))


def _error_rate(truth: str | None, text: str | None, lang: str) -> float:
    plain, read = (P.normalise_text(t or "", lang) for t in (truth, text))
    return P.edit_distance(plain, read) / max(1, len(plain))


def _cer() -> Column:
    return P.per_row(_error_rate, "double", F.col("truth"), F.col("text"), F.col("lang"))


def _line_recall() -> Column:
    return P.per_row(lambda a, b, g: P.line_recall(a or "", b or "", g), "double", F.col("truth"), F.col("text"), F.col("lang"))


def word_hit(pairs: DataFrame) -> DataFrame:
    """``pair_id, word_hit``: multiset share of the truth's words (by white space) that the text has; pairs whose truth has none get no row."""
    return _with_words(pairs).select("pair_id", _word_hit().alias("word_hit"))


def cer(pairs: DataFrame) -> DataFrame:
    """``pair_id, cer``: edit distance over the truth's length; both texts (truth, text, lang) are normalised first."""
    return pairs.select("pair_id", _cer().alias("cer"))


def line_recall(pairs: DataFrame) -> DataFrame:
    """``pair_id, lang, line_recall`` of pairs (truth, text, lang)."""
    return pairs.select("pair_id", "lang", _line_recall().alias("line_recall"))


def text_scores(pairs: DataFrame) -> DataFrame:
    """``pair_id, lang, cer, line_recall, word_hit`` of the pairs whose truth has a word. All come from the pair's own row, so that pairs are made once and nothing is joined."""
    return _with_words(pairs).select("pair_id", "lang", _cer().alias("cer"), _line_recall().alias("line_recall"), _word_hit().alias("word_hit"))


def ocr_quality(scores: DataFrame) -> DataFrame:
    """Means by language of cer, line_recall and word_hit."""
    return scores.groupBy("lang").agg(*(F.avg(c).alias(c) for c in ("cer", "line_recall", "word_hit")))


def reading_order(boxes: DataFrame, gap: float = 10.0) -> DataFrame:
    """Boxes (page_id, box_id, x, y) with line and place: by mean y, a gap of 10 or more starts a line; inside a line by x."""
    down = Window.partitionBy("page_id").orderBy("y", "x", "box_id")
    lines = boxes.withColumn("new", (F.col("y") - F.lag("y").over(down) >= gap).cast("int"))
    lines = lines.withColumn("line", F.sum(F.coalesce("new", F.lit(0))).over(down))
    return lines.withColumn("place", F.row_number().over(Window.partitionBy("page_id").orderBy("line", "x", "box_id"))).drop("new")


def ocr_rects(pages: DataFrame, start: int = 0, end: int = 1 << 30) -> DataFrame:
    """Boxes of characters [start, end), all by default, of pages (page_id, text, boxes), merged per line; newlines break lines, empty boxes don't count."""
    # A page is one row, so the line of each character is known in the row (a newline is of the line that it starts); characters are merged before
    # anything is shuffled, and a row per line and task is.
    own = "transform(split(text, '\\n'), (l, i) -> array_repeat(i, length(l) + if(i > 0, 1, 0)))"
    beyond = "array_repeat(if(length(text) > 0, length(text) - length(replace(text, '\\n', '')), null), greatest(size(boxes) - length(text), 0))"  # boxes without a character
    chars = pages.select("page_id", F.posexplode(F.arrays_zip(F.expr(f"concat(flatten({own}), {beyond})").alias("line"), F.col("boxes").alias("b"))).alias("at", "x"))
    lined = chars.where(F.col("at").between(start, end - 1) & (F.col("x.b.x1") > F.col("x.b.x0"))).select("page_id", F.col("x.line").cast("long").alias("line"), "x.b")
    return lined.groupBy("page_id", "line").agg(F.min("b.x0").alias("x0"), F.min("b.y0").alias("y0"), F.max("b.x1").alias("x1"), F.max("b.y1").alias("y1"))


def numbered_text(lines: DataFrame, max_lines: int = 100_000, max_chars: int = 5_000_000) -> DataFrame:
    """Lines (doc_id, line, text) up to the limits, with ``truncated`` where the document goes on."""
    down = Window.partitionBy("doc_id").orderBy("line")
    summed = lines.withColumn("chars", F.sum(F.length("text") + 1).over(down)).withColumn("last", F.max("line").over(Window.partitionBy("doc_id")))
    fits = (F.col("line") <= max_lines) & (F.col("chars") <= max_chars)
    kept = summed.where(fits)
    return kept.withColumn("truncated", F.max("line").over(Window.partitionBy("doc_id")) < F.col("last")).select("doc_id", "line", "text", "truncated")
