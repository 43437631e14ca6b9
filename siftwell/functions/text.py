"""Text functions as Column expressions. Offsets and lengths are code points."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the data model.
WORD = r"[\p{L}\p{N}\x{0E00}-\x{0E7F}]+"
MAX_TERMS = 64
#: Decimal digits of all scripts below U+20000, and the ASCII ones that they stand for.
DIGITS = [chr(c) for c in range(0x80, 0x20000) if unicodedata.category(chr(c)) == "Nd"]
ASCII_DIGITS = "".join(str(unicodedata.decimal(c)) for c in DIGITS)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKER = r"\[\p{Nd}{1,3}(?:\s*,\s*\p{Nd}{1,3})*\]"
LIGHT = r"[\p{L}\s&&[^฀-๿　-鿿＀-￯]]"


def ascii_fold(c: Column) -> Column:
    """A-Z to lower case, nothing else."""
    return F.translate(c, UPPER, LOWER)


def words(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(WORD), F.lit(0))


def grams(c: Column, n: int = 3) -> Column:
    """Overlapping n-character pieces of a string, in order; none if it is shorter.

    The characters are taken out once: a substring at a place costs a walk to that place.
    """
    once = F.array(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)))
    pieces = F.transform(once, lambda x: F.when(F.size(x) >= n, F.transform(F.sequence(F.lit(0), F.size(x) - n), lambda i: F.concat(*(x[i + k] for k in range(n))))))
    return F.coalesce(pieces[0], F.array().cast("array<string>"))


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words, in first-seen order."""
    long_words = F.filter(words(c), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.flatten(F.transform(long_words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substr(w, i, F.lit(3))))))


def query_terms(c: Column) -> Column:
    """The first 64 trigrams; null when there are none."""
    t = trigrams(c)
    return F.when(F.size(t) > 0, F.slice(t, 1, MAX_TERMS))


def query_text(question: Column, previous: Column) -> Column:
    return F.concat_ws("\n", question, previous)


def trigram_overlap(a: Column, b: Column) -> Column:
    """Share of the trigrams of ``a`` that ``b`` has."""
    return F.size(F.array_intersect(a, b)) / F.greatest(F.lit(1), F.size(a))


def detect_language(c: Column) -> Column:
    """zh, th or en by what there is most of: Chinese characters, Thai characters or Latin words; ties in that order."""
    counts = [
        F.struct(F.regexp_count(c, F.lit(pattern)).alias("n"), F.lit(place).alias("place"), F.lit(code).alias("code"))
        for place, code, pattern in ((3, "zh", r"[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}]"), (2, "th", r"[\x{0E00}-\x{0E7F}]"), (1, "en", "[A-Za-z]+"))
    ]
    best = F.greatest(*counts)
    return F.when(best["n"] > 0, best["code"]).otherwise("en")


def estimate_tokens(c: Column) -> Column:
    """A third of the light characters (letters and spaces outside Thai and East Asian ranges), rounded up, and all others."""
    light = F.regexp_count(c, F.lit("(?U)" + LIGHT))
    return (F.length(c) - light + F.ceil(light / 3)).cast("long")


def strip_markers(c: Column) -> Column:
    """Without citation markers and the space before them; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*" + MARKER, ""), r"\s+", " "))


def cited_numbers(c: Column, count: Column) -> Column:
    """Numbers in [n] or [1, 2] markers that lie in 1..count, in order, repeats kept."""
    marks = F.regexp_extract_all(F.translate(c, "".join(DIGITS), ASCII_DIGITS), F.lit(MARKER), F.lit(0))
    every = F.flatten(F.transform(marks, lambda m: F.transform(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))))
    return F.filter(every, lambda n: n.between(F.lit(1), count))


def numbers(c: Column) -> Column:
    """Distinct numbers: digits of any script as ASCII; commas dropped where the whole number is in thousands (with a decimal part at most), else they
    split; leading zeros and, after one point or colon, trailing zeros dropped."""
    found = F.regexp_extract_all(F.translate(c, "".join(DIGITS), ASCII_DIGITS), F.lit(r"[0-9]+(?:[.,:][0-9]+)*"), F.lit(0))
    plain = F.transform(found, lambda x: F.when(x.rlike(r"^[0-9]{1,3}(?:,[0-9]{3})+(?:\.[0-9]+)?$"), F.replace(x, F.lit(","))).otherwise(x))
    split = F.flatten(F.transform(plain, lambda x: F.split(x, ",")))
    points = F.transform(split, lambda x: F.translate(x, ":", "."))
    heads = F.transform(points, lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", ""))
    return F.array_distinct(F.transform(heads, lambda x: F.when(x.rlike(r"^[0-9]+\.[0-9]+$"), F.regexp_replace(F.regexp_replace(x, "0+$", ""), r"\.$", "")).otherwise(x)))


def location_label(loc: Column) -> Column:
    """``p. 3``, ``pp. 3-4``, `` · OCR``; heading path and paragraphs (0-based there, 1-based here); ``line 7``, ``lines 7-9``."""

    def ranged(one: str, many: str, a: Column, b: Column) -> Column:
        return F.when(a == b, F.concat(F.lit(one), a.cast("string"))).otherwise(F.concat(F.lit(many), a.cast("string"), F.lit("-"), b.cast("string")))

    pdf = F.concat(ranged("p. ", "pp. ", loc["page_start"], loc["page_end"]), F.when(F.coalesce(loc["ocr"], F.lit(False)), " · OCR").otherwise(""))
    paragraphs = ranged("para. ", "paras. ", loc["paragraph_start"] + 1, loc["paragraph_end"] + 1)
    heading = F.array_join(loc["heading_path"], " > ")
    docx = F.when(heading != "", F.concat(heading, F.lit(", "), paragraphs)).otherwise(paragraphs)
    return F.when(loc["kind"] == "pdf", pdf).when(loc["kind"] == "docx", docx).when(loc["kind"] == "text", ranged("line ", "lines ", loc["line_start"], loc["line_end"])).when(loc["kind"] == "notes", "notes")


LOCATION = "struct<kind:string,page_start:int,char_start:int,page_end:int,char_end:int,ocr:boolean,heading_path:array<string>,paragraph_start:int,paragraph_end:int,line_start:int,line_end:int>"


def excerpt(c: Column, query: Column, before: int = 40, size: int = 120) -> Column:
    """``size`` characters from ``before`` before the first match (A-Z ignoring case), on one line, with … at cut edges."""
    at = F.instr(ascii_fold(c), ascii_fold(query))
    start = F.greatest(F.lit(1), at - before)
    cut = F.substr(c, start, F.lit(size))
    line = F.trim(F.regexp_replace(cut, r"\s+", " "))
    return F.when(at > 0, F.concat(F.when(start > 1, "…").otherwise(""), line, F.when(start + size - 1 < F.length(c), "…").otherwise("")))


def chat_title(c: Column, size: int = 60) -> Column:
    return F.substring(F.trim(F.regexp_replace(c, r"\s+", " ")), 1, size)


def garbled_thai(c: Column) -> Column:
    """Echoes in a page of Thai text: a syllable's marks said twice, marks without a letter, and short lines, beginning with a consonant, that repeat the end of the line before."""
    marks = r"[\x{0E31}\x{0E34}-\x{0E3A}\x{0E47}-\x{0E4E}]"
    doubled = F.regexp_count(c, F.lit(rf"([ก-ฮ]{marks}+)[ก-ฮ]\1"))
    orphans = F.regexp_count(c, F.lit(rf"(?<![\x{{0E01}}-\x{{0E5B}}]){marks}"))
    breaks = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
    lines = F.filter(F.transform(F.split(c, breaks), lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: x != "")
    fold = F.aggregate(
        lines,
        F.struct(F.lit(0).alias("n"), F.lit("").alias("last")),
        lambda s, x: F.struct(
            (s["n"] + F.when((s["last"] != "") & (F.length(x) <= 3) & x.rlike("^[ก-ฮ]") & (x != s["last"]) & F.contains(F.right(s["last"], F.lit(4)), x), 1).otherwise(0)).alias("n"),
            x.alias("last"),
        ),
        lambda s: s["n"],
    )
    return doubled + orphans + fold
