"""Sequential work inside one text: chunks, windows, citations, located passages. Pure helpers, and the Spark operators around them.

Each operator is a narrow map over rows (mapInPandas or a pandas UDF); what a helper holds is one document or answer.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Spans = list[tuple[int, int]]

# Fixed values of the data model.
CHUNK_TOKENS, OVERLAP_TOKENS = 450, 68
WINDOW_TOKENS, WINDOW_STRIDE, WINDOW_REACH = 60, 30, 24
MARKER = re.compile(r"\[\d{1,3}(?:\s*,\s*\d{1,3})*\]")
# A sentence ends at . ! ? before white space, a marker or the end; at 。！？; at a newline; markers right after it are still its own.
# Markers before white space end one as well, as Thai has no full stop.
_MARKERS = rf"(?:[ \t]*{MARKER.pattern})"
SENTENCE_END = re.compile(rf"(?:[.!?]+(?=[\s\[]|$)|[。！？]+|\n){_MARKERS}*|{_MARKERS}+(?=\s|$)")


def context_free(token_spans: Callable[[str], Spans]) -> Callable[[str], Spans]:
    """Marks a tokenizer whose tokens of a part of a text are those of the text, cut at the part's ends: chunks then take one call for each unit."""
    token_spans.context_free = True
    return token_spans


@context_free
def word_spans(text: str) -> Spans:
    return [m.span() for m in re.finditer(r"\S+", text)]


@context_free
def char_spans(text: str) -> Spans:
    return [m.span() for m in re.finditer(r"\S", text)]


class _Tokens:
    """Tokens of parts of a text: from one tokenisation where the tokenizer allows it, else of each part anew."""

    def __init__(self, text: str, token_spans: Callable[[str], Spans]):
        self.text, self.token_spans = text, token_spans
        self.whole = token_spans(text) if getattr(token_spans, "context_free", False) else None
        self.starts, self.ends = ([x[k] for x in self.whole or ()] for k in (0, 1))

    def within(self, a: int, b: int) -> tuple[int, Callable[[], Spans]]:
        """How many tokens text[a:b] has, and their places."""
        if self.whole is None:
            own = self.token_spans(self.text[a:b])
            return len(own), lambda: [(a + x, a + y) for x, y in own]
        low, high = bisect_right(self.ends, a), bisect_left(self.starts, b)
        return max(0, high - low), lambda: [(max(a, x), min(b, y)) for x, y in self.whole[low:high]]


def text_units(text: str) -> list[tuple[str, int]]:
    """Paragraphs (runs of non-blank lines) with their first line, from 1."""
    out, lines, first = [], [], 0
    for n, line in enumerate([*text.replace("\r\n", "\n").split("\n"), ""], 1):
        if line.strip():
            first = first or n
            lines.append(line)
        elif lines:
            out.append(("\n".join(lines), first))
            lines, first = [], 0
    return out


_BREAKS = (re.compile(r"\n\s*\n"), re.compile(r"(?<=[.!?])\s+|(?<=[。！？])(?![。！？])\s*"), re.compile(r"\n"), re.compile(r"\s+"))


def _pieces(tokens: _Tokens, a: int, b: int, limit: int, level: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, tokens) parts of text[a:b] of at most ``limit`` tokens, cut at the widest break that does, else between tokens."""
    n, spans = tokens.within(a, b)
    if n <= limit:
        return [(a, b, n)] if n else []
    part = tokens.text[a:b]
    for k in range(level, len(_BREAKS)):
        cuts = [m.span() for m in _BREAKS[k].finditer(part)]
        if cuts:
            out, at = [], a
            for x, y in [*cuts, (b - a, b - a)]:
                out += _pieces(tokens, at, a + x, limit, k + 1)
                at = a + y
            return out
    own = spans()
    return [(own[k][0], own[min(k + limit, n) - 1][1], min(limit, n - k)) for k in range(0, n, limit)]


def chunk_text(text: str, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, token_spans: Callable[[str], Spans] = word_spans) -> list[dict]:
    """Chunks of at most ``limit`` tokens, each with its first and last line; trailing pieces of at most ``overlap`` tokens are repeated.

    What a chunk has of one unit is the unit's own text, white space inside it included; units stand a blank line apart. Overlap pieces are shed from the front where the next piece would not fit beside them.
    """
    units, pieces = text_units(text), []
    for unit, (body, _) in enumerate(units):
        for a, b, n in _pieces(_Tokens(body, token_spans), 0, len(body), limit):
            part = body[a:b]
            pieces.append((unit, n, a + len(part) - len(part.lstrip()), a + len(part.rstrip())))
    chunks, current, fresh = [], [], False

    def emit() -> None:
        parts = []
        for unit in dict.fromkeys(p[0] for p in current):
            own = [p for p in current if p[0] == unit]
            parts.append(units[unit][0][own[0][2] : own[-1][3]])
        (one, _, start, _), (other, _, _, end) = current[0], current[-1]
        first, last = (units[u][1] + units[u][0].count("\n", 0, at) for u, at in ((one, start), (other, end)))
        chunks.append({"text": "\n\n".join(parts), "line_start": first, "line_end": last})

    for piece in pieces:
        if current and sum(p[1] for p in current) + piece[1] > limit:
            if fresh:
                emit()
            kept, total = [], 0
            for p in reversed(current):
                if total + p[1] > overlap:
                    break
                kept.insert(0, p)
                total += p[1]
            while kept and sum(p[1] for p in kept) + piece[1] > limit:
                kept.pop(0)
            current, fresh = kept, False
        current.append(piece)
        fresh = True
    if fresh:
        emit()
    return chunks


#: Texts that a task works on at once: its memory is theirs and their results', however many rows a batch has.
TEXTS = 64
_CHUNK = pa.schema([("doc_id", pa.int64()), ("ord", pa.int32()), ("text", pa.string()), ("line_start", pa.int32()), ("line_end", pa.int32())])


def few_rows(batches: Iterator[pa.RecordBatch], most: int = TEXTS) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def chunk_documents(docs: DataFrame, limit: int = CHUNK_TOKENS, overlap: int = OVERLAP_TOKENS, token_spans: Callable[[str], Spans] = word_spans) -> DataFrame:
    """``doc_id, ord, text, line_start, line_end`` from (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            rows = [(d, k, *c.values()) for d, t in zip(*(c.to_pylist() for c in batch.columns), strict=True) for k, c in enumerate(chunk_text(t or "", limit, overlap, token_spans))]
            yield pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows, strict=True) if rows else [()] * len(_CHUNK), _CHUNK.types, strict=True)], schema=_CHUNK)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ord int, text string, line_start int, line_end int")


def windows(text: str, token_spans: Callable[[str], Spans] = word_spans) -> Spans:
    """Windows of 60 tokens every 30; the first begins where the text does, the last ends where it ends; other edges inside a Latin, Greek or Cyrillic word move out by up to 24 characters."""
    spans = token_spans(text)
    if len(spans) <= WINDOW_TOKENS:
        return [(0, len(text))]

    def inside(at: int) -> bool:
        return 0 < at < len(text) and all(c.isalnum() and ord(c) < 0x530 for c in text[at - 1 : at + 1])

    out = []
    for k in range(0, len(spans), WINDOW_STRIDE):
        last = min(k + WINDOW_TOKENS, len(spans)) - 1
        a, b = spans[k][0] if k else 0, spans[last][1] if last < len(spans) - 1 else len(text)
        low, high = max(0, a - WINDOW_REACH), min(len(text), b + WINDOW_REACH)
        while a > low and inside(a):
            a -= 1
        while b < high and inside(b):
            b += 1
        out.append((a, b))
        if last == len(spans) - 1:
            return out
    return out


def text_windows(rows: DataFrame, key: list[str], token_spans: Callable[[str], Spans] = word_spans) -> DataFrame:
    """``key..., win, start, end, text`` for each window of ``text``. Windows are cut out where they are found: a substring in Spark walks to its place from the text's start."""
    given = rows.select(*key, F.coalesce("text", F.lit("")).alias("text"))
    kinds = T.StructType([*given.schema.fields[:-1], *(T.StructField(c, T.IntegerType()) for c in ("win", "start", "end")), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in few_rows(batches):
            *keys, texts = batch.columns
            found = [(row, win, a, b, t[a:b]) for row, t in enumerate(texts.to_pylist()) for win, (a, b) in enumerate(windows(t, token_spans))]
            row, *own = (pa.array(c, kind) for c, kind in zip(zip(*found, strict=True), [pa.int32()] * 4 + [pa.string()], strict=True))
            yield pa.RecordBatch.from_arrays([*(c.take(row) for c in keys), *own], names=[*key, "win", "start", "end", "text"])

    return given.mapInArrow(run, kinds)


def marker_numbers(text: str) -> list[int]:
    return [int(n) for m in MARKER.finditer(text) for n in re.findall(r"\d+", m.group())]


def citation_segments(text: str, count: int) -> list[dict]:
    """Text and citation segments with offsets, a segment for each number of a marker; a marker with a number outside 1..count stays text."""
    out, at = [], 0
    for m in re.finditer(MARKER.pattern, text, re.ASCII):
        numbers = [int(n) for n in re.findall("[0-9]+", m.group())]
        if not all(1 <= n <= count for n in numbers):
            continue
        if m.start() > at:
            out.append({"kind": "text", "start": at, "end": m.start(), "n": None})
        out += [{"kind": "cite", "start": m.start(), "end": m.end(), "n": n} for n in numbers]
        at = m.end()
    if at < len(text):
        out.append({"kind": "text", "start": at, "end": len(text), "n": None})
    return out


def cited_in(content: str, selection: str, start: int | None = None) -> list[int]:
    """Source numbers in the selection and in the sentences that hold it; ``start`` picks the occurrence if the text is there, else the first."""
    numbers = marker_numbers(selection)
    at = start if start is not None and start >= 0 and content.startswith(selection, start) else content.find(selection)
    if at >= 0 and selection:
        ends = [m.end() for m in SENTENCE_END.finditer(content)]
        low = max([0, *(e for e in ends if e <= at)])
        high = min([len(content), *(e for e in ends if e >= at + len(selection))])
        numbers += marker_numbers(content[low:high])
    return sorted(set(numbers))


def take_tokens(text: str, budget: float) -> str:
    """The longest prefix whose cost fits: a third for letters and spaces outside Thai and East Asian ranges, one for others, added up in floats."""
    spent = 0.0
    for k, c in enumerate(text):
        light = (c.isalpha() or c.isspace()) and not (0x0E00 <= ord(c) <= 0x0E7F or 0x3000 <= ord(c) <= 0x9FFF or 0xFF00 <= ord(c) <= 0xFFEF)
        spent += 1 / 3 if light else 1
        if spent > budget:
            return text[:k]
    return text


def normalise_text(text: str, lang: str) -> str:
    """NFKC; single spaces in English, none in Thai and Chinese."""
    return (" " if lang == "en" else "").join(unicodedata.normalize("NFKC", text).split())


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Insertions, deletions and replacements from one to the other; above ``most`` it is most + 1.

    A column of the table is two integers, with a bit per character of the longer text for where it rises and where it falls from one place to the next; a
    step per character of the shorter one leads to the next column (Myers 1999, Hyyrö 2001).
    """
    if len(a) < len(b):
        a, b = b, a
    if not b:
        return len(a) if most is None else min(len(a), most + 1)
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    whole, end, n = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    rises, falls = whole, 0
    for c in b:
        same = at.get(c, 0)
        level = same | falls
        across = (((same & rises) + rises) ^ rises) | same
        up = falls | (whole ^ ((across | rises) & whole))
        down = rises & across
        if up & end:
            n += 1
        elif down & end:
            n -= 1
        up = (up << 1 | 1) & whole
        rises = (down << 1 & whole) | (whole ^ (level | up))
        falls = up & level
    return n if most is None else min(n, most + 1)


def _first_near(h: str, body: str, at: int, last: int, edits: int) -> int | None:
    """The first k in at..last where body[k : k + len(h)] is at most ``edits`` edits from h.

    One of edits + 1 parts of h then stands unchanged in it, at most ``edits`` places off: only places around the parts' occurrences are compared.
    """
    if len(h) <= edits:
        return at
    cuts = [len(h) * n // (edits + 1) for n in range(edits + 2)]
    parts = [(a, h[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
    places = [body.find(part, at) for _, part in parts]
    compared, k = set(), at
    while True:
        starts = [max(k, x - a - edits) for x, (a, _) in zip(places, parts, strict=True) if x >= 0]
        k = min(starts, default=last + 1)
        if k > last:
            return None
        window = body[k : k + len(h)]
        if window not in compared:
            if edit_distance(h, window, edits) <= edits:
                return k
            compared.add(window)
        k += 1
        for n, (a, part) in enumerate(parts):
            if 0 <= places[n] < k + a - edits:
                places[n] = body.find(part, k + a - edits)


def line_recall(truth: str, text: str, lang: str, head: int = 10, edits: int = 2) -> float:
    """Share of the truth's lines whose first ten characters are found in order, with at most two edits."""
    heads = [h for line in truth.split("\n") if (h := normalise_text(line, lang)[:head])]
    body, at, found = normalise_text(text, lang), 0, 0
    for h in heads:
        k = _first_near(h, body, at, max(at, len(body) - len(h) + edits), edits)
        if k is not None:
            found, at = found + 1, k + len(h)
    return found / max(1, len(heads))


def per_row(function: Callable, result: str, *columns: Column) -> Column:
    """A pandas UDF that applies a helper row by row inside Arrow batches."""

    @F.pandas_udf(result)
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series([function(*(None if v is pd.NA else v for v in row)) for row in zip(*series, strict=True)])

    return run(*columns)
