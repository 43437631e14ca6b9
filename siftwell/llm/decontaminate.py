"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of the benchmark items form one automaton. Training words stream through it; at each
word the longest match that ends there is tracked, which tells every benchmark window that ends there.

Items are cut into blocks of a bounded number of words; each block's automaton is broadcast, so what one task
holds stays bounded however many items there are. One pass over the documents is made per block; with one
block (the usual case) documents never move.

Defined results: null texts and items have no words; items without words match nothing; repeated rows are
judged alike, also under null ids; a text of any length streams through word by word; items with equal texts each count; empty tables give empty results or no hits.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import in_tasks, text_bytes, with_length, written

#: Words of lower-cased text, as bytes: ASCII letters and digits and everything beyond ASCII.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WINDOW = 10
#: Most words of items in one automaton: some 100 MB in each Python worker.
BLOCK_WORDS = 200_000


class Automaton:
    """Generalised suffix automaton over lists of word numbers.

    ``length`` and ``link`` are the usual ones. ``items`` has for each state whose strings reach ``window``
    words the items that hold them; ``short`` has for each state the whole short items that end there as
    (words, items), longest first.
    """

    def __init__(self, texts: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        numbered = [(item, [self.words.setdefault(w, len(self.words)) for w in words]) for item, words in texts if words]
        for _, word_ids in numbered:
            last = 0
            for w in word_ids:
                last = self._extend(last, w)
        self.items: list[tuple[str, ...]] = [()] * len(self.link)
        ends: dict[int, dict[int, set[str]]] = {}
        held: list[set[str]] = [set() for _ in self.link]
        for item, word_ids in numbered:
            state = 0
            for w in word_ids:
                state = self.next[state][w]
                up = state
                while self.length[up] >= window and item not in held[up]:
                    held[up].add(item)
                    up = self.link[up]
            if len(word_ids) < window:
                ends.setdefault(state, {}).setdefault(len(word_ids), set()).add(item)
        self.items = [tuple(sorted(x)) for x in held]
        self.short: list[tuple[tuple[int, tuple[str, ...]], ...]] = [()] * len(self.link)
        for state in sorted(range(1, len(self.link)), key=self.length.__getitem__):
            own = tuple((n, tuple(sorted(x))) for n, x in sorted(ends.get(state, {}).items(), reverse=True))
            self.short[state] = own + self.short[self.link[state]]

    @staticmethod
    def of(parts: dict) -> Automaton:
        """The automaton that has ``vars`` as ``parts``: broadcasts carry these plain values, so that executors need no copy of the package."""
        out = Automaton.__new__(Automaton)
        vars(out).update(parts)
        return out

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """State for p's string + w, taken out of q, whose longest string is longer."""
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        new, p = self._new(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return new

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Merged [start, end) word spans inside benchmark windows, and the items whose windows occur."""
        get, edges, link, length, items, short, window = self.words.get, self.next, self.link, self.length, self.items, self.short, self.window
        spans: list[tuple[int, int]] = []
        found: set[str] = set()
        state = matched = 0
        for end, w in enumerate(map(get, words), 1):
            if w is None:
                state = matched = 0
                continue
            while state and w not in edges[state]:
                state = link[state]
                matched = length[state]
            state = edges[state].get(w, 0)
            matched = matched + 1 if state else 0
            covered = 0
            if matched >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                found.update(items[at])
                covered = window
            for n, whole in short[state]:
                if n <= matched:
                    found.update(whole)
                    covered = max(covered, n)
            if covered:
                start = end - covered
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append((start, end))
        return spans, found


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> list[Callable[[], list[tuple[str, list[bytes]]]]]:
    """Functions that each read one block of items, of about ``block_words`` words at most, as (id, words)."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))
    total = rows.agg(F.sum(F.length("text") / 2 + 1)).first()[0] or 0  # a word and its gap take two characters at least
    blocks = int(total // block_words) + 1

    def read(k: int) -> list[tuple[str, list[bytes]]]:
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        return [(r["item_id"], WORD.findall(r["text"].encode().lower())) for r in part.collect()]

    return [partial(read, k) for k in range(blocks)]


_SCHEMA = "n_words long, spans array<struct<start:int,stop:int>>, items array<string>"
_ARROW = pa.schema([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string()))])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _matched(docs: DataFrame, automaton: Automaton) -> DataFrame:
    """``docs`` (doc_id of any kind, text) streamed through one automaton."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(automaton))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Automaton.of(shared.value).hits
        for batch in batches:
            words = [WORD.findall((t or b"").lower()) for t in text_bytes(batch)]
            found = [hits(w) for w in words]
            spans = pa.array([[{"start": a, "stop": b} for a, b in s] for s, _ in found], _ARROW.field("spans").type)
            items = pa.array([sorted(x) for _, x in found], _ARROW.field("items").type)
            yield pa.record_batch([batch.column(0), pa.array(map(len, words), pa.int64()), spans, items], names=["doc_id", *_ARROW.names])

    return docs.select("doc_id", "text").transform(in_tasks, match, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {_SCHEMA}")


def _hit(by_row: DataFrame, blocks: list[Callable], window: int) -> DataFrame:
    """``_row, spans, items`` of the rows (row number as doc_id, text) that items hit: each block's hits on the whole texts, put together."""
    hit = None
    for block in blocks:
        found = written(_matched(by_row, Automaton(block(), window)).where(F.size("items") > 0), "decontaminate")
        hit = found if hit is None else hit.unionByName(found)
    return hit.groupBy(F.col("doc_id").alias("_row")).agg(F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items"))


_NOTHING = "cast(array() as array<struct<start:int,stop:int>>)"
#: Spans by start: one that begins inside the last of those before it makes that one longer.
_JOINED = f"""aggregate(array_sort(spans), {_NOTHING}, (done, s) -> case
    when size(done) > 0 and s.start <= element_at(done, -1).stop
    then concat(slice(done, 1, size(done) - 1), array(named_struct('start', element_at(done, -1).start, 'stop', greatest(element_at(done, -1).stop, s.stop))))
    else concat(done, array(named_struct('start', s.start, 'stop', s.stop))) end)"""
_HIT_WORDS = "cast(aggregate({}, 0, (n, s) -> n + s.stop - s.start) as long)"


def covered(docs: DataFrame, items: DataFrame, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, h`` (md5 of the text) of the rows of ``docs`` of which more than ``max_coverage`` of the words are hit.

    Documents are streamed once per block of items; only covered rows leave the tasks.
    """
    keyed = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.md5("text").alias("h")).alias("doc_id"), "text")
    found = None
    blocks = item_blocks(items, block_words)
    for block in blocks:
        part = _matched(keyed, Automaton(block())).where(F.size("spans") > 0).select("doc_id", "n_words", "spans")
        part = part if len(blocks) == 1 else written(part, "decontaminate")
        found = part if found is None else found.unionByName(part)
    if len(blocks) > 1:
        found = found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("spans")).withColumn("spans", F.expr(_JOINED))
    return found.where(F.expr(_HIT_WORDS.format("spans")) > max_coverage * F.col("n_words")).select("doc_id.doc_id", "doc_id.h").distinct()


def matches(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per row of ``docs``: word count, hit spans (merged) and the items whose windows occur.

    With one block of items the documents are read once and nothing is shuffled. With more, rows get a
    number, each block's hits are found in a pass of its own, and the hits are joined to the rows.
    """
    docs = docs.selectExpr("cast(doc_id as long) doc_id", "text")
    blocks = item_blocks(items, block_words)
    if len(blocks) == 1:
        return _matched(docs, Automaton(blocks[0](), window))
    numbered = written(docs.withColumn("_row", F.monotonically_increasing_id()), "decontaminate")
    by_row = numbered.selectExpr("_row doc_id", "text")
    hit = _hit(by_row, blocks, window)
    words = _matched(by_row, Automaton([], window)).selectExpr("doc_id _row", "n_words")
    return (
        numbered.select("_row", "doc_id")
        .join(words, "_row")
        .join(hit, "_row", "left")
        .select("doc_id", "n_words", F.coalesce(F.expr(_JOINED), F.expr(_NOTHING)).alias("spans"), F.coalesce(F.array_sort(F.array_distinct("items")), F.array().cast("array<string>")).alias("items"))
    )


def digest(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The contract's columns from ``matches``."""
    return matches(docs, items).select(
        "doc_id",
        "n_words",
        F.expr(_HIT_WORDS.format("spans")).alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def cleaned(docs: DataFrame, items: DataFrame, min_words: int = 1, max_coverage: float = 0.5, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``docs`` with hit spans of ``min_words`` words or more cut from the texts; all columns stay.

    A document of which more than ``max_coverage`` of the words are hit goes. ``n_chars``, where there is
    such a column, follows the new text. With several blocks of items, the hits of all are found on the uncut texts and
    joined to the rows before anything is cut, so that rows don't depend on the number of blocks.
    """
    blocks = item_blocks(items, block_words)
    if len(blocks) == 1:
        return with_length(_cut(docs, docs.schema, docs.sparkSession.sparkContext.broadcast(vars(Automaton(blocks[0]()))), min_words, max_coverage))
    numbered = written(docs.withColumn("_cut_row", F.monotonically_increasing_id()), "decontaminate")
    hit = _hit(numbered.selectExpr("_cut_row doc_id", "text"), blocks, WINDOW).selectExpr("_row _cut_row", "spans _cut_spans")
    return with_length(_cut(numbered.join(hit, "_cut_row", "left").drop("_cut_row"), docs.schema, None, min_words, max_coverage))


def _cut(docs: DataFrame, schema: StructType, shared, min_words: int, max_coverage: float) -> DataFrame:
    """``docs`` cut to ``schema``; spans come from the ``shared`` automaton, or without one from the last column."""
    at = schema.fieldNames().index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Automaton.of(shared.value).hits if shared else None
        for batch in batches:
            known = None if shared else batch.column(batch.num_columns - 1).to_pylist()
            texts, keep = [], []
            for k, t in enumerate(text_bytes(batch)):
                low = (t or b"").lower()
                places = [m.span() for m in WORD.finditer(low)]
                spans = hits([low[a:b] for a, b in places])[0] if shared else merged([(s["start"], s["stop"]) for s in known[k] or []])
                spans = [s for s in spans if s[1] - s[0] >= min_words]
                keep.append(sum(b - a for a, b in spans) <= max_coverage * len(places))
                for a, b in reversed(spans):
                    t = t[: places[a][0]] + t[places[b - 1][1] :]
                texts.append(t)
            columns = batch.columns if shared else batch.columns[:-1]
            columns[at] = pa.array(texts, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.record_batch(columns, names=batch.schema.names[: len(columns)]).filter(pa.array(keep, pa.bool_()))

    return docs.transform(in_tasks, cut, schema)
