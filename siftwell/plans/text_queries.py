"""Registered queries of text functions, passages, attribution, evaluation and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribution as A
from ..operators import chats as C
from ..operators import evaluate as E
from ..operators import locate as L
from ..operators import passages as P
from ..operators import search as S
from ..streaming import watch as W
from . import chat_queries, inputs
from .search_queries import _DENSE, _PARTS, _sql


def _docs(s: SparkSession, d: str) -> DataFrame:
    return inputs.table(s, d, "documents")


def detect_language(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.detect_language(F.col("text")).alias("language"))


def estimate_tokens(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


TAILS = ("", ":56", ".50", ".5.6", ",7")


def numbers(s: SparkSession, d: str) -> DataFrame:
    """Of each text and a number in thousands behind it, with and without what follows."""
    more = F.concat(F.lit(" "), F.col("doc_id") % 9 + 1, F.lit(","), F.lpad((F.col("doc_id") % 1000).cast("string"), 3, "0"), F.element_at(F.array(*map(F.lit, TAILS)), (F.col("doc_id") % len(TAILS) + 1).cast("int")))
    return _docs(s, d).select("doc_id", F.array_join(F.array_sort(T.numbers(F.concat("text", more))), " ").alias("numbers"))


def _marked(s: SparkSession, d: str) -> DataFrame:
    m = inputs.messages(s, d)
    return m.withColumn("content", F.concat("content", F.lit(" ["), F.col("id").cast("string"), F.lit("] x [1, 9]  y ["), F.col("chat_id") % 5, F.lit("]")))


def cited_numbers(s: SparkSession, d: str) -> DataFrame:
    return _marked(s, d).select("chat_id", "id", F.array_join(T.cited_numbers(F.col("content"), F.lit(3)).cast("array<string>"), ",").alias("numbers"))


def strip_markers(s: SparkSession, d: str) -> DataFrame:
    return _marked(s, d).select("chat_id", "id", F.md5(T.strip_markers(F.col("content"))).alias("stripped_md5"))


def trigram_overlap(s: SparkSession, d: str) -> DataFrame:
    hits = S.dense_topk(inputs.questions(s, d).where("query_vector is not null"), inputs.vectors(s, d)).select("query_id", "chunk_id")
    both = hits.join(inputs.questions(s, d).select("query_id", "query_text"), "query_id").join(inputs.chunks(s, d), "chunk_id")
    return both.select("query_id", "chunk_id", F.round(T.trigram_overlap(T.trigrams(F.col("query_text")), T.trigrams(F.col("text"))), 6).alias("overlap"))


def _shared_words():
    """A scorer: shared words of all words of both."""

    def score(queries: list[str], texts: list[str]) -> list[float]:
        pairs = [(set(q.lower().split()), set(t.lower().split())) for q, t in zip(queries, texts, strict=True)]
        return [len(a & b) / max(1, len(a | b)) for a, b in pairs]

    return score


def pair_scorer(s: SparkSession, d: str) -> DataFrame:
    hits = S.dense_topk(inputs.questions(s, d).where("query_vector is not null"), inputs.vectors(s, d)).select("query_id", "chunk_id")
    both = hits.join(inputs.questions(s, d).select("query_id", "query_text"), "query_id").join(inputs.chunks(s, d), "chunk_id")
    return A.pair_scores(both, _shared_words).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def _cited_docs(s: SparkSession, d: str, text: Column | str = "text") -> DataFrame:
    """Answers with two source documents each, or with a part of their texts."""
    docs = _docs(s, d).select("doc_id", (F.col(text) if isinstance(text, str) else text).alias("text"))
    return chat_queries._sources(s, d).join(docs, "doc_id").select(F.concat_ws("-", "chat_id", "id").alias("answer_id"), F.col("n"), "text", "chat_id", "id")


def auto_citation(s: SparkSession, d: str) -> DataFrame:
    """Answers, some with a marker of a source that they have or don't have."""
    marked = F.concat("content", F.when(F.col("chat_id") % 5 == 0, " [1]").when(F.col("chat_id") % 3 == 0, " [9]").otherwise(""))
    answers = inputs.messages(s, d).where("role = 'assistant'").select(F.concat_ws("-", "chat_id", "id").alias("answer_id"), marked.alias("content"))
    return A.auto_citation(answers, _cited_docs(s, d).select("answer_id", "n", "text"))


def _locations(s: SparkSession, d: str) -> DataFrame:
    page, line = "cast(doc_id % 9 + 1 as int)", "cast(doc_id % 4 as int)"
    return _docs(s, d).selectExpr(
        "doc_id", "source", "text",
        f"cast(named_struct('kind', element_at(array('pdf','docx','text','notes'), cast(doc_id % 4 + 1 as int)), 'page_start', {page}, 'char_start', 0, 'page_end', cast({page} + doc_id % 8 div 4 as int), 'char_end', 9, 'ocr', doc_id % 3 = 0,"
        f" 'heading_path', if(doc_id % 5 = 0, array(), array('A', lang)), 'paragraph_start', {page}, 'paragraph_end', cast({page} + doc_id % 8 div 4 as int), 'line_start', {page}, 'line_end', cast({page} + doc_id % 8 div 4 as int)) as {T.LOCATION}) location",
    )


def location_label(s: SparkSession, d: str) -> DataFrame:
    return _locations(s, d).select("doc_id", T.location_label(F.col("location")).alias("label"))


def location_json(s: SparkSession, d: str) -> DataFrame:
    """To JSON and back: the label of what comes back is the label of what went in."""
    back = _locations(s, d).select("doc_id", F.from_json(F.to_json("location"), T.LOCATION).alias("location"))
    return back.select("doc_id", T.location_label(F.col("location")).alias("label"))


def source_payload(s: SparkSession, d: str) -> DataFrame:
    """Answers' sources with project, file, label, text length."""
    sources = chat_queries._sources(s, d).join(_locations(s, d), "doc_id")
    return sources.select("chat_id", "id", F.struct("n", F.col("source").alias("project"), F.col("doc_id").alias("file_id"), T.location_label(F.col("location")).alias("label"), F.length("text").alias("chars")).alias("p")).select("chat_id", "id", "p.*")


def garbled_thai(s: SparkSession, d: str) -> DataFrame:
    return _docs(s, d).select("doc_id", T.garbled_thai(F.col("text")).cast("long").alias("echoes"))


def text_units(s: SparkSession, d: str) -> DataFrame:
    cut = P.per_row(lambda t: [{"text": x, "line": n} for x, n in P.text_units(t or "")], "array<struct<text:string,line:int>>", F.col("text"))
    return _docs(s, d).select("doc_id", F.explode(cut).alias("u")).select("doc_id", F.col("u.line").alias("line"), F.length("u.text").cast("long").alias("chars"))


def _pairs(s: SparkSession, d: str) -> DataFrame:
    t = C.turns(inputs.messages(s, d)).where("answer is not null")
    return t.select(F.concat_ws("-", "chat_id", "turn").alias("pair_id"), F.col("question").alias("truth"), F.col("answer").alias("text"), F.element_at(F.array(F.lit("en"), F.lit("th")), (F.col("chat_id") % 2 + 1).cast("int")).alias("lang"))


def word_hit(s: SparkSession, d: str) -> DataFrame:
    return E.word_hit(_pairs(s, d)).select("pair_id", F.round("word_hit", 6).alias("word_hit"))


def cer(s: SparkSession, d: str) -> DataFrame:
    return E.cer(_pairs(s, d)).select("pair_id", F.round("cer", 6).alias("cer"))


def normalise_text(s: SparkSession, d: str) -> DataFrame:
    return _pairs(s, d).select("pair_id", P.per_row(lambda t, g: P.normalise_text(t or "", g), "string", F.col("truth"), F.col("lang")).alias("text"))


def line_recall(s: SparkSession, d: str) -> DataFrame:
    return E.line_recall(_pairs(s, d))


def ocr_quality(s: SparkSession, d: str) -> DataFrame:
    return E.ocr_quality(E.text_scores(_pairs(s, d)))


def numbered_text(s: SparkSession, d: str) -> DataFrame:
    lines = _docs(s, d).select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "text")).withColumn("line", F.col("line") + 1)
    return E.numbered_text(lines).select("doc_id", "line", F.length("text").alias("chars"), "truncated")


def reading_order(s: SparkSession, d: str) -> DataFrame:
    boxes = _docs(s, d).selectExpr("doc_id page_id", "explode(sequence(0, 7)) box_id").selectExpr("page_id", "box_id", "cast((page_id * 37 + box_id * 53) % 100 as double) x", "cast((page_id * 17 + box_id * 29) % 90 as double) y")
    return E.reading_order(boxes).select("page_id", "box_id", "line", "place")


def ocr_rects(s: SparkSession, d: str) -> DataFrame:
    pages = _docs(s, d).select(F.col("doc_id").alias("page_id"), "text").withColumn("at", F.sequence(F.lit(0), F.length("text") - 1)).where(F.length("text") > 0)
    boxes = F.transform("at", lambda i: F.struct((i % 70 * 5).cast("double").alias("x0"), (F.floor(i / 70) * 12).cast("double").alias("y0"), (i % 70 * 5 + F.when(i % 11 == 0, 0).otherwise(4)).cast("double").alias("x1"), (F.floor(i / 70) * 12 + 10).cast("double").alias("y1")))
    return E.ocr_rects(pages.select("page_id", "text", boxes.alias("boxes")))


def hit_rates(s: SparkSession, d: str) -> DataFrame:
    return E.hit_rates(_docs(s, d).selectExpr("lang", "nullif(cast(doc_id % 13 as int), 0) rank"))


def threshold_sweep(s: SparkSession, d: str) -> DataFrame:
    labels = inputs.table(s, d, "labels")
    return E.threshold_sweep(labels.selectExpr("quality = 1 answerable", "(doc_id * 37 % 60 + quality * 25) / 100.0D best_similarity"))


def attribution_summary(s: SparkSession, d: str) -> DataFrame:
    kinds = "array('strong','partial','none')"
    cases = _docs(s, d).selectExpr("source `group`", "doc_id id", f"element_at({kinds}, cast(doc_id % 3 + 1 as int)) expect", "if(doc_id % 3 = 2, null, doc_id % 4) expect_n", f"element_at({kinds}, cast(doc_id % 7 % 3 + 1 as int)) label", "if(doc_id % 7 % 3 = 2, null, doc_id % 5 % 4) n")
    out = E.attribution_summary(cases)
    lists = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("false_matches", "wrong_sources", "strong_on_wrong")]
    return out.select("group", "cases", *(F.round(c, 6).alias(c) for c in ("n_accuracy", "label_accuracy", "rejection_rate")), *lists)


def chunk_documents(s: SparkSession, d: str) -> DataFrame:
    return P.chunk_documents(_docs(s, d))


def token_spans(s: SparkSession, d: str) -> DataFrame:
    """The chunks that another tokenizer (characters) gives."""
    return P.chunk_documents(_docs(s, d), token_spans=P.char_spans)


def text_windows(s: SparkSession, d: str) -> DataFrame:
    return P.text_windows(_docs(s, d).select("doc_id", "text"), ["doc_id"]).select("doc_id", "win", "start", "end")


def _windows(s: SparkSession, d: str) -> DataFrame:
    sources = _cited_docs(s, d)
    return A.windows_of(sources.select(F.col("answer_id").alias("message_id"), "n", "text"))


def known_numbers(s: SparkSession, d: str) -> DataFrame:
    return A.known_numbers(_selections(s, d), _windows(s, d)).select("selection_id", F.array_join("known", " ").alias("known"))


def _selections(s: SparkSession, d: str) -> DataFrame:
    """A sentence of each answer's second source, asked for in the answer."""
    sentence = F.split("text", r"(?<=[.])\s", 2)[0]  # taken from a document before it is joined, so that whole texts stay where they are
    picked = _cited_docs(s, d, sentence).where("n = 2").select("answer_id", "chat_id", "id", F.col("text").alias("selection"))
    content = F.concat("selection", F.lit(" [2]."))
    return picked.select(F.col("answer_id").alias("selection_id"), F.col("answer_id").alias("message_id"), content.alias("content"), "selection", F.when((F.col("chat_id") + F.col("id")) % 4 == 0, F.lit(2)).alias("only"))


def attribute(s: SparkSession, d: str) -> DataFrame:
    return A.attribute(_selections(s, d), _windows(s, d))


def cited_in(s: SparkSession, d: str) -> DataFrame:
    m = _marked(s, d)
    return m.select("chat_id", "id", P.per_row(lambda c: ",".join(map(str, P.cited_in(c or "", (c or "")[:20]))), "string", F.col("content")).alias("cited"))


def citation_segments(s: SparkSession, d: str) -> DataFrame:
    cut = P.per_row(lambda c: P.citation_segments(c or "", 4), "array<struct<kind:string,start:int,end:int,n:int>>", F.col("content"))
    return _marked(s, d).select("chat_id", "id", F.posexplode(cut).alias("k", "g")).select("chat_id", "id", "k", "g.kind", "g.start", "g.end", "g.n")


def take_tokens(s: SparkSession, d: str) -> DataFrame:
    return inputs.messages(s, d).select("chat_id", "id", P.per_row(lambda c: len(P.take_tokens(c or "", 50)), "int", F.col("content")).alias("chars"))


def locate_passage(s: SparkSession, d: str) -> DataFrame:
    """A line of each document, shouted and spaced out, looked for in the document; every other one with a hint of its line."""
    docs = _docs(s, d)
    lines = docs.withColumn("lines", F.split("text", "\n")).withColumn("n", (F.col("doc_id") % F.size("lines")).cast("int"))
    hint = F.when(F.col("doc_id") % 2 == 1, F.struct(F.lit("text").alias("kind"), *(F.lit(None).cast("int").alias(c) for c in ("page_start", "page_end", "paragraph_start", "paragraph_end")), (F.col("n") + 1).alias("line_start"), (F.col("n") + 1).alias("line_end")))
    passage = F.replace(F.upper(F.col("lines")[F.col("n")]), F.lit(" "), F.lit("  "))
    return L.locate_passages(lines.select(F.col("doc_id").alias("passage_id"), "doc_id", passage.alias("passage"), hint.alias("hint")), docs).drop("page")


def find_within(s: SparkSession, d: str) -> DataFrame:
    """On a page that is the document: the overlapping places of a part."""
    return _docs(s, d).select("doc_id", P.per_row(lambda t: len(L.find_within([L.Unit(t or "", 0, 1)], 1, 0, len(t or ""), " E \n E ")), "int", F.col("text")).alias("occurrences"))


def embed(s: SparkSession, d: str) -> DataFrame:
    docs = _docs(s, d)
    return docs.select("doc_id", A.embed(docs).alias("v")).select("doc_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x), 4).alias("norm"))


def _events(s: SparkSession, d: str) -> DataFrame:
    kinds = "element_at(map('signup','created','click','modified','view','opened','purchase','moved','error','deleted'), event_type)"
    return inputs.table(s, d, "events").selectExpr(
        "event_id", "ts", "user_id project", f"{kinds} event_type", "event_id % 5 = 0 is_directory", "concat('d/', if(event_id % 7 = 0, '~$', ''), 'f', event_id % 20, '.txt') src_path", "if(event_id % 3 = 0, concat('e/', if(event_id % 2 = 0, '~$', ''), 'g.txt'), null) dest_path",
        "cast(event_id % 4 as int) generation",
    )


def filter_events(s: SparkSession, d: str) -> DataFrame:
    return W.filter_events(_events(s, d)).select("event_id")


def watch_debounce(s: SparkSession, d: str) -> DataFrame:
    """Over the hour-long gaps of the given events: quiet for an hour."""
    return W.watch_debounce(_events(s, d), "1 hour")


def late_events(s: SparkSession, d: str) -> DataFrame:
    watches = _events(s, d).groupBy("project").agg(F.max("generation").alias("generation"))
    return W.late_events(_events(s, d), watches).select("event_id")


def watch_notices(s: SparkSession, d: str) -> DataFrame:
    """Four watches of each project, one after the other over a quarter of its time each; quiet for an hour."""
    events = _events(s, d).withColumn("ts", F.col("ts").cast("timestamp"))
    time = events.groupBy("project").agg(F.unix_micros(F.min("ts")).alias("a"), F.unix_micros(F.max("ts")).alias("b"))
    watches = time.select("project", "a", "b", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("generation")).selectExpr("project", "generation", "timestamp_micros(a + (b - a) div 4 * generation) ts")
    return W.watch_notices(events, watches, "1 hour").withColumn("notice", F.col("notice").cast("timestamp_ntz"))


QUERIES = {f.__name__: f for f in (watch_notices, detect_language, estimate_tokens, numbers, cited_numbers, strip_markers, trigram_overlap, pair_scorer, auto_citation, location_label, location_json, source_payload, garbled_thai, text_units, word_hit, cer, normalise_text, line_recall, ocr_quality, numbered_text, reading_order, ocr_rects, hit_rates, threshold_sweep, attribution_summary, chunk_documents, token_spans, text_windows, known_numbers, attribute, cited_in, citation_segments, take_tokens, locate_passage, find_within, embed, filter_events, watch_debounce, late_events)}

_MARKED = f"{chat_queries._M}, marked AS (SELECT chat_id, id, content || ' [' || id || '] x [1, 9]  y [' || chat_id % 5 || ']' AS content FROM m)"
_LABELS = """loc AS (SELECT *, doc_id % 9 + 1 AS a, doc_id % 9 + 1 + (doc_id % 8) // 4 AS b FROM documents), labels_ AS (SELECT doc_id, source, text, CASE doc_id % 4
    WHEN 0 THEN CASE WHEN a = b THEN 'p. ' || a ELSE 'pp. ' || a || '-' || b END || CASE WHEN doc_id % 3 = 0 THEN ' · OCR' ELSE '' END
    WHEN 1 THEN CASE WHEN doc_id % 5 = 0 THEN '' ELSE 'A > ' || lang || ', ' END || CASE WHEN a = b THEN 'para. ' || a + 1 ELSE 'paras. ' || a + 1 || '-' || b + 1 END
    WHEN 2 THEN CASE WHEN a = b THEN 'line ' || a ELSE 'lines ' || a || '-' || b END ELSE 'notes' END AS label FROM loc)"""
_SOURCES = "sources AS (SELECT chat_id, id, n, (chat_id * 7919 + id * 104729 + n) % (SELECT max(doc_id) + 1 FROM documents) AS doc_id FROM m, (SELECT unnest([1, 2]) AS n) WHERE role = 'assistant' AND id % 4 <> 3)"
_PAIRS = "pairs AS (SELECT chat_id || '-' || turn AS pair_id, question AS truth, answer AS text FROM turns WHERE answer IS NOT NULL)"
_OVERLAP = _sql(
    """SELECT query_id, chunk_id, round(count(g.term) / greatest(1, max(nq)), 6) AS overlap FROM dense JOIN (SELECT query_id, term, count(*) OVER (PARTITION BY query_id) AS nq FROM allterms) q USING (query_id)
       LEFT JOIN (SELECT DISTINCT chunk_id, term FROM grams) g USING (chunk_id, term) GROUP BY query_id, chunk_id""", *_DENSE, "grams").replace("WITH ", "WITH allterms AS (" + _PARTS["terms"].replace(" WHERE r <= 64", "").replace("FROM questions", "FROM (" + _PARTS["questions"] + ")") + "),\n", 1)
_EVENTS = """ev AS (SELECT event_id, ts, user_id AS project, CASE event_type WHEN 'signup' THEN 'created' WHEN 'click' THEN 'modified' WHEN 'view' THEN 'opened' WHEN 'purchase' THEN 'moved' WHEN 'error' THEN 'deleted' END AS kind FROM events)"""
#: From found (doc_id, x) to listed (doc_id, numbers).
_NUMBERS = """plain AS (SELECT doc_id, unnest(string_split(CASE WHEN regexp_full_match(x, '[0-9]{1,3}(,[0-9]{3})+([.][0-9]+)?') THEN replace(x, ',', '') ELSE x END, ',')) AS x FROM found),
        heads AS (SELECT doc_id, regexp_replace(replace(x, ':', '.'), '^0+([0-9])', '\\1') AS x FROM plain),
        kept AS (SELECT DISTINCT doc_id, CASE WHEN regexp_matches(x, '^[0-9]+[.][0-9]+$') THEN regexp_replace(regexp_replace(x, '0+$', ''), '[.]$', '') ELSE x END AS x FROM heads),
        listed AS (SELECT doc_id, array_to_string(list_sort(list(x)), ' ') AS numbers FROM kept GROUP BY doc_id)"""
_TAILED = f"text || ' ' || doc_id % 9 + 1 || ',' || lpad(CAST(doc_id % 1000 AS VARCHAR), 3, '0') || ({list(TAILS)})[doc_id % {len(TAILS)} + 1]"
_SPANS = """tok AS (SELECT doc_id, i, t, sum(length(t)) OVER (PARTITION BY doc_id ORDER BY i) - length(t) AS a FROM (SELECT doc_id, unnest(range(1, len(x) + 1)) AS i, unnest(x) AS t FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t-\\r]+|[ \\t-\\r]+') AS x FROM documents))),
        w AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k, count(*) OVER (PARTITION BY doc_id) AS n, a, a + length(t) AS b FROM tok WHERE NOT regexp_matches(t, '^[ \\t-\\r]'))"""
#: DuckDB counts bytes: letters of two bytes and what stands for them.
_WIDE = "äçèéêíñóöüßÄÇÈÉÊÍÑÓÖÜàâ"
_NARROW = "".join(map(chr, [*range(1, 9), *range(14, 29)]))
_FINE = """pairs_ AS (SELECT pair_id, CAST(split_part(pair_id, '-', 1) AS BIGINT) % 2 = 0 AS spaced, regexp_extract_all(nfc_normalize(truth), '\\S+') AS a, regexp_extract_all(nfc_normalize(text), '\\S+') AS b FROM pairs),
        fine AS (SELECT pair_id, coalesce(CASE WHEN spaced THEN array_to_string(a, ' ') ELSE array_to_string(a, '') END, '') AS a, coalesce(CASE WHEN spaced THEN array_to_string(b, ' ') ELSE array_to_string(b, '') END, '') AS b FROM pairs_)"""
ORACLE_SQL = {
    "detect_language": """SELECT doc_id, CASE WHEN zh > 0 AND zh >= th AND zh >= en THEN 'zh' WHEN th > 0 AND th >= en THEN 'th' ELSE 'en' END AS language FROM (SELECT doc_id, len(regexp_extract_all(text, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]')) AS zh,
        len(regexp_extract_all(text, '[\\x{0E00}-\\x{0E7F}]')) AS th, len(regexp_extract_all(text, '[A-Za-z]+')) AS en FROM documents)""",
    "estimate_tokens": f"SELECT doc_id, {chat_queries._cost('text')} AS tokens FROM documents",
    "cited_numbers": f"WITH {_MARKED} SELECT chat_id, id, concat_ws(',', CASE WHEN id BETWEEN 1 AND 3 THEN id END, 1, CASE WHEN chat_id % 5 BETWEEN 1 AND 3 THEN chat_id % 5 END) AS numbers FROM m",
    "strip_markers": f"WITH {_MARKED} SELECT chat_id, id, md5({chat_queries._LINE.format('content')} || ' x y') AS stripped_md5 FROM m",
    "trigram_overlap": _OVERLAP,
    "pair_scorer": _sql("""SELECT query_id, chunk_id, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 6) AS score FROM
        (SELECT query_id, chunk_id, list_distinct(regexp_extract_all(lower(q.text), '[^ \\t-\\r]+')) AS a, list_distinct(regexp_extract_all(lower(c.text), '[^ \\t-\\r]+')) AS b FROM dense JOIN questions q USING (query_id) JOIN chunks c USING (chunk_id))""", *_DENSE, "chunks"),
    "auto_citation": _sql("""SELECT chat_id || '-' || id AS answer_id, CAST(n AS INTEGER) AS n FROM (SELECT * FROM m WHERE role = 'assistant') LEFT JOIN (
        SELECT chat_id, id, arg_max(n, share * 10 - n / 1000.0) AS n FROM (SELECT s.chat_id, s.id, s.n, count(g.term) / max(a.total) AS share FROM sources s JOIN agrams a USING (chat_id, id) LEFT JOIN dgrams g ON g.chunk_id = s.doc_id AND g.term = a.term GROUP BY s.chat_id, s.id, s.n)
        WHERE share >= 0.5 AND chat_id % 5 <> 0 GROUP BY chat_id, id) USING (chat_id, id)""", "grams").replace("WITH ", f"WITH {chat_queries._M}, {_SOURCES}, ", 1).replace(
        "\nSELECT chat_id || '-'", """, dgrams AS (SELECT DISTINCT chunk_id, term FROM grams), agrams AS (SELECT chat_id, id, term, count(*) OVER (PARTITION BY chat_id, id) AS total FROM (SELECT DISTINCT chat_id, id, substr(w, i, 3) AS term FROM (
        SELECT chat_id, id, w, unnest(range(1, length(w) - 1)) AS i FROM (SELECT chat_id, id, unnest(regexp_extract_all(lower(content), '[\\p{L}\\p{N}\\x{0E00}-\\x{0E7F}]+')) AS w FROM m WHERE role = 'assistant') WHERE length(w) >= 3)))\nSELECT chat_id || '-'""", 1),
    "location_label": f"WITH {_LABELS} SELECT doc_id, label FROM labels_",
    "location_json": f"WITH {_LABELS} SELECT doc_id, label FROM labels_",
    "source_payload": f"WITH {chat_queries._M}, {_SOURCES}, {_LABELS} SELECT chat_id, id, n, source AS project, doc_id AS file_id, label, length(text) AS chars FROM sources JOIN labels_ USING (doc_id)",
    "text_units": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents), g AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS island FROM l WHERE trim(x, chr(32) || chr(9) || chr(13)) <> '')
        SELECT doc_id, CAST(min(n) AS INTEGER) AS line, CAST(sum(length(x) + 1) - 1 AS BIGINT) AS chars FROM g GROUP BY doc_id, island""",
    "word_hit": f"""WITH {chat_queries._M}, {chat_queries._TURNS}, {_PAIRS}, t AS (SELECT pair_id, w, count(*) AS a FROM (SELECT pair_id, unnest(regexp_extract_all(lower(truth), '\\S+')) AS w FROM pairs) GROUP BY ALL), x AS (SELECT pair_id, w, count(*) AS b FROM (SELECT pair_id, unnest(regexp_extract_all(lower(text), '\\S+')) AS w FROM pairs) GROUP BY ALL)
        SELECT pair_id, round(sum(least(a, coalesce(b, 0))) / sum(a), 6) AS word_hit FROM t LEFT JOIN x USING (pair_id, w) GROUP BY pair_id""",
    "normalise_text": f"""WITH {chat_queries._M}, {chat_queries._TURNS}, {_PAIRS}, w AS (SELECT pair_id, CAST(split_part(pair_id, '-', 1) AS BIGINT) % 2 = 0 AS spaced, regexp_extract_all(nfc_normalize(truth), '\\S+') AS words FROM pairs)
        SELECT pair_id, coalesce(CASE WHEN spaced THEN array_to_string(words, ' ') ELSE array_to_string(words, '') END, '') AS text FROM w""",
    "numbers": f"""WITH found AS (SELECT doc_id, unnest(regexp_extract_all({_TAILED}, '[0-9]+(?:[.,:][0-9]+)*')) AS x FROM documents), {_NUMBERS}
        SELECT doc_id, CASE WHEN text IS NOT NULL THEN coalesce(numbers, '') END AS numbers FROM documents LEFT JOIN listed USING (doc_id)""",
    "numbered_text": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line, len(string_split(text, chr(10))) AS last FROM documents),
        f AS (SELECT *, sum(length(x) + 1) OVER (PARTITION BY doc_id ORDER BY line) AS total FROM l QUALIFY line <= 100000 AND total <= 5000000) SELECT doc_id, CAST(line AS INTEGER) AS line, length(x) AS chars, max(line) OVER (PARTITION BY doc_id) < last AS truncated FROM f""",
    "reading_order": """WITH b AS (SELECT doc_id AS page_id, k AS box_id, (doc_id * 37 + k * 53) % 100 AS x, (doc_id * 17 + k * 29) % 90 AS y FROM documents, (SELECT unnest(range(0, 8)) AS k)), f AS (SELECT *, CASE WHEN y - lag(y) OVER (PARTITION BY page_id ORDER BY y, x, box_id) >= 10 THEN 1 ELSE 0 END AS new FROM b),
        l AS (SELECT *, sum(new) OVER (PARTITION BY page_id ORDER BY y, x, box_id) AS line FROM f) SELECT page_id, box_id, line, row_number() OVER (PARTITION BY page_id ORDER BY line, x, box_id) AS place FROM l""",
    "ocr_rects": """WITH c AS (SELECT doc_id AS page_id, unnest(range(0, length(text))) AS i, unnest(string_split(text, '')) AS c FROM documents), l AS (SELECT *, sum(CASE WHEN c = chr(10) THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY i) AS line FROM c)
        SELECT page_id, line, min(i % 70 * 5.0) AS x0, min(i // 70 * 12.0) AS y0, max(i % 70 * 5.0 + 4) AS x1, max(i // 70 * 12.0 + 10) AS y1 FROM l WHERE i % 11 <> 0 GROUP BY page_id, line""",
    "hit_rates": "SELECT lang, count(*) AS n, avg(CASE WHEN doc_id % 13 = 1 THEN 1.0 ELSE 0 END) AS hit_1, avg(CASE WHEN doc_id % 13 BETWEEN 1 AND 4 THEN 1.0 ELSE 0 END) AS hit_4, avg(CASE WHEN doc_id % 13 BETWEEN 1 AND 10 THEN 1.0 ELSE 0 END) AS hit_10 FROM documents GROUP BY GROUPING SETS ((lang), ())",
    "threshold_sweep": """WITH r AS (SELECT quality = 1 AS answerable, doc_id * 37 % 60 + quality * 25 AS s FROM labels), a AS (SELECT t, avg(CASE WHEN (s >= t) = answerable THEN 1.0 ELSE 0 END) AS accuracy FROM r, (SELECT unnest(range(20, 81)) AS t) GROUP BY t), w AS (SELECT accuracy, list(t ORDER BY t) AS ts FROM a WHERE accuracy = (SELECT max(accuracy) FROM a) GROUP BY accuracy)
        SELECT accuracy, ts[1] / 100 AS first, ts[-1] / 100 AS last, ts[len(ts) // 2 + 1] / 100 AS recommended FROM w""",
    "attribution_summary": """WITH c AS (SELECT source AS "group", doc_id AS id, (['strong','partial','none'])[doc_id % 3 + 1] AS expect, CASE WHEN doc_id % 3 <> 2 THEN doc_id % 4 END AS expect_n, (['strong','partial','none'])[doc_id % 7 % 3 + 1] AS label, CASE WHEN doc_id % 7 % 3 <> 2 THEN doc_id % 5 % 4 END AS n FROM documents),
        f AS (SELECT *, expect = 'none' AS none, n IS NOT DISTINCT FROM expect_n AS hit FROM c)
        SELECT "group", count(*) AS cases, round(avg(CASE WHEN NOT none THEN CAST(hit AS DOUBLE) END), 6) AS n_accuracy, round(avg(CAST(label = expect AS DOUBLE)), 6) AS label_accuracy, round(avg(CASE WHEN none THEN CAST(label = 'none' AS DOUBLE) END), 6) AS rejection_rate,
        coalesce(string_agg(CASE WHEN none AND label <> 'none' THEN id END, ',' ORDER BY id), '') AS false_matches, coalesce(string_agg(CASE WHEN NOT none AND NOT hit THEN id END, ',' ORDER BY id), '') AS wrong_sources, coalesce(string_agg(CASE WHEN NOT none AND NOT hit AND label = 'strong' THEN id END, ',' ORDER BY id), '') AS strong_on_wrong FROM f GROUP BY "group\"""",
    "filter_events": f"""WITH {_EVENTS} SELECT event_id FROM ev WHERE kind <> 'opened' AND NOT (kind = 'modified' AND event_id % 5 = 0) AND NOT (event_id % 7 = 0 AND (event_id % 3 <> 0 OR event_id % 2 = 0))""",
    "watch_debounce": f"""WITH {_EVENTS}, f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM ev), g AS (SELECT *, sum(new) OVER (PARTITION BY project ORDER BY ts, event_id) AS w FROM f)
        SELECT project, max(ts) + INTERVAL 1 HOUR AS notice, count(*) AS n_events FROM g GROUP BY project, w""",
    "locate_passage": """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n, doc_id % len(string_split(text, chr(10))) + 1 AS asked FROM documents),
        f AS (SELECT *, replace(lower(trim(regexp_replace(x, '[ \\t-\\r]+', ' ', 'g'))), 'ß', 'ss') AS y FROM l),
        u AS (SELECT *, n - row_number() OVER (PARTITION BY doc_id ORDER BY n) AS unit FROM f WHERE y <> ''),
        c AS (SELECT *, sum(length(y) + 1) OVER (PARTITION BY doc_id, unit ORDER BY n) - length(y) AS begun FROM u),
        t AS (SELECT doc_id, unit, string_agg(y, ' ' ORDER BY n) AS t, min(n) AS first, max(n) AS last FROM c GROUP BY doc_id, unit),
        p AS (SELECT doc_id, asked, max(y) FILTER (n = asked) AS p FROM f GROUP BY doc_id, asked),
        found AS (SELECT doc_id, unit, p, instr(t, p) AS pos FROM p JOIN t USING (doc_id) WHERE length(p) >= 12 AND contains(t, p)
          QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN doc_id % 2 = 1 AND asked BETWEEN first AND last THEN 0 ELSE 1 END, first) = 1),
        placed AS (SELECT doc_id, max(n) FILTER (begun <= pos) AS s, max(n) FILTER (begun <= pos + length(p) - 1) + 1 AS e FROM found JOIN c USING (doc_id, unit) GROUP BY doc_id)
        SELECT doc_id AS passage_id, doc_id, CAST(s AS INTEGER) AS start, CAST(e AS INTEGER) AS "end" FROM documents LEFT JOIN placed USING (doc_id)""",
    "find_within": """WITH f AS (SELECT doc_id, regexp_replace(lower(text), '[ \\t-\\r]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, CAST(coalesce(len(list_filter(range(1, length(t) - 1), lambda i: substr(t, i, 3) = 'e e')), 0) AS INTEGER) AS occurrences FROM f""",
    "cer": f"WITH {chat_queries._M}, {chat_queries._TURNS}, {_PAIRS}, {_FINE} SELECT pair_id, round(levenshtein(translate(a, '{_WIDE}', '{_NARROW}'), translate(b, '{_WIDE}', '{_NARROW}')) / greatest(1, length(a)), 6) AS cer FROM fine",
    "known_numbers": f"""WITH {chat_queries._M}, {_SOURCES}, picked AS (SELECT s.chat_id, s.id, s.doc_id FROM sources s), chosen AS (SELECT DISTINCT chat_id, id FROM sources JOIN documents USING (doc_id) WHERE n = 2),
        found AS (SELECT chat_id || '-' || id AS doc_id, unnest(regexp_extract_all(text, '[0-9]+(?:[.,:][0-9]+)*')) AS x FROM chosen JOIN sources USING (chat_id, id) JOIN documents USING (doc_id)
          WHERE n = 2 OR NOT ((chat_id + id) % 4 = 0)), {_NUMBERS}
        SELECT chat_id || '-' || id AS selection_id, coalesce(numbers, '') AS known FROM chosen LEFT JOIN listed ON listed.doc_id = chat_id || '-' || id""",
    "citation_segments": f"""WITH {_MARKED}, placed AS (SELECT chat_id, id, length(content) AS total, CAST(m.length_ AS BIGINT) AS base FROM marked JOIN (SELECT chat_id, id, length(content) AS length_ FROM m) m USING (chat_id, id)),
        cites AS (SELECT chat_id, id, base + 1 AS a, base + 3 + length(CAST(id AS VARCHAR)) AS b, id AS n, total FROM placed WHERE id BETWEEN 1 AND 4
          UNION ALL SELECT chat_id, id, total - 3, total, chat_id % 5, total FROM placed WHERE chat_id % 5 BETWEEN 1 AND 4),
        gaps AS (SELECT chat_id, id, lag(b, 1, 0) OVER (PARTITION BY chat_id, id ORDER BY a) AS a, a AS b FROM cites UNION ALL SELECT chat_id, id, coalesce(last, 0), total FROM placed LEFT JOIN (SELECT chat_id, id, max(b) AS last FROM cites GROUP BY chat_id, id) USING (chat_id, id)),
        rows_ AS (SELECT chat_id, id, 'cite' AS kind, a, b, n FROM cites UNION ALL SELECT chat_id, id, 'text', a, b, NULL FROM gaps WHERE a < b)
        SELECT chat_id, id, CAST(row_number() OVER (PARTITION BY chat_id, id ORDER BY a) - 1 AS INTEGER) AS k, kind, CAST(a AS INTEGER) AS start, CAST(b AS INTEGER) AS "end", CAST(n AS INTEGER) AS n FROM rows_""",
    "take_tokens": f"""WITH {chat_queries._M}, t AS (SELECT chat_id, id, list_transform(string_split(content, ''), lambda c: struct_pack(s := CASE WHEN regexp_matches(c, '[\\p{{L}}\\s]') THEN CAST(1 AS DOUBLE) / 3 ELSE 1.0::DOUBLE END, n := 1, over := false)) AS x FROM m WHERE content <> '')
        SELECT chat_id, id, CAST(coalesce(list_reduce(list_prepend(struct_pack(s := 0.0::DOUBLE, n := 0, over := false), x), lambda a, b: CASE WHEN a.over OR a.s + b.s > 50 THEN struct_pack(s := a.s, n := a.n, over := true) ELSE struct_pack(s := a.s + b.s, n := a.n + 1, over := false) END).n, 0) AS INTEGER) AS chars FROM m LEFT JOIN t USING (chat_id, id)""",
    "text_windows": f"""WITH {_SPANS}, starts AS (SELECT doc_id, k, n, a FROM w WHERE k % 30 = 0 AND n > 60 AND (k = 0 OR k + 30 < n)),
        ends AS (SELECT doc_id, k AS last, b FROM w)
        SELECT doc_id, CAST(k // 30 AS INTEGER) AS win, CAST(CASE WHEN k = 0 THEN 0 ELSE a END AS INTEGER) AS start, CAST(CASE WHEN k + 60 >= n THEN length(text) ELSE b END AS INTEGER) AS "end" FROM starts JOIN documents USING (doc_id) LEFT JOIN ends USING (doc_id) WHERE last = least(k + 59, n - 1)
        UNION ALL SELECT doc_id, 0, 0, length(coalesce(text, '')) FROM documents WHERE len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) <= 60""",
    "watch_notices": """WITH t AS (SELECT user_id AS project, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events GROUP BY user_id),
        w AS (SELECT *, lead(began) OVER (PARTITION BY project ORDER BY began, generation) AS ends FROM (SELECT project, g AS generation, a + (b - a) // 4 * g AS began FROM t, (SELECT unnest(range(0, 4)) AS g))),
        e AS (SELECT event_id, project, generation, ends, epoch_us(ts) AS ts FROM events JOIN w ON project = user_id AND generation = event_id % 4 WHERE epoch_us(ts) >= began AND (ends IS NULL OR epoch_us(ts) < ends)),
        f AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY project, generation ORDER BY ts, event_id) <= 3600000000 THEN 0 ELSE 1 END AS new FROM e), g AS (SELECT *, sum(new) OVER (PARTITION BY project, generation ORDER BY ts, event_id) AS n FROM f)
        SELECT project, CAST(generation AS INTEGER) AS generation, make_timestamp(notice) AS notice, n_events FROM (SELECT project, generation, ends, max(ts) + 3600000000 AS notice, count(*) AS n_events FROM g GROUP BY project, generation, ends, n) WHERE ends IS NULL OR notice < ends""",
    "late_events": "SELECT event_id FROM events JOIN (SELECT user_id, max(event_id % 4) AS g FROM events GROUP BY user_id) USING (user_id) WHERE event_id % 4 = g",
}
