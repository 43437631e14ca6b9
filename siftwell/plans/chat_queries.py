"""Registered queries of chats and prompts over the conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chats as C
from ..operators import search as S
from . import inputs, search_queries

QUERY = "ing th"
ROOM = C.CONTEXT_TOKENS - C.REPLY_TOKENS


def _scopes(s: SparkSession, d: str) -> DataFrame:
    return inputs.messages(s, d).where("id % 2 = 0").select("chat_id", F.concat(F.lit("src"), (F.col("chat_id") + F.col("id")) % 5).alias("project"))


def _sources(s: SparkSession, d: str) -> DataFrame:
    """Answers' sources: two documents each, by arithmetic on the ids, from the whole table."""
    answers = inputs.messages(s, d).where("role = 'assistant'").select("chat_id", "id", F.explode(F.array(F.lit(2), F.lit(1))).alias("n"))
    all_docs = inputs.table(s, d, "documents").agg((F.max("doc_id") + 1).alias("docs"))  # one row
    place = (F.col("chat_id") * 7919 + F.col("id") * 104729 + F.col("n")) % F.col("docs")
    return answers.where("id % 4 <> 3").crossJoin(F.broadcast(all_docs)).withColumn("doc_id", place).drop("docs")


def recent_exchanges(s: SparkSession, d: str) -> DataFrame:
    return C.recent_exchanges(inputs.messages(s, d), 2).select("chat_id", "turn", "question", "answer", "age")


def messages_with_sources(s: SparkSession, d: str) -> DataFrame:
    rows = C.messages_with_sources(inputs.messages(s, d).select("chat_id", "id"), _sources(s, d))
    return rows.select("chat_id", "id", F.array_join(F.transform("sources", lambda x: F.concat(x["n"].cast("string"), F.lit(":"), x["doc_id"].cast("string"))), ",").alias("sources"))


def chat_scopes(s: SparkSession, d: str) -> DataFrame:
    return C.chat_scopes(_scopes(s, d)).select("chat_id", F.array_join("projects", ",").alias("projects"))


def chat_title(s: SparkSession, d: str) -> DataFrame:
    return C.chat_title(inputs.messages(s, d))


def _numbered(s: SparkSession, d: str) -> DataFrame:
    """Turns of all chats take place in rounds: the global order is (turn, chat)."""
    return inputs.messages(s, d).withColumn("at", F.col("id") * 1_000_000_000 + F.col("chat_id"))


def list_chats(s: SparkSession, d: str) -> DataFrame:
    return C.list_chats(_numbered(s, d), _scopes(s, d)).select("chat_id", "activity", F.array_join("projects", ",").alias("projects"))


def newest_match_per_chat(s: SparkSession, d: str) -> DataFrame:
    return C.newest_match_per_chat(inputs.messages(s, d), QUERY)


def search_chats(s: SparkSession, d: str) -> DataFrame:
    m = _numbered(s, d)
    chats = C.chat_title(m).join(m.groupBy("chat_id").agg(F.max("at").alias("activity")), "chat_id")
    return C.search_chats(chats, m, QUERY).select("chat_id", "title", "activity", "excerpt")


def excerpt(s: SparkSession, d: str) -> DataFrame:
    return inputs.messages(s, d).select("chat_id", "id", T.excerpt(F.col("content"), F.lit(QUERY)).alias("excerpt"))


def query_text(s: SparkSession, d: str) -> DataFrame:
    """Each question with the chat's question before it."""
    from pyspark.sql import Window

    asked = inputs.messages(s, d).where("role = 'user'")
    return asked.withColumn("previous", F.lag("content").over(Window.partitionBy("chat_id").orderBy("id"))).select("chat_id", "id", T.query_text(F.col("content"), F.col("previous")).alias("query_text"))


def _exchanges(s: SparkSession, d: str) -> DataFrame:
    return C.recent_exchanges(inputs.messages(s, d), 50).drop("age")


def history_fit(s: SparkSession, d: str) -> DataFrame:
    budgets = inputs.messages(s, d).select("chat_id").distinct().withColumn("budget", 150 + F.col("chat_id") % 5 * 100)
    return C.history_fit(_exchanges(s, d), budgets).select("chat_id", "turn", "spent", "budget", "cut")


def _prompt_rows(s: SparkSession, d: str) -> DataFrame:
    """Questions of the query set with their sources, every third with notes."""
    hits = S.dense_topk(inputs.questions(s, d).where("query_vector is not null"), inputs.vectors(s, d), 4)
    # numbered once fetched: a vector without a chunk leaves no gap
    found = S.number_sources(hits.join(inputs.chunks(s, d), "chunk_id"), 4).groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("n", F.col("project").alias("file"), F.concat(F.lit("chunk "), F.col("chunk_id").cast("string")).alias("label"), "text"))).alias("sources")
    )
    asked = inputs.questions(s, d).select("query_id", F.col("query_text").alias("question"))
    notes = F.when(F.col("query_id") % 300 == 0, F.concat(F.lit("note "), F.col("query_id").cast("string")))
    return asked.join(found, "query_id").select("query_id", "question", "sources", notes.alias("notes"))


def _messages(s: SparkSession, d: str) -> DataFrame:
    past = C.turns(inputs.messages(s, d)).select((F.col("chat_id") * 100).alias("query_id"), "turn", "question", "answer")
    return C.build_messages(_prompt_rows(s, d), past)


def build_prompt(s: SparkSession, d: str) -> DataFrame:
    return C.build_prompt(_messages(s, d))


def context_usage(s: SparkSession, d: str) -> DataFrame:
    return C.context_usage(_messages(s, d))


QUERIES = {f.__name__: f for f in (recent_exchanges, messages_with_sources, chat_scopes, chat_title, list_chats, newest_match_per_chat, search_chats, excerpt, query_text, history_fit, build_prompt, context_usage)}

_M = "m AS (SELECT conv_id AS chat_id, turn AS id, role, text AS content, turn * 1000000000 + conv_id AS pos FROM conversations WHERE role IN ('user', 'assistant'))"
_SCOPES = "scopes AS (SELECT DISTINCT chat_id, 'src' || (chat_id + id) % 5 AS project FROM m WHERE id % 2 = 0)"
_TURNS = "numbered AS (SELECT *, sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY chat_id ORDER BY id) AS turn FROM m), turns AS (SELECT chat_id, CAST(turn AS BIGINT) AS turn, max(content) FILTER (WHERE role = 'user') AS question, arg_min(content, id) FILTER (WHERE role = 'assistant') AS answer FROM numbered WHERE turn > 0 GROUP BY chat_id, turn)"
_LINE = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
_FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_AT = f"instr({_FOLD.format('content')}, '{QUERY}')"
_EXCERPT = f"""CASE WHEN {_AT} > 0 THEN CASE WHEN {_AT} - 40 > 1 THEN '…' ELSE '' END || {_LINE.format(f'substr(content, greatest(1, {_AT} - 40), 120)')} || CASE WHEN greatest(1, {_AT} - 40) + 119 < length(content) THEN '…' ELSE '' END END"""
_NEWEST = f"newest AS (SELECT * FROM m WHERE contains({_FOLD.format('content')}, '{QUERY}') QUALIFY row_number() OVER (PARTITION BY chat_id ORDER BY id DESC) = 1)"
_TITLES = f"titles AS (SELECT chat_id, substr({_LINE.format('arg_min(content, id)')}, 1, 60) AS title FROM m WHERE role = 'user' GROUP BY chat_id)"


def _cost(c: str) -> str:
    """Token estimate; the data has no Thai or East Asian characters, which would have to be taken out of the light ones."""
    light = f"len(regexp_extract_all({c}, '[\\p{{L}}\\s]'))"
    return f"(length({c}) - {light} + CAST(ceil({light} / 3.0) AS BIGINT))"


_NOTED = "(CASE WHEN query_id % 300 = 0 THEN 'note ' || query_id END)"
_SOURCED = "(SELECT query_id, doc_id, source, documents.text AS body, row_number() OVER (PARTITION BY query_id ORDER BY rank, chunk_id) AS n FROM dense JOIN documents ON doc_id = chunk_id WHERE rank <= 4)"
_TOLD = "regexp_replace(regexp_replace(answer, '[ \\t]*\\[[0-9]{1,3}(\\s*,\\s*[0-9]{1,3})*\\]', '', 'g'), '^\\s+|\\s+$', '', 'g')"
_HEAD, _MIDDLE = (x.replace("'", "''") for x in C.Template.system.split("{sources}")[0].split("{language}"))
_RULE = "'" + C.Template.notes.replace("'", "''").replace("{n}", "' || (n + 1) || '") + "'"
_NAME = C.Template.notes_name.replace("'", "''")
#: Prompts up to the history they can have, the history, and its newest answer cut where it must be.
_PLANNED = (
    f"""planned AS (SELECT *, '{_HEAD}English' || replace('{_MIDDLE}', '{{notes}}', rule) || blocks || coalesce('\n\n' || noted, '') AS system FROM (SELECT query_id, questions.text AS question, n, blocks, coalesce({_RULE}, '') AS rule_,
        CASE WHEN query_id % 300 = 0 THEN {_RULE} ELSE '' END AS rule, '[' || (n + 1) || '] {_NAME}\n' || {_NOTED} AS noted FROM questions JOIN
        (SELECT query_id, count(*) AS n, string_agg('[' || n || '] ' || source || ' (chunk ' || doc_id || ')\n' || body, '\n\n' ORDER BY n) AS blocks FROM {_SOURCED} GROUP BY query_id) USING (query_id))),
    budgets AS (SELECT *, least({ROOM} - {_cost('system')} - {_cost('question')} - 256, {int(ROOM * C.HISTORY_SHARE)}) AS budget FROM planned),
    usable AS (SELECT chat_id * 100 AS query_id, turn, question AS earlier, {_TOLD} AS answer FROM turns WHERE answer IS NOT NULL),
    priced AS (SELECT * FROM (SELECT query_id, turn, earlier, answer, budget, {_cost('earlier')} + 8 AS asked, {_cost('earlier')} + 16 + {_cost('answer')} AS cost FROM usable JOIN budgets USING (query_id) WHERE answer <> '' AND answer NOT IN ('ไม่พบข้อมูลนี้ในเอกสาร', 'Not found in the documents.', '文档中未找到相关信息。'))),
    summed AS (SELECT *, sum(cost) OVER (PARTITION BY query_id ORDER BY turn DESC) AS spent, row_number() OVER (PARTITION BY query_id ORDER BY turn DESC) AS age FROM priced),
    costs_ AS (SELECT query_id, turn, list_transform(string_split(answer, ''), lambda c: struct_pack(s := CASE WHEN regexp_matches(c, '[\\p{{L}}\\s]') THEN CAST(1 AS DOUBLE) / 3 ELSE 1.0::DOUBLE END, n := 1, most := CAST(budget - asked - 8 AS DOUBLE), over := false)) AS x FROM summed WHERE spent > budget AND age = 1 AND budget - asked - 8 > 0),
    cut_ AS (SELECT query_id, turn, list_reduce(list_prepend(struct_pack(s := 0.0::DOUBLE, n := 0, most := 0.0::DOUBLE, over := false), x), lambda a, b: CASE WHEN a.over OR a.s + b.s > b.most THEN struct_pack(s := a.s, n := a.n, most := b.most, over := true) ELSE struct_pack(s := a.s + b.s, n := a.n + 1, most := b.most, over := false) END).n AS chars FROM costs_),
    kept AS (SELECT query_id, turn, earlier, CASE WHEN chars IS NULL THEN answer ELSE substr(answer, 1, chars) END AS answer FROM summed LEFT JOIN cut_ USING (query_id, turn) WHERE spent <= budget OR chars IS NOT NULL),
    past AS (SELECT query_id, string_agg(earlier || '\n\n' || answer, '\n\n' ORDER BY turn) AS said, CAST(sum({_cost('earlier')} + {_cost('answer')} + 16) AS BIGINT) AS history, count(*) AS kept FROM kept GROUP BY query_id),
    totals AS (SELECT query_id, count(*) AS history_total FROM priced GROUP BY query_id)"""
).replace("coalesce(" + _RULE + ", '') AS rule_,\n        ", "")


def _prompts(body: str) -> str:
    return search_queries._sql(body, *search_queries._DENSE).replace("\nSELECT", f",\n{_M}, {_TURNS}, {_PLANNED}\nSELECT", 1)


ORACLE_SQL = {
    "recent_exchanges": f"WITH {_M}, {_TURNS} SELECT *, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS age FROM turns QUALIFY age <= 2",
    "messages_with_sources": f"WITH {_M} SELECT chat_id, id, CASE WHEN role = 'assistant' AND id % 4 <> 3 THEN '1:' || (chat_id * 7919 + id * 104729 + 1) % (SELECT max(doc_id) + 1 FROM documents) || ',2:' || (chat_id * 7919 + id * 104729 + 2) % (SELECT max(doc_id) + 1 FROM documents) ELSE '' END AS sources FROM m",
    "chat_scopes": f"WITH {_M}, {_SCOPES} SELECT chat_id, string_agg(project, ',' ORDER BY project) AS projects FROM scopes GROUP BY chat_id",
    "chat_title": f"WITH {_M}, {_TITLES} SELECT * FROM titles",
    "list_chats": f"WITH {_M}, {_SCOPES} SELECT chat_id, activity, projects FROM (SELECT chat_id, max(pos) AS activity FROM m GROUP BY chat_id) LEFT JOIN (SELECT chat_id, string_agg(project, ',' ORDER BY project) AS projects FROM scopes GROUP BY chat_id) USING (chat_id)",
    "newest_match_per_chat": f"WITH {_M}, {_NEWEST} SELECT chat_id, id, role, content FROM newest",
    "search_chats": f"WITH {_M}, {_NEWEST}, {_TITLES} SELECT chat_id, title, activity, excerpt FROM titles JOIN (SELECT chat_id, max(pos) AS activity FROM m GROUP BY chat_id) USING (chat_id) LEFT JOIN (SELECT chat_id, {_EXCERPT} AS excerpt FROM newest) USING (chat_id) WHERE excerpt IS NOT NULL OR contains({_FOLD.format('title')}, '{QUERY}') ORDER BY activity DESC, chat_id LIMIT 30",
    "excerpt": f"WITH {_M} SELECT chat_id, id, {_EXCERPT} AS excerpt FROM m",
    "query_text": f"WITH {_M} SELECT chat_id, id, concat_ws(chr(10), content, lag(content) OVER (PARTITION BY chat_id ORDER BY id)) AS query_text FROM m WHERE role = 'user'",
    "history_fit": f"""WITH {_M}, {_TURNS}, told AS (SELECT chat_id, turn, question, {_TOLD} AS answer FROM turns),
        priced AS (SELECT *, {_cost('question')} + 8 AS asked, asked + {_cost('answer')} + 8 AS cost, 150 + chat_id % 5 * 100 AS budget FROM told WHERE answer <> '' AND answer NOT IN ('ไม่พบข้อมูลนี้ในเอกสาร', 'Not found in the documents.', '文档中未找到相关信息。')),
        summed AS (SELECT *, CAST(sum(cost) OVER (PARTITION BY chat_id ORDER BY turn DESC) AS BIGINT) AS spent, row_number() OVER (PARTITION BY chat_id ORDER BY turn DESC) AS age FROM priced)
        SELECT chat_id, turn, spent, budget, spent > budget AS cut FROM summed WHERE spent <= budget OR age = 1 AND asked + 8 < budget""",
    "context_usage": _prompts(
        f"""SELECT query_id, {_cost('system')} + 8 - sources - notes AS instructions, notes, sources, history, question, {_cost('system')} + 8 + history + question AS total, source_count, history_kept, history_total FROM
        (SELECT query_id, system, {_cost('blocks')} AS sources, CASE WHEN rule = '' THEN 0 ELSE {_cost('noted')} + {_cost('rule')} END AS notes, coalesce(history, 0) AS history, {_cost('question')} + 8 AS question, n AS source_count, coalesce(kept, 0) AS history_kept, coalesce(history_total, 0) AS history_total
        FROM budgets LEFT JOIN past USING (query_id) LEFT JOIN totals USING (query_id))"""
    ),
    "build_prompt": _prompts("SELECT query_id, system || coalesce('\n\n' || said, '') || '\n\n' || question AS prompt FROM budgets LEFT JOIN past USING (query_id)"),
}
