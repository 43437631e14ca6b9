"""Chats: exchanges, titles, lists, search over messages. Messages are (chat_id, id, role, content), ids ascending in a chat."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import passages as P

# Tokens around one message, and the replies that say that nothing was found.
MESSAGE_TOKENS = 8
NOT_FOUND = ("ไม่พบข้อมูลนี้ในเอกสาร", "Not found in the documents.", "文档中未找到相关信息。")


def turns(messages: DataFrame) -> DataFrame:
    """``chat_id, turn, question, answer``: each user message with the first assistant message before the next one, else null."""
    numbered = messages.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("chat_id").orderBy("id")))
    first = F.min(F.when(F.col("role") == "assistant", F.struct("id", "content")))
    return (
        numbered.where("turn > 0")
        .groupBy("chat_id", "turn")
        .agg(F.max(F.when(F.col("role") == "user", F.col("content"))).alias("question"), first["content"].alias("answer"))
    )


def recent_exchanges(messages: DataFrame, n: int) -> DataFrame:
    """The last ``n`` exchanges of each chat; read in the order of ``turn``."""
    newest = F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("turn")))
    return turns(messages).withColumn("age", newest).where(F.col("age") <= n)


def messages_with_sources(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages with their sources (chat_id, id, n, ...) as a list in the order of n; empty when there are none."""
    rest = [c for c in sources.columns if c not in ("chat_id", "id", "n")]
    lists = sources.groupBy("chat_id", "id").agg(F.array_sort(F.collect_list(F.struct("n", *rest))).alias("sources"))
    return messages.join(lists, ["chat_id", "id"], "left").withColumn("sources", F.coalesce("sources", F.array().cast(lists.schema["sources"].dataType)))


def chat_scopes(scopes: DataFrame) -> DataFrame:
    return scopes.groupBy("chat_id").agg(F.sort_array(F.collect_set("project")).alias("projects"))


def chat_title(messages: DataFrame) -> DataFrame:
    """The first question, on one line, cut to 60 characters."""
    first = messages.where("role = 'user'").groupBy("chat_id").agg(F.min(F.struct("id", "content"))["content"].alias("content"))
    return first.select("chat_id", T.chat_title(F.col("content")).alias("title"))


def list_chats(messages: DataFrame, scopes: DataFrame) -> DataFrame:
    """``chat_id, activity, projects``; activity is the newest message's place (``at``) in the global order of messages."""
    return messages.groupBy("chat_id").agg(F.max("at").alias("activity")).join(chat_scopes(scopes), "chat_id", "left")


def _holds(text: Column, query: str) -> Column:
    return F.contains(T.ascii_fold(text), T.ascii_fold(F.lit(query)))


def newest_match_per_chat(messages: DataFrame, query: str) -> DataFrame:
    """The newest message of each chat that holds the query, A-Z ignoring case, no wildcards."""
    hits = messages.where(_holds(F.col("content"), query))
    return hits.withColumn("n", F.row_number().over(Window.partitionBy("chat_id").orderBy(F.desc("id")))).where("n = 1").drop("n")


def search_chats(chats: DataFrame, messages: DataFrame, query: str, k: int = 30) -> DataFrame:
    """The ``k`` most recently active chats (chat_id, title, activity) whose title or messages hold the query, with an excerpt of the newest hit."""
    newest = newest_match_per_chat(messages, query).select("chat_id", T.excerpt(F.col("content"), F.lit(query)).alias("excerpt"), F.lit(True).alias("hit"))
    found = chats.join(newest, "chat_id", "left").where(F.col("hit") | _holds(F.col("title"), query))
    return found.drop("hit").orderBy(F.desc("activity"), "chat_id").limit(k)


def earlier_answers(exchanges: DataFrame) -> DataFrame:
    """``exchanges`` with the answers as a prompt repeats them: without markers; null where one is missing, empty or a not-found reply."""
    answer = F.regexp_replace(F.regexp_replace("answer", r"[ \t]*" + T.MARKER, ""), r"(?U)^\s+|\s+$", "")
    return exchanges.withColumn("answer", F.when((answer != "") & ~answer.isin(*NOT_FOUND), answer))


def history_fit(exchanges: DataFrame, budgets: DataFrame) -> DataFrame:
    """Exchanges (chat_id, turn, question, answer) that fit a chat's budget (chat_id, budget) of tokens, newest first and without gaps.

    Exchanges without an answer worth repeating are skipped. If not even the newest fits, its
    answer is shortened to what the question leaves, marked ``cut``; if that is nothing, the chat has no history.
    """
    told = earlier_answers(exchanges).where("answer is not null").join(budgets, "chat_id")
    asked = T.estimate_tokens(F.col("question")) + MESSAGE_TOKENS
    newest = Window.partitionBy("chat_id").orderBy(F.desc("turn"))
    costs = told.withColumn("asked", asked).withColumn("cost", F.col("asked") + T.estimate_tokens(F.col("answer")) + MESSAGE_TOKENS)
    summed = costs.withColumn("spent", F.sum("cost").over(newest)).withColumn("age", F.row_number().over(newest)).withColumn("cut", F.col("spent") > F.col("budget"))
    room = F.col("budget") - F.col("asked") - MESSAGE_TOKENS
    kept = summed.where(~F.col("cut") | (F.col("age") == 1) & (room > 0))
    short = P.per_row(lambda text, n: text if n is None else P.take_tokens(text, n), "string", F.col("answer"), F.when(F.col("cut"), room))
    return kept.select("chat_id", "turn", "question", short.alias("answer"), "spent", "budget", "cut")


# Fixed values of the budget: a local model's window and reply, what stays free, and the history's share of the prompt's room.
CONTEXT_TOKENS, REPLY_TOKENS, MARGIN, HISTORY_SHARE = 8192, 1024, 256, 0.25
LANGUAGES = {"th": "Thai", "en": "English", "zh": "Chinese"}


@dataclass(frozen=True)
class Template:
    """Texts of a prompt. ``system`` has {language}, {notes} and, for prompts with sources, {sources}, each once and in that order; ``notes`` has {n} or {notes}.

    With sources the user's notes are the last numbered source, and ``notes`` is the rule that names it. Without, ``notes`` holds them.
    """

    system: str = (
        "Answer the question from the numbered sources alone.\n- Say so plainly if they don't answer it.\n- Earlier messages tell what the question refers to; facts come from the sources.\n"
        "- Put a source's number in brackets, like [1] or [2][3], behind each sentence that uses it.\n- Write in {language}.{notes}\n\nSources:\n\n{sources}"
    )
    notes: str = "\n- Source [{n}] holds the user's own notes: follow how they want answers, and cite [{n}] for what is taken from them."
    notes_name: str = "The user's notes"


#: A prompt of a chat without sources.
CHAT = Template("Answer from general knowledge; the user's documents are out of sight.\n- Don't cite sources.\n- Say so if you are not sure.\n- Write in {language}.{notes}", "\n- The user's notes, which say how they want answers, are no source:\n{notes}")


def _filled(text: str, **values: Column) -> Column:
    """A template's text with columns in its places."""
    parts = re.split(r"\{(\w+)\}", text)
    return F.concat(*(values[x] if k % 2 else F.lit(x) for k, x in enumerate(parts) if k % 2 or x))


def build_messages(rows: DataFrame, exchanges: DataFrame, template: Template = Template(), room: int = CONTEXT_TOKENS - REPLY_TOKENS, share: float | None = HISTORY_SHARE) -> DataFrame:
    """Prompts of ``rows`` (query_id, question, sources, notes) within ``room`` tokens, with the tokens of each part.

    ``sources`` is a list of (n, file, label, text) in order, empty for a chat. The system text comes first, then as many of the newest earlier
    ``exchanges`` (query_id, turn, question, answer) as fit, then the question. The history gets what system text, question and a margin leave, at most
    ``share`` of the room; its newest exchange is cut rather than left out.

    Returns ``query_id, system, history`` (a list of role and content)``, question, budget, instructions_tokens, notes_tokens, sources_tokens, history_tokens,
    question_tokens, source_count, history_kept, history_total``.
    """
    cost = T.estimate_tokens
    language = F.element_at(F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair)), T.detect_language(F.col("question")))
    blocks = F.array_join(F.transform("sources", lambda s: F.concat(F.lit("["), s["n"].cast("string"), F.lit("] "), s["file"], F.lit(" ("), s["label"], F.lit(")\n"), s["text"])), "\n\n")
    there, sourced = F.coalesce("notes", F.lit("")) != "", "{sources}" in template.system
    n = (F.size("sources") + 1).cast("string")
    rule = F.when(there, _filled(template.notes, n=n, notes=F.col("notes"))).otherwise("")
    noted = F.when(there, F.concat(F.lit("["), n, F.lit(f"] {template.notes_name}\n"), F.col("notes"))) if sourced else F.lit(None).cast("string")
    parts = rows.withColumn("blocks", blocks).withColumn("rule", rule).withColumn("noted", noted).withColumn("language", language)
    listed = F.concat_ws("\n\n", F.when(F.size("sources") > 0, F.col("blocks")), F.col("noted"))
    planned = parts.withColumn("system", _filled(template.system, language=F.col("language"), notes=F.col("rule"), sources=listed))
    left = F.lit(room) - cost(F.col("system")) - cost(F.col("question")) - MARGIN
    budget = left if share is None else F.least(left, F.lit(int(room * share)))
    planned = planned.select(
        "query_id", "system", "question", budget.alias("budget"), F.size("sources").cast("long").alias("source_count"),
        F.when(F.size("sources") > 0, cost(F.col("blocks"))).otherwise(0).cast("long").alias("sources_tokens"),
        (F.coalesce(cost(F.col("noted")), F.lit(0)) + cost(F.col("rule"))).cast("long").alias("notes_tokens"),
    )
    planned = planned.withColumn("instructions_tokens", cost(F.col("system")) + MESSAGE_TOKENS - F.col("sources_tokens") - F.col("notes_tokens")).withColumn("question_tokens", cost(F.col("question")) + MESSAGE_TOKENS)

    keyed = exchanges.withColumnRenamed("query_id", "chat_id")
    kept = history_fit(keyed, planned.select(F.col("query_id").alias("chat_id"), "budget"))
    pair = F.struct("turn", "question", "answer", (cost(F.col("question")) + cost(F.col("answer")) + 2 * MESSAGE_TOKENS).alias("tokens"))
    lists = kept.groupBy(F.col("chat_id").alias("query_id")).agg(F.array_sort(F.collect_list(pair)).alias("past"))
    totals = earlier_answers(keyed).groupBy(F.col("chat_id").alias("query_id")).agg(F.count("answer").alias("history_total"))
    said = F.flatten(F.transform("past", lambda e: F.array(F.struct(F.lit("user").alias("role"), e["question"].alias("content")), F.struct(F.lit("assistant").alias("role"), e["answer"].alias("content")))))
    joined = planned.join(lists, "query_id", "left").join(totals, "query_id", "left")
    return joined.select(
        *planned.columns,
        F.coalesce(said, F.array().cast("array<struct<role:string,content:string>>")).alias("history"),
        F.coalesce(F.aggregate("past", F.lit(0).cast("long"), lambda t, e: t + e["tokens"]), F.lit(0)).alias("history_tokens"),
        F.coalesce(F.size("past"), F.lit(0)).cast("long").alias("history_kept"),
        F.coalesce("history_total", F.lit(0)).alias("history_total"),
    )


def build_prompt(messages: DataFrame) -> DataFrame:
    """``query_id, prompt``: the messages of ``build_messages`` as one text."""
    return messages.select("query_id", F.concat_ws("\n\n", F.array("system"), F.transform("history", lambda m: m["content"]), F.array("question")).alias("prompt"))


def context_usage(messages: DataFrame) -> DataFrame:
    """What each part of a prompt of ``build_messages`` takes of the window, in tokens; the parts add up to the prompt."""
    parts = ["instructions", "notes", "sources", "history", "question"]
    total = sum((F.col(f"{p}_tokens") for p in parts), F.lit(0))
    return messages.select("query_id", *(F.col(f"{p}_tokens").alias(p) for p in parts), total.alias("total"), "source_count", "history_kept", "history_total")
