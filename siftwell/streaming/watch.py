"""Folder events to change notices, and the index kept up by micro-batches. The same functions take batches and streams."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

QUIET = "2 seconds"


def filter_events(events: DataFrame) -> DataFrame:
    """Created, modified, deleted and moved ones; not a folder's own change, nor one whose every name is an editor's lock file."""
    names = F.filter(F.transform(F.array("src_path", "dest_path"), lambda p: F.element_at(F.split(p, "/"), -1)), lambda n: n.isNotNull() & (n != ""))
    locks = (F.size(names) > 0) & F.forall(names, lambda n: n.startswith("~$"))
    return events.where(F.col("event_type").isin("created", "modified", "deleted", "moved")).where(~((F.col("event_type") == "modified") & F.col("is_directory"))).where(~locks)


def watch_debounce(events: DataFrame, quiet: str = QUIET, late: str = "10 seconds") -> DataFrame:
    """``project, notice, n_events``: one notice per project once no event has come for ``quiet``."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("project", F.session_window("ts", quiet).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select("project", F.col("w.end").alias("notice"), "n_events")


def late_events(events: DataFrame, watches: DataFrame, late: str = "10 seconds") -> DataFrame:
    """Events of the current watch only: (project, generation) must be that of ``watches``. In a stream, repeats of an event
    (``event_id``) that come within ``late`` go as well."""
    if events.isStreaming:
        events = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.join(watches, ["project", "generation"], "left_semi")


def incremental_index(notices: DataFrame, checkpoint: str, refresh: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Runs ``refresh(batch, batch_id)`` over what is new and ends. A batch that is repeated after a failure has the same id."""
    return notices.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- notices of watches that may be replaced while they wait


def watch_notices(events: DataFrame, watches: DataFrame, quiet: str = QUIET) -> DataFrame:
    """``project, generation, notice, n_events``: a notice once a watch's events (project, generation, ts) have been quiet for ``quiet``.

    ``watches`` (project, generation, ts) says when each watch of a project began; a later one replaces it. Events of a watch before it began or after it was replaced
    don't count, and a notice that was still waiting then is never given. Of watches of one time the largest generation is the last.
    """
    order = Window.partitionBy("project").orderBy("ts", "generation")  # a row per watch
    spans = watches.withColumn("ends", F.lead("ts").over(order)).select("project", "generation", F.col("ts").alias("began"), "ends")
    own = events.join(spans, ["project", "generation"]).where((F.col("ts") >= F.col("began")) & (F.col("ends").isNull() | (F.col("ts") < F.col("ends"))))
    # The end is an aggregate: a filter on the window's own end would be pushed below the grouping and take single events out of a longer window.
    end = F.expr(f"max(ts) + interval '{quiet}'")
    quiet_ = own.groupBy("project", "generation", "ends", F.session_window("ts", quiet).alias("w")).agg(end.alias("notice"), F.count(F.lit(1)).alias("n_events"))
    return quiet_.where(F.col("ends").isNull() | (F.col("notice") < F.col("ends"))).select("project", "generation", "notice", "n_events")


_EVENT = "ts timestamp, generation int, starts boolean"
NOTICE = "project string, generation int, notice timestamp, n_events long"


class WatchState(StatefulProcessor):
    """Of each project the live watch, when its notice is due and how many events wait for it, and the events that the watermark hasn't passed.

    Events are taken in the order of their times once the watermark has passed them, so that late arrivals change nothing. A timer stands at each event's time and
    where a notice would be due; when a watch is replaced the due time goes, and a timer that still fires finds nothing to do.
    """

    def __init__(self, quiet_ms: int):
        self.quiet = pd.Timedelta(milliseconds=quiet_ms)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ahead = handle.getListState("ahead", _EVENT)
        self.live = handle.getValueState("live", "generation int, due timestamp, n_events long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            times = pd.to_datetime(frame["ts"])
            for t, generation, starts in zip(times, frame["generation"], frame["starts"], strict=True):
                self.ahead.appendValue((t.to_pydatetime(), int(generation), bool(starts)))
            for at in {_millis(t) for t in times} | {_millis(t + self.quiet) for t in times}:
                self.handle.registerTimer(at + 1)  # after all that happens in that millisecond
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = pd.Timestamp(timerValues.getCurrentWatermarkInMs(), unit="ms", tz="UTC")
        waiting = [(pd.Timestamp(r[0]), r[1], r[2]) for r in self.ahead.get()]
        waiting = [(t.tz_localize("UTC") if t.tz is None else t.tz_convert("UTC"), g, s) for t, g, s in waiting]
        now = sorted((e for e in waiting if e[0] < passed), key=lambda e: (e[0], not e[2], e[1]))
        generation, due, n = self.live.get() if self.live.exists() else (None, None, 0)
        due = None if due is None else pd.Timestamp(due).tz_localize("UTC") if pd.Timestamp(due).tz is None else pd.Timestamp(due).tz_convert("UTC")
        out = []

        def fire(until: pd.Timestamp) -> None:
            nonlocal due, n
            if due is not None and due < until:
                out.append((key[0], generation, due.to_pydatetime().replace(tzinfo=None), n))
                due, n = None, 0

        for t, g, starts in now:
            fire(t)
            if starts:
                generation, due, n = g, None, 0
            elif g == generation:
                due, n = t + self.quiet, n + 1
        fire(passed)
        if now:
            rest = [(t.to_pydatetime(), g, s) for t, g, s in waiting if t >= passed]
            self.ahead.put(rest) if rest else self.ahead.clear()
        if generation is not None:
            self.live.update((generation, None if due is None else due.to_pydatetime(), n))
        if out:
            yield pd.DataFrame(out, columns=["project", "generation", "notice", "n_events"])

    def close(self) -> None:
        pass


def _millis(t: pd.Timestamp) -> int:
    return int((t.tz_localize("UTC") if t.tz is None else t).timestamp() * 1000)


def stream_notices(events: DataFrame, watches: DataFrame, quiet_ms: int = 2000, late: str = "10 seconds") -> DataFrame:
    """``watch_notices`` of streams: state per project, with event-time timers. Needs Spark's RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``), and a session whose time zone is UTC."""
    both = events.select("project", "generation", "ts", F.lit(False).alias("starts")).unionByName(watches.select("project", "generation", "ts", F.lit(True).alias("starts")))
    rows = both.withColumn("project", F.col("project").cast("string")).withWatermark("ts", late)
    return rows.groupBy("project").transformWithStateInPandas(WatchState(quiet_ms), NOTICE, "Append", "EventTime")
