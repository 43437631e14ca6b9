"""Streams of folder events against their batch forms, and watches that are replaced while a notice waits."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from siftwell.streaming import watch as W

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
START = dt.datetime(2024, 1, 1)


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


@pytest.fixture
def rocks(spark):
    usual = spark.conf.get(PROVIDER)
    spark.conf.set(PROVIDER, ROCKS)
    yield spark
    spark.conf.set(PROVIDER, usual)


def arriving(spark, tmp_path, name, schema, batches):
    """A stream that gets each of ``batches`` as a micro-batch of its own."""
    folder = tmp_path / name
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder / f"b{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(folder))


def collected(stream, tmp_path, name):
    out = str(tmp_path / f"{name}-out")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / f"{name}-check")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return sorted(map(tuple, stream.sparkSession.read.schema(stream.schema).parquet(out).collect()), key=str)


EVENT = "project string, generation int, ts timestamp"


def notices(df):
    return sorted(map(tuple, df.select("project", "generation", "notice", "n_events").collect()), key=str)


def test_a_replaced_watchs_notice_is_never_given(spark):
    watches = spark.createDataFrame([("p", 1, at(0)), ("p", 2, at(11)), ("q", 1, at(0)), ("r", 1, at(5))], EVENT)
    rows = [("p", 1, at(1)), ("p", 1, at(2)), ("p", 1, at(10)), ("p", 1, at(12)), ("p", 2, at(20)), ("q", 1, at(10)), ("r", 1, at(1)), ("r", 1, at(30)), ("s", 1, at(1)), ("p", 2, at(3))]
    got = notices(W.watch_notices(spark.createDataFrame(rows, EVENT), watches))
    # p's event at 10 would be told at 12, when its watch is gone; what came before a watch or for one that never began is no event
    assert got == [("p", 1, at(4), 2), ("p", 2, at(22), 1), ("q", 1, at(12), 1), ("r", 1, at(32), 1)]


def test_a_session_that_reaches_its_watchs_end_gives_no_part_of_itself(spark):
    watches = spark.createDataFrame([("p", 1, at(0)), ("p", 2, at(12))], EVENT)
    rows = [("p", 1, at(8)), ("p", 1, at(9)), ("p", 1, at(11)), ("p", 2, at(13))]  # 8 and 9 alone would be told at 11
    assert notices(W.watch_notices(spark.createDataFrame(rows, EVENT), watches)) == [("p", 2, at(15), 1)]


def test_stream_of_watches_equals_batch(rocks, tmp_path):
    pytest.importorskip("google.protobuf")  # Spark talks to the state store with it
    spark, rng = rocks, random.Random(3)
    watches = [(p, g, at(t)) for p in "abc" for g, t in enumerate([0, 25, 60], 1)]
    events = [(rng.choice("abcd"), rng.randint(1, 3), at(rng.randint(0, 400) / 4)) for _ in range(250)]
    timed = sorted([(e[2], False, e) for e in events] + [(w[2], True, w) for w in watches], key=lambda x: (x[0], not x[1]))
    late = [(t + dt.timedelta(seconds=rng.uniform(0, 4)), kind, e) for t, kind, e in timed]  # arrivals out of order, inside the watermark's delay
    late.sort(key=lambda x: x[0])
    schema = EVENT + ", starts boolean"
    batches = [[(*e, kind) for _, kind, e in late[k : k + 40]] for k in range(0, len(late), 40)] + [[("end", 9, at(1000), True)], [("end", 9, at(2000), True)], [("end", 9, at(3000), True)]]
    stream = arriving(spark, tmp_path, "in", schema, batches)
    got = collected(W.stream_notices(stream.where("not starts").drop("starts"), stream.where("starts").drop("starts"), 2000, "20 seconds"), tmp_path, "in")
    want = notices(W.watch_notices(spark.createDataFrame(events, EVENT), spark.createDataFrame(watches, EVENT)))
    assert len(want) > 10 and got == want


def test_stream_filters_equal_batch(spark, tmp_path):
    schema = "event_id long, project string, generation int, ts timestamp, event_type string, is_directory boolean, src_path string, dest_path string"
    rng = random.Random(8)
    rows = [(k, rng.choice("ab"), rng.randint(1, 2), at(k), rng.choice(["created", "modified", "opened", "deleted", "moved"]), rng.random() < 0.3, rng.choice(["d/a.txt", "d/~$a.txt", ""]), rng.choice([None, "e/~$b.txt", "e/b.txt"])) for k in range(120)]
    batches = [rows[k : k + 30] for k in range(0, 120, 30)]
    ids = lambda df: sorted(r["event_id"] for r in df.collect())
    whole = spark.createDataFrame(rows, schema)
    stream = W.filter_events(arriving(spark, tmp_path, "f", schema, batches)).select("event_id")
    assert [r[0] for r in sorted(collected(stream, tmp_path, "f"))] == ids(W.filter_events(whole))
    watches = spark.createDataFrame([("a", 2), ("b", 1)], "project string, generation int")
    doubled = [[*b, b[0]] for b in batches]  # events that are told twice
    stream = W.late_events(arriving(spark, tmp_path, "l", schema, doubled), watches).select("event_id")
    assert [r[0] for r in sorted(collected(stream, tmp_path, "l"))] == ids(W.late_events(whole, watches))


def test_notices_of_given_events_reach_the_refresh_once(spark, tmp_path):
    seen = []
    stream = arriving(spark, tmp_path, "n", "project string", [[("p",), ("p",)], [("q",)]])
    refresh = lambda batch, batch_id: seen.append((batch_id, sorted(r[0] for r in batch.distinct().collect())))
    W.incremental_index(stream, str(tmp_path / "check"), refresh).awaitTermination()
    W.incremental_index(stream, str(tmp_path / "check"), refresh).awaitTermination()  # nothing is new
    assert seen == [(0, ["p"]), (1, ["q"])] or seen == [(0, ["q"]), (1, ["p"])]
