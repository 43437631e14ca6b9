"""Versioned tables and index passes: one version whole, conflicts, failed swaps, clean-up, contents of suspects only."""

import threading

import pytest
from pyspark.sql import functions as F

from siftwell.sources import files as S
from siftwell.sources import versions as V
from siftwell.streaming import index as I

SCHEMA = "file_id long, ord int, text string"


def rows_of(df):
    return sorted(tuple(r) for r in df.select("file_id", "ord", "text").collect())


def chunks(spark, of, text):
    return spark.createDataFrame([(i, k, text) for i in of for k in range(2)], SCHEMA)


def want(of, text):
    return [(i, k, text) for i in of for k in range(2)]


def test_a_swap_is_seen_whole_or_not_at_all(spark, tmp_path):
    table = str(tmp_path / "t")
    assert V.live(spark, table) == (-1, {}) and V.read(spark, table, SCHEMA).collect() == []
    assert V.replace(table, chunks(spark, range(20), "old"), "file_id") == 0
    pinned = V.read(spark, table, SCHEMA)
    files = spark.createDataFrame([(i,) for i in range(20) if i != 5], "file_id long")
    assert S.swap_file_chunks(table, chunks(spark, [3, 5, 7], "new").unionByName(chunks(spark, [99], "gone")), files, SCHEMA) == 1
    after = sorted(want([i for i in range(20) if i not in (3, 7)], "old") + want([3, 7], "new"))
    assert rows_of(V.read(spark, table, SCHEMA)) == after
    assert rows_of(pinned) == rows_of(V.read(spark, table, SCHEMA, 0)) == want(range(20), "old")
    # files that end without a chunk leave
    V.swap(table, chunks(spark, [], "x"), spark.createDataFrame([(3,), (4,)], "file_id long"), "file_id", SCHEMA)
    assert rows_of(V.read(spark, table, SCHEMA)) == [r for r in after if r[0] not in (3, 4)]
    # few buckets were written anew
    assert len({p for p in V.live(spark, table)[1].values() if p}) == 3


def test_a_failed_swap_and_a_second_writer_leave_what_is_there(spark, tmp_path):
    table = str(tmp_path / "t")
    V.replace(table, chunks(spark, range(6), "old"), "file_id")
    broken = chunks(spark, [1], "new").withColumn("text", F.raise_error(F.lit("no text")).cast("string"))
    with pytest.raises(Exception, match="no text"):
        S.swap_file_chunks(table, broken, spark.createDataFrame([(1,)], "file_id long"), SCHEMA)
    assert V.live(spark, table)[0] == 0 and rows_of(V.read(spark, table, SCHEMA)) == want(range(6), "old")
    base, parts = V.live(spark, table)
    assert V.commit(spark, table, base, parts) == 1
    with pytest.raises(V.Conflict):
        V.commit(spark, table, base, {})
    assert V.live(spark, table) == (1, parts)
    # a manifest that is still being written is no version yet
    (tmp_path / "t/manifest/0000000002.json").write_text("")
    assert V.live(spark, table) == (1, parts)


def test_writers_at_once_commit_one_version_each(spark, tmp_path):
    table, done = str(tmp_path / "t"), []
    V.replace(table, chunks(spark, range(8), "old"), "file_id")

    def write(i):
        while True:
            try:
                done.append(S.swap_file_chunks(table, chunks(spark, [i], f"new{i}"), spark.createDataFrame([(i,)], "file_id long"), SCHEMA))
                return
            except V.Conflict:
                continue

    threads = [threading.Thread(target=write, args=(i,)) for i in range(3)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(done) == [1, 2, 3]
    assert rows_of(V.read(spark, table, SCHEMA)) == sorted(want(range(3, 8), "old") + [r for i in range(3) for r in want([i], f"new{i}")])


def test_vacuum_removes_what_no_version_names(spark, tmp_path):
    table = str(tmp_path / "t")
    for k in range(4):
        V.replace(table, chunks(spark, range(4), f"v{k}"), "file_id")
    dead = V.vacuum(spark, table, keep=2)
    assert len(dead) == 2 and V.versions(spark, table) == [2, 3] and V.vacuum(spark, table) == []
    assert rows_of(V.read(spark, table, SCHEMA)) == want(range(4), "v3") and rows_of(V.read(spark, table, SCHEMA, 2)) == want(range(4), "v2")


def test_passes_read_suspects_only_and_clean_up(spark, tmp_path):
    state, asked_for = str(tmp_path / "state"), []
    notices = spark.createDataFrame([("p",)], "project string")
    nowhere = spark.createDataFrame([], "project string, place string")

    def run(batch, rows):
        disk = spark.createDataFrame([("p", *r, None) for r in rows], "project string, rel_path string, size long, mtime double, text string, error string")

        def read(keys):
            asked_for.append(sorted(r["rel_path"] for r in keys.collect()))
            return disk.join(keys, ["project", "rel_path"], "left_semi")

        I.index_pass(state, batch, notices, disk.drop("text", "error"), read, nowhere)
        return sorted((r["rel_path"], r["status"], r["mtime"]) for r in I.files_after(spark, state, batch).collect())

    first = [("a", 1, 1.0, "one"), ("b", 1, 1.0, "two"), ("c", 1, 1.0, "three")]
    run(0, first)
    assert asked_for.pop() == ["a", "b", "c"]
    same = run(1, first)
    assert asked_for.pop() == [] and [s for _, s, _ in same] == ["indexed"] * 3 and spark.read.parquet(f"{state}/read/batch=1").count() == 0
    second = [("a", 1, 9.0, "one"), ("b", 2, 1.0, "other"), ("d", 1, 1.0, "four")]  # touched, changed, gone, new
    assert run(2, second) == [("a", "indexed", 9.0), ("b", "indexed", 1.0), ("d", "indexed", 1.0)]
    assert asked_for.pop() == ["a", "b", "d"]
    text = lambda batch: sorted(r["text"] for r in I.chunks_after(spark, state, batch).collect())
    assert text(2) == ["four", "one", "other"]
    assert I.clean(spark, state, 2) == 2 and text(2) == ["four", "one", "other"]  # two and three
    assert {r["text"] for r in spark.read.schema(I.CONTENTS).parquet(f"{state}/contents").collect()} == {"four", "one", "other"}
    run(3, [*second, ("back", 1, 1.0, "two")])
    assert asked_for.pop() == ["back"] and text(3) == ["four", "one", "other", "two"]
