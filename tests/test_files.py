"""Folder walks, contents by hash, and one tokenisation for each unit."""

import os
import random
import re

import numpy as np
import pytest

from siftwell.operators import attribution as A
from siftwell.operators import files as X
from siftwell.operators import passages as P
from siftwell.sources import files as S


def folder(tmp_path):
    for name, text in {"a.md": "alpha", "_draft.txt": "kept", "_notes/b.TXT": "beta", "x/y/z/deep.md": "deep", ".git/c.md": "no", "~$a.md": "no", "x/.hidden.md": "no", "x/picture.png": "no", "x/y/thai.txt": "ก", "space name/é.md": "name"}.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="cp874" if text == "ก" else "utf-8")
    (tmp_path / "link.md").symlink_to(tmp_path / "a.md")
    (tmp_path / "loop").symlink_to(tmp_path)
    return tmp_path


SEEN = {"a.md", "_draft.txt", "_notes/b.TXT", "x/y/z/deep.md", "x/y/thai.txt", "space name/é.md"}


@pytest.mark.parametrize("prefix", ["", "file:", "file://"])
def test_walk_sees_all_names(spark, tmp_path, prefix):
    root = folder(tmp_path)
    rows = S.scan_corpus(spark, f"{prefix}{root}").collect()
    assert {r["rel_path"] for r in rows} == SEEN
    assert {r["rel_path"]: (r["size"], r["mtime"]) for r in rows}["a.md"] == (5, os.stat(root / "a.md").st_mtime)
    texts = {r["rel_path"]: r["text"] for r in S.read_text_files(spark, f"{prefix}{root}").collect()}
    assert set(texts) == SEEN and texts["_notes/b.TXT"] == "beta" and texts["x/y/thai.txt"] == "ก"


def test_unreadable_places_are_told_and_protect_what_is_below(spark, tmp_path, monkeypatch):
    root = folder(tmp_path / "p")
    (root / "gone").mkdir()
    found = S.walk(spark, str(root))
    assert S.failed_places(found).collect() == []
    # a place that is no folder any more when its task comes to it
    assert list(S._entries(str(root), "no/such/place")) == [("no/such/place", "failed", None, None)]
    assert [r["place"] for r in S.failed_places(S.walk(spark, str(tmp_path / "nowhere"))).collect()] == ["."]
    if os.geteuid():  # root may read all
        (root / "x").chmod(0)
        found = S.walk(spark, str(root))
        assert [r["place"] for r in S.failed_places(found).collect()] == ["x"]
        (root / "x").chmod(0o700)
    failed = spark.createDataFrame([("p", "x")], "project string, place string")
    known = spark.createDataFrame([("p", n) for n in sorted(SEEN)], "project string, rel_path string")
    assert {r["rel_path"] for r in X.protect_unreadable(known, failed).collect()} == {n for n in SEEN if not n.startswith("x/")}
    row = S.read_listed(spark.createDataFrame([("a.md",), ("missing.md",)], "rel_path string"), str(root)).orderBy("rel_path").collect()
    assert [(r["text"], r["error"]) for r in row] == [("alpha", None), (None, "No such file or directory")]


def test_a_second_run_embeds_nothing(spark, tmp_path):
    sources = spark.createDataFrame([("m", 1, "one two three"), ("m", 2, "one two three"), ("n", 1, " ".join(["word"] * 200)), ("n", 2, None)], "message_id string, n int, text string")
    store, calls = str(tmp_path / "store"), str(tmp_path / "calls")
    os.mkdir(calls)

    def make():
        def model(texts):
            for t in texts:
                open(os.path.join(calls, f"{abs(hash(t))}-{os.getpid()}-{random.random()}"), "w").close()
            return A.hash_embed(texts)

        return model

    def run(rows):
        before = len(os.listdir(calls))
        out = sorted((r["message_id"], r["n"], r["win"], tuple(np.round(r["vector"], 5))) for r in A.windows_of(rows, make, store).collect())
        return out, len(os.listdir(calls)) - before

    first, embedded = run(sources)
    assert embedded == 4  # equal windows once, and the empty one
    again, none = run(sources)
    assert again == first and none == 0
    more, new = run(sources.unionByName(spark.createDataFrame([("z", 1, "something new")], sources.schema)))
    assert new == 1 and len(more) == len(first) + 1
    plain = sorted((r["message_id"], r["n"], r["win"], tuple(np.round(r["vector"], 5))) for r in A.windows_of(sources).collect())
    assert plain == first


def test_units_are_tokenised_once():
    rng, calls = random.Random(4), []

    def text(n):
        return "".join(rng.choice(["word ", "two. ", "x! ", "漢字。", "仮名", "\n", "more, ", "a" * 30 + " ", "…。？ "]) for _ in range(n))

    def counting(t):
        calls.append(t)
        return [m.span() for m in re.finditer(r"\S+", t)]

    free = P.context_free(lambda t: counting(t))
    for n in (0, 5, 60, 400, 900):
        for limit, overlap in ((7, 3), (20, 0), (50, 15)):
            body = "\n\n".join(text(n) for _ in range(3))
            calls.clear()
            once = P.chunk_text(body, limit, overlap, free)
            assert len(calls) == len(P.text_units(body))
            assert once == P.chunk_text(body, limit, overlap, counting)  # asks again for every part
            chars = lambda t: P.char_spans(t)
            assert P.chunk_text(body, limit, overlap, P.char_spans) == P.chunk_text(body, limit, overlap, chars)
