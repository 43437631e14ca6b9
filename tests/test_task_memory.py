"""What a task holds follows the texts it works on, not the rows of a batch."""

import pandas as pd
import pyarrow as pa

from siftwell.operators import passages as P
from siftwell.operators import postings as B
from siftwell.streaming import index as I


class Narrow:
    """Stands for a DataFrame and keeps the function that is mapped over its batches."""

    def __init__(self, spark):
        self.sparkSession = spark

    def select(self, *_):
        return self

    repartition = sortWithinPartitions = select

    def mapInArrow(self, run, schema):
        return run

    mapInPandas = mapInArrow


def test_chunks_leave_after_few_texts(spark):
    batch = pa.record_batch([pa.array([*range(999), None]), pa.array([*(f"text {k} of some words" for k in range(998)), None, "last"])], names=["doc_id", "text"])
    for tokens in (P.word_spans, P.char_spans):
        out = list(P.chunk_documents(Narrow(spark), token_spans=tokens)(iter([batch])))
        assert max(b.num_rows for b in out) <= P.TEXTS < 100
        assert [i for b in out for i in b.column(0).to_pylist()] == [*range(998), None]


def test_embedded_chunks_leave_after_few_texts(spark):
    frame = pd.DataFrame({"hash": [f"h{k}" for k in range(500)], "text": [f"words of {k}" for k in range(499)] + [None]})
    out = list(I.embedded_chunks(Narrow(spark))(iter([frame])))
    assert max(map(len, out)) <= P.TEXTS
    assert [h for f in out for h in f.hash] == list(frame.hash) and out[-1].ord.isna().iloc[-1]


def test_postings_are_decoded_some_at_a_time(spark, monkeypatch):
    monkeypatch.setattr(B, "DECODED", 1000)
    terms = [B.term_number(a + b + "x") for a in "abcdefgh" for b in "abcdefgh"]
    rows = [(7, B.CHUNKS, B.packed(pd.array(range(300)).to_numpy("int64")), b"")] + [(7, t, B.packed(pd.array(range(300)).to_numpy("int64")), B.packed(pd.array([2] * 300).to_numpy("int64"))) for t in sorted(terms)]
    batch = pa.record_batch([pa.array(c) for c in zip(*rows)], names=["shard", "term", "places", "counts"])
    out = list(B.decoded(Narrow(spark))(iter([batch])))
    assert max(b.num_rows for b in out) < 1000 + 300
    assert sorted((t, c, n) for b in out for t, c, n in zip(*(x.to_pylist() for x in b.columns))) == sorted((a + b + "x", c, 2) for a in "abcdefgh" for b in "abcdefgh" for c in range(300))
