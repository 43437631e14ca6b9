"""Executors without the package, long words, languages by brute force, null ids."""

import hashlib
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import zstandard
from tokenizers import Tokenizer

from siftwell.llm import bpe, decontaminate, language, lattice, near_copies, quality, shards, substring, token_files

from .conftest import SCHEMA, frame

REPO = Path(__file__).resolve().parents[2]

_FOREIGN = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
import corpus_pipeline
from siftwell.llm import centroids, decontaminate, merkle, mixing
docs = spark.createDataFrame([(k, "some words of text number " + str(k) + " that stand here for a test of workers and of nothing else at all " * 3, "en", "s", 10) for k in range(20)], "doc_id long, text string, lang string, source string, n_chars long")
items = spark.createDataFrame([(1, "of workers and of nothing else at all that stand here for"), (2, "number 7")], "item_id long, text string")
counts = [decontaminate.digest(docs, items).count(), decontaminate.cleaned(docs, items).count(), decontaminate.covered(docs, items).count(), decontaminate.matches(docs, items, block_words=3).count()]
counts += [merkle.digest(docs).count(), mixing.digest(docs).count()]
counts += [centroids.digest(spark.createDataFrame([(k, [float(k)] * 64) for k in range(20)], "vec_id long, embedding array<float>")).count()]
docs.write.parquet("documents.parquet")
items.write.parquet("benchmark.parquet")
print("COUNTS", *counts, corpus_pipeline.run(spark, ".").count())
"""


def test_executors_need_no_copy_of_the_package(tmp_path):
    """The package is on the driver's path alone; its workers start in another folder."""
    said = subprocess.run([sys.executable, "-B", "-c", _FOREIGN.format(repo=str(REPO))], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr[-3000:]
    _, left, gone, *rest = counts = list(map(int, said.stdout.split("COUNTS")[1].split()))
    assert left + gone == 20 and counts[0] == 20 and rest[:4] == [20] * 4


def test_long_words_count_as_wholes(monkeypatch):
    weights = {"a": 0.2, "b": 0.2, "ab": 0.3, "ba": 0.1, "aba": 0.1, lattice.START + "ab": 0.1}
    model, words = lattice.Lattice(weights), ["ab" * 3000, "ba" * 1700 + "x", "abab"]
    counts, times = np.zeros(len(weights)), np.array([1.0, 3.0, 2.0])
    logs = model.expect(words, times, counts)
    monkeypatch.setattr(lattice, "STRETCH", 10**6)
    monkeypatch.setattr(lattice, "CHARACTERS", 10**6)
    want = np.zeros(len(weights))
    assert model.expect(words, times, want) == pytest.approx(logs)
    assert counts == pytest.approx(want, rel=1e-9)
    assert model.log10(words) == pytest.approx(logs)


def brute_languages(rows, limits):
    """Rows of (doc_id, text, lang); all rows fit the sample, so that its order alone depends on the hash."""
    train = {}
    for h, i, t, lang in sorted((h, i, t, lang) for h, i, t, lang in rows):
        if lang is not None and t and any(map(str.isalpha, t)) and zlib.crc32(str(i).encode()) % 4 != 2:
            train.setdefault(lang, []).append(language.normalised(t))
    coders = {}
    for lang, texts in train.items():
        content = zstandard.ZstdCompressionDict(b"\n".join(texts)[: limits.dictionary_bytes], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders[lang] = zstandard.ZstdCompressor(level=limits.level, dict_data=content, write_content_size=False, write_checksum=False, write_dict_id=False)
    out = []
    for _, i, t, _ in rows:
        low = language.normalised(t or "")
        sizes = sorted((len(c.compress(low)), lang) for lang, c in coders.items())
        some = bool(t) and any(map(str.isalpha, t))
        out.append((i, zlib.crc32(str(i).encode()) % 4 == 2, sizes[0][1] if some else "und", round(1 - sizes[0][0] / sizes[1][0], 9) if some else 0.0))
    return sorted(out, key=str)


def test_languages_equal_brute_force(spark):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    parts = {"aa": "ka lo mi ra tu ve".split(), "bb": "schö ter ung nich ein".split(), "cc": "où est ça le tré mble".split()}
    text = lambda lang, n: " ".join("".join(rng.choices(parts[lang], k=3)) for _ in range(n))
    rows = [(k, text(lang, rng.randint(1, 120)), lang if k % 5 else None) for k in range(90) for lang in [rng.choice("abc") * 2]]
    rows += [(100, None, "aa"), (101, "", "bb"), (102, "123 ... 456", "cc"), (103, text("aa", 9000), "aa"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    hashed = [tuple(r) for r in docs.select(F.pmod(F.xxhash64("doc_id", "text", F.lit("language")), F.lit(1 << 40)), "doc_id", "text", "lang").collect()]
    got = sorted(((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9)) for r in language.held_out_prediction(docs).collect()), key=str)
    want = brute_languages(hashed, language.Limits())
    assert got == want and sum(r[2] == "und" for r in got) == 3


def nulls(spark):
    return frame(spark, [(None, "words without an id, number one"), (None, "words without an id, number one"), (None, None), (4, "an id and words"), (4, "an id and other words"), (None, "the end of " + "long " * 300)])


def test_null_ids(spark):
    rows = [(r["doc_id"], r["text"]) for r in nulls(spark).collect()]
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=(ranks := bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))), special_tokens={})
    got = sorted(((r["doc_id"], r["n_tokens"], r["decoded_sha256"]) for r in bpe.digest(nulls(spark), ranks, public_tokenizers.PATTERN).collect()), key=str)
    assert got == sorted(((i, len(encoder.encode_ordinary(t or "")), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows), key=str)
    items = spark.createDataFrame([(1, "without an id")], "item_id long, text string")
    assert sorted(((r["doc_id"], r["n_hit"]) for r in decontaminate.digest(nulls(spark), items).collect()), key=str) == sorted([(None, 3), (None, 3), (None, 0), (None, 0), (4, 0), (4, 0)], key=str)
    path = public_tokenizers.path("word_bpe_49k.json")
    library, out = Tokenizer.from_file(path), token_files.written_and_read(nulls(spark), path).collect()
    assert sorted(((r["doc_id"], r["n_tokens"]) for r in out), key=str) == sorted(((i, len(library.encode(t or "", add_special_tokens=False).ids) + 1) for i, t in rows), key=str)
    starts = sorted((r["start"], r["n_tokens"]) for r in out)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0
    placed = shards.sharded(nulls(spark), shards=4).collect()
    assert sorted(((r["doc_id"], r["size"]) for r in placed), key=str) == sorted(((i, len((t or "").encode()) + 16) for i, t in rows), key=str)


def test_stages_take_empty_tables_and_null_or_repeated_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    items = spark.createDataFrame([(1, "without an id")], "item_id long, text string")
    for stage in (near_copies.first_of_each, substring.cleaned, quality.kept, lambda d: decontaminate.cleaned(d, items)):
        assert stage(empty).collect() == [] and stage(empty).columns == empty.columns
    assert sum(r["doc_id"] is None for r in near_copies.first_of_each(nulls(spark)).collect()) == 4  # null ids stay
    assert quality.kept(nulls(spark)).count() == 0
