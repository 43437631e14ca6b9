"""The pipeline against a brute-force version of its five stages, and the guard around the optional part."""

import random
import subprocess
import sys
import time
from pathlib import Path

import numpy as np
import public_tokenizers
import tiktoken
import zstandard

import corpus_pipeline
from siftwell.llm import bpe, near_copies, quality

from .conftest import frame
from .test_operators import WORD5, brute_substring, lower, sha, words

REPO = Path(__file__).resolve().parents[2]


def corpus():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices(["ri", "ver", "sto", "ne", "wal", "ked", "un", "der", "mor", "ning", "quî", "et"], k=rng.randint(1, 4))) for _ in range(600)]
    prose = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    item, passage = prose(30), prose(55)
    rows = [(k, prose(rng.randint(80, 300))) for k in range(30)]
    rows += [(40, rows[3][1]), (41, rows[4][1] + " odd"), (42, "".join(c.upper() if c.isascii() else c for c in rows[5][1])), (43, "too short"), (44, None), (45, "again and again " * 60)]
    rows += [(50, prose(60) + "\n" + item + "\n" + prose(60)), (51, prose(10) + item), (52, passage + " " + prose(70)), (53, prose(70) + "\n" + passage + " " + prose(70)), (54, prose(90) + " " + " ".join(item.split()[5:17]) + "  " + prose(40))]
    return rows, [(1, item), (2, "never found at all in here"), (3, None)]


def five(t):
    w = words(lower(t or ""))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}


def brute(rows, items):
    zstd = zstandard.ZstdCompressor(level=quality.Bands().level)
    rows = [(i, t) for i, t in rows if quality.figures(t and t.encode(), quality.Bands(), zstd)[6]]
    sets = [five(t) for _, t in rows]
    least = list(range(len(rows)))
    for _ in rows:
        for a in range(len(rows)):
            least[a] = min([least[b] for b in range(len(rows)) if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])])
    rows = [r for k, r in enumerate(rows) if least[k] == k]
    wins = set()
    for _, t in items:
        w = WORD5.findall(lower(t or ""))
        n = min(10, len(w))
        wins |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1 if n else 0)}

    def hits(w):
        return {j for n in {len(k) for k in wins} for k in range(len(w) - n + 1) if tuple(w[k : k + n]) in wins for j in range(k, k + n)}

    cut = []
    for (i, t), kept in zip(rows, brute_substring(rows)):
        w = WORD5.findall(lower(t))
        if len(hits(w)) <= 0.5 * len(w) and (len(kept) >= 20 or len(kept) == len(words(t))):
            cut.append((i, t if len(kept) == len(words(t)) else " ".join(kept)))
    out = []
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    for i, t in cut:
        found = list(WORD5.finditer(lower(t)))
        w = [m.group() for m in found]
        hit = hits(w)
        if len(hit) > 0.5 * len(w):
            continue
        for k in sorted(hit, reverse=True):
            end = found[k].end()
            start = found[k].start() if k - 1 not in hit else found[k - 1].end()
            t = t[:start] + t[end:]
        ids = encoder.encode_ordinary(t)
        out.append((i, len(ids), sha(",".join(map(str, ids))), sha(t)))
    return sorted(out)


def test_pipeline_equals_brute_force(spark, tmp_path):
    rows, items = corpus()
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    want = brute(rows, items)
    assert got == want
    kept = {r[0] for r in got}
    assert {0, 1, 2, 3, 4, 50, 52, 53, 54} <= kept and not kept & {40, 42, 43, 44, 45, 51}


def test_documents_of_mostly_benchmark_words_leave_no_shell(spark, tmp_path):
    """A benchmark passage that is cut as a copy of an earlier document's still counts against the document."""
    rng = random.Random(4)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    item = own(90)
    rows = [(50, own(60) + " " + item), (51, own(40) + " " + item), (52, own(200) + " " + item), (53, own(120)), (54, own(110) + " " + item)]
    stage = dict(corpus_pipeline.STAGES)
    frame(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == brute(rows, [(1, item)]) and {r[0] for r in got} == {52, 53, 54}
    for several in (rows, [(i, t) for i, t in rows if i != 50], [(None, t) for _, t in rows]):
        kept = stage["substring"](spark, frame(spark, several), str(tmp_path)).collect()
        assert len(kept) == 3 and all(r["text"].split()[0] in {t.split()[0] for i, t in rows if i in (52, 53, 54)} for r in kept)


def test_many_texts_under_one_key_are_compared_in_bounded_time():
    """20,000 texts that share two thirds of their shingles and a few pairs of near copies among them."""
    rng = np.random.default_rng(1)
    common, n = rng.integers(0, 1 << 32, 140, dtype=np.uint64).astype(np.uint32), 20_000
    own = rng.integers(0, 1 << 32, (n, 70), dtype=np.uint64).astype(np.uint32)
    for k in range(0, n, 500):
        own[k + 1, :60] = own[k, :60]
    hashes = [np.unique(np.concatenate([common, x])).tobytes() for x in own]
    began = time.time()
    found = list(near_copies._joined(np.arange(n), np.arange(n), np.zeros(n, np.int64), hashes))
    assert sorted(map(sorted, found)) == [[k, k + 1] for k in range(0, n, 500)] and time.time() - began < 60


def test_near_copies_go_from_a_similarity_of_four_fifths(spark, tmp_path):
    rng = random.Random(21)
    rows, sets = [], []
    for k in range(40):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(80, 600))]
        rows.append((10 * k, " ".join(base)))
        for c in range(1, 5):
            share = rng.uniform(0.001, 0.06)
            rows.append((10 * k + c, " ".join(f"x{rng.randrange(5000)}" if rng.random() < share else x for x in base)))
    sets = [{tuple(t.split()[j : j + 5]) for j in range(len(t.split()) - 4)} for _, t in rows]
    similar = lambda a, b: len(a & b) / len(a | b)
    least = list(range(len(rows)))
    for k in range(0, len(rows), 5):
        for _ in range(5):
            for a in range(k, k + 5):
                for b in range(k, k + 5):
                    if similar(sets[a], sets[b]) >= 0.8:
                        least[a] = least[b] = min(least[a], least[b])
    planted = [similar(sets[k], sets[k + c]) for k in range(0, len(rows), 5) for c in range(1, 5)]
    assert sum(0.8 <= x < 0.95 for x in planted) > 30 and sum(x < 0.8 for x in planted) > 20
    stage = corpus_pipeline.STAGES[1][1]
    assert {r["doc_id"] for r in stage(spark, frame(spark, rows), str(tmp_path)).collect()} == {i for k, (i, _) in enumerate(rows) if least[k] == k}


def test_stages_keep_the_columns(spark, tmp_path):
    rows, items = corpus()
    docs = frame(spark, rows)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns


def test_entry_works_without_the_optional_part(tmp_path):
    for name in ("__spark_entry__.py", "siftwell"):
        subprocess.run(["cp", "-r", str(REPO / name), str(tmp_path)], check=True)
    (tmp_path / "siftwell" / "llm").rename(tmp_path / "gone")
    said = subprocess.run([sys.executable, "-B", "-c", "import __spark_entry__ as e; print(len(e.queries()), 'hybrid_search' in e.queries(), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert said.returncode == 0 and said.stdout.split()[1:] == ["True", "False"], said.stderr


def test_near_copies_are_not_lost_in_large_meetings(spark, tmp_path):
    """Texts that share most keys without being near copies of the first, among them pairs that are."""
    rng = random.Random(31)
    base = [f"w{k}" for k in range(60)]
    rows = []
    for k in range(60):  # each has its own tail: about 0.6 with all others, and a partner at 0.9
        tail = [f"t{k}x{j}" for j in range(16)]
        rows += [(10 * k, " ".join(base + tail)), (10 * k + 5, " ".join(base + tail[:-3] + ["end"]))]
    stage = corpus_pipeline.STAGES[1][1]
    assert {r["doc_id"] for r in stage(spark, frame(spark, rows), str(tmp_path)).collect()} == {10 * k for k in range(60)}


def test_blocks_of_large_meetings_join_the_same_components(spark):
    rng = random.Random(3)
    base, rows = [f"w{k}" for k in range(120)], []
    for k in range(90):
        own = [w if rng.random() > 0.035 else f"x{rng.randrange(10**6)}" for w in base[: rng.randint(100, 120)]]
        rows.append((k, " ".join(own), k % 5 if k > 70 else k))
    sets = [five(t) for _, t, _ in rows]
    least = [label for *_, label in rows]
    edges = [(a, b) for a in range(90) for b in range(a) if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    texts = spark.createDataFrame([r[:2] for r in rows], "id long, text string")
    met = spark.createDataFrame([(7, i, label) for i, _, label in rows], "key long, id long, label long")

    def parts(edges, labels):
        labels = list(labels)
        for _ in range(90):
            for a, b in edges:
                low, high = sorted((labels[a], labels[b]))
                labels = [low if x == high else x for x in labels]
        return labels

    want = parts(edges, least)
    assert 20 < len(set(want)) < 70
    for block in (10**6, 4000, 1100):
        found = [tuple(r) for r in near_copies._all_met(met, near_copies.sets(texts.select("id"), texts), block).collect()]
        assert set(found) <= {(b, a) for a, b in edges} and parts(found, least) == want
