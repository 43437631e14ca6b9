"""The operators against brute force on awkward rows, empty tables and clashing columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import public_tokenizers
import tiktoken
import xxhash
from tokenizers import Tokenizer

from siftwell.llm import bpe, decontaminate, language, lattice, quality, resample, shards, simhash, substring, token_files
from siftwell.llm.common import ranked

from .conftest import frame

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


def words(t):
    return WORDS.findall(t or "")


def sha(b):
    return hashlib.sha256(b if isinstance(b, bytes) else b.encode()).hexdigest()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---- 1 byte-level BPE


@pytest.fixture(scope="session")
def encoder():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks(BPE), special_tokens={})


def test_bpe_equals_the_library_and_decodes(spark, awkward, encoder):
    got = rows_of(bpe.digest(frame(spark, awkward), bpe.ranks(BPE), public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    want = []
    for i, t in awkward:
        ids = encoder.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids))), sha(t or "")))
    assert got == sorted(want, key=str)


def test_bpe_in_many_chunks_and_round_trip(spark, awkward):
    vocabulary = bpe.ranks(BPE)
    ids = bpe.encoded(frame(spark, awkward), vocabulary, public_tokenizers.PATTERN, chunk_bytes=500)
    assert rows_of(bpe.decoded(ids, vocabulary), "doc_id", "data") == sorted(((i, (t or "").encode()) for i, t in awkward), key=lambda r: str((r[0], bytearray(r[1])))) or {
        (r["doc_id"], bytes(r["data"])) for r in bpe.decoded(ids, vocabulary).collect()
    } == {(i, (t or "").encode()) for i, t in awkward}


def test_bpe_units_match_the_pattern_anywhere(encoder):
    units, tokens = bpe.pre_tokens(public_tokenizers.PATTERN)
    rng, letters = random.Random(3), [*"abcéßÀ.,,'’!? \n\t0123½漢字-_\x1c\x85　", "'s", "'LL", "  ", "the "]
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randint(1, 14)))
        assert [k for u in units(text.encode()) for w in tokens(u) for k in encoder._encode_single_piece(w)] == encoder.encode_ordinary(text)


def test_bpe_places_words_of_very_many_ids(spark, encoder):
    rng = random.Random(7)
    run = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=160_000))
    rows = [(1, "some words stand here"), (2, run), (3, "and other words here " * 20), (4, "so " + run + "! then more words")]
    assert len(encoder.encode_ordinary(run)) > 65_535
    got = rows_of(bpe.digest(frame(spark, rows).coalesce(1), bpe.ranks(BPE), public_tokenizers.PATTERN), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert got == [(i, len(ids), sha(",".join(map(str, ids))), sha(t)) for i, t in rows for ids in [encoder.encode_ordinary(t)]]


# ---- 2 SimHash


def brute_fingerprint(t, shingle):
    w = words(lower(t or ""))
    parts = [" ".join(w[k : k + shingle]) for k in range(len(w) - shingle + 1)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits=4):
    own = dict(enumerate(range(len(prints))))

    def root(k):
        while own[k] != k:
            k = own[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= bits:
                x, y = root(a), root(b)
                own[max(x, y)] = min(x, y)
    return [root(k) for k in range(len(prints))]


def brute_simhash(rows, shingle):
    rows = sorted(rows)
    prints = [brute_fingerprint(t, shingle) for _, t in rows]
    least = brute_components(prints)
    return sorted(((i, f"{p:016x}", rows[c][0]) for (i, _), p, c in zip(rows, prints, least)), key=str)


def test_simhash_equals_brute_force(spark, awkward):
    assert rows_of(simhash.digest(frame(spark, awkward)), "doc_id", "fingerprint", "component_id") == brute_simhash(awkward, 4)


def test_simhash_links_a_dense_cluster_and_chains(spark):
    rng = random.Random(1)
    base = rng.getrandbits(64)
    prints = {base} | {base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(300)} | {rng.getrandbits(64) for _ in range(200)}
    chain = [rng.getrandbits(64)]
    for _ in range(30):
        chain.append(chain[-1] ^ sum(1 << b for b in rng.sample(range(64), 4)))
    prints = sorted(prints | set(chain))
    signed = [int(np.uint64(p).astype(np.int64)) for p in prints]
    nodes = spark.createDataFrame([(p, k) for k, p in enumerate(signed)], "fp long, id long")
    want = brute_components(prints)
    for layout in simhash.LAYOUTS:
        got = {r["fp"]: r["component"] for r in simhash.components(nodes, simhash.links(nodes.select("fp"), layout=layout)).collect()}
        assert [got.get(p, k) for k, p in enumerate(signed)] == want


def test_simhash_links_long_runs_and_clashing_rows(spark):
    rng = random.Random(3)
    run = "".join(rng.choices("漢字文書", k=70_000))
    rows = [(1, run), (2, run + " x"), (3, None), (None, "a b c d e f"), (4, "word " * 200_000), (5, "a b c d e f")]
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.digest(frame(spark, rows)).collect()}
    assert {i: p for i, (p, _) in got.items()} == {i: f"{brute_fingerprint(t, 4):016x}" for i, t in rows}
    assert got[1][1] == 1 and got[3][1] == 3 and got[None][1] == 5 and got[5][1] == 5


# ---- 3 importance resampling


def test_resampling_scores_and_counts(spark, awkward):
    toxic = [(200 + k, "nice words here are fine " * 3 + "vile slur " * 5) for k in range(10)]
    good = [(300 + k, "nice words here are fine and good to read " * 3) for k in range(30)]
    labels = spark.createDataFrame([(i, 1, 0) for i, _ in good[:20]] + [(i, 1, 1) for i, _ in toxic], "doc_id long, quality int, toxic int")
    rows = awkward + toxic + good
    out = resample.resampled(frame(spark, rows), labels, resample.Settings(share=0.5)).collect()
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(rows) // 2
    assert sorted(r["rank"] for r in out) == list(range(len(rows)))
    assert all(r["kept"] for r in out if r["doc_id"] >= 300) and not any(r["kept"] for r in out if 200 <= r["doc_id"] < 300)
    assert all(r["log_ratio"] == 0 and r["n_grams"] == 0 for r in out if r["doc_id"] in (2, 3, 4))
    raw = Counter()
    hashes = resample.WordHashes()
    for _, t in rows:
        raw.update(resample.grams([(t or "").encode()], hashes, 1 << 15)[0].tolist())
    model = resample.model(frame(spark, rows), 1 << 15)
    assert {k: int(model[k]) for k in np.flatnonzero(model).tolist()} == dict(raw)
    n = len(words(rows[0][1]))
    assert next(r["n_grams"] for r in out if r["doc_id"] == 1) == 2 * n - 1


def test_resampling_equals_brute_force(spark, awkward):
    """Ratios, noise, ranks and choice recomputed one n-gram at a time."""
    rows = [*awkward, (None, "no id but words here"), (7000, "same words " * 5), (7001, "same words " * 5)]
    labels = [(i, int(i is not None and i % 2 == 1), int(i in (5, 9))) for i in dict(rows)]
    mask = (1 << 64) - 1

    def buckets(t):
        h = [xxhash.xxh64_intdigest(w.encode(), 3) >> 1 for w in words(lower(t or ""))]
        pairs = [((a * 0x9E3779B97F4A7C15 + b) & mask) * 0xD6E8FEB86659FD93 & mask for a, b in zip(h, h[1:])]
        return [x >> 49 for x in [w * 0xA0761D6478BD642F & mask for w in h] + pairs]

    settings = resample.Settings(share=0.5)
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(buckets(t))
        if i is not None and i % 2 == 1 and i not in (5, 9):
            target.update(buckets(t))
    n_raw, n_target = sum(raw.values()), sum(target.values())
    extra = settings.smoothing * n_target
    log = {b: math.log((target[b] + extra * raw[b] / n_raw) / (n_target + extra) / (raw[b] / n_raw)) for b in raw}
    noise = {r["doc_id"]: r["u"] for r in spark.createDataFrame([(i,) for i in dict(rows)], "doc_id long").selectExpr("doc_id", f"(pmod(xxhash64(doc_id, {settings.seed}), {(1 << 40) - 1}) + 0.5) / {float((1 << 40) - 1)}D u").collect()}
    want = [(i, len(buckets(t)), sum(log[b] for b in buckets(t))) for i, t in rows]
    want = sorted(((i, n, x, x - math.log(-math.log(noise[i]))) for i, n, x in want), key=lambda r: (-r[3], r[0] is not None, r[0]))
    out = resample.resampled(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), settings)
    got = sorted(out.collect(), key=lambda r: r["rank"])
    assert [r["rank"] for r in got] == list(range(len(rows))) and [r["kept"] for r in got] == [k < len(rows) // 2 for k in range(len(rows))]
    assert [(r["doc_id"], r["n_grams"]) for r in got] == [(i, n) for i, n, _, _ in want]
    assert [r["log_ratio"] for r in got] == pytest.approx([x for _, _, x, _ in want], abs=1e-6)
    assert [r["gumbel_key"] for r in got] == pytest.approx([k for *_, k in want], abs=1e-6)


# ---- 4 substring dedup


def brute_substring(rows, window=20):
    """Kept words by row, in the order of rows."""
    first = {}
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    gone = defaultdict(set)
    for k in order:
        i, t = rows[k]
        w = words(t)
        if i is None:
            continue
        for s in range(len(w) - window + 1):
            if first.setdefault(tuple(w[s : s + window]), (i, s)) != (i, s):
                gone[k] |= set(range(s, s + window))
    return [[x for j, x in enumerate(words(t)) if j not in gone[k]] for k, (_, t) in enumerate(rows)]


def test_substring_equals_brute_force(spark, awkward):
    rng = random.Random(9)
    passage = " ".join(rng.choice("abcdefgh") + str(rng.randrange(40)) for _ in range(70))
    rows = [*awkward, (None, awkward[0][1]), (60, "so " * 7 + passage), (61, passage + " z" * 60), (62, "q " * 25 + passage + " " + passage), (63, " ".join(passage.split()[:20])), (64, " ".join(passage.split()[1:20]))]
    rows += [(100 + k, "one line that is said again and again.\n" * 20) for k in range(5)]
    got = rows_of(substring.digest(frame(spark, rows)), "doc_id", "n_words", "n_removed", "kept_sha256")
    kept = brute_substring(rows)
    assert got == sorted(((i, len(words(t)), len(words(t)) - len(k), sha(" ".join(k))) for (i, t), k in zip(rows, kept)), key=str)


def test_substring_anchors_depend_on_the_window_alone():
    rng = random.Random(4)
    names = np.array([0, *(rng.choice([1, 2, 3, 3, 3, 9]) for _ in range(3000)), 0, *(rng.choice([1, 2, 3, 3]) for _ in range(3000)), 0], np.uint64)
    key, low, high = substring.anchors(names, np.array([1, 3002]))
    seen = {}
    for k, a, b in zip(key.tolist(), low.tolist(), high.tolist()):
        for at in range(a, b + 1):
            assert seen.setdefault(tuple(names[at : at + 20].tolist()), k) == k


def test_substring_cleaned_keeps_columns(spark, awkward):
    out = substring.cleaned(frame(spark, awkward))
    assert out.columns == frame(spark, awkward).columns
    by = {r["doc_id"]: r for r in out.collect()}
    assert 6 not in by and by[1]["text"] == awkward[0][1] and by[1]["n_chars"] == len(awkward[0][1])


# ---- 5 decontamination

WORD5 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_contamination(rows, items, window=10):
    wins = defaultdict(set)
    for i, t in items:
        w = WORD5.findall(lower(t or ""))
        n = min(window, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            wins[tuple(w[k : k + n])].add(str(i))
    out = []
    for i, t in rows:
        w = WORD5.findall(lower(t or ""))
        hit, found = set(), set()
        for n in {len(k) for k in wins}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in wins:
                    hit |= set(range(k, k + n))
                    found |= wins[x]
        out.append((i, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return sorted(out, key=str)


ITEMS = [(1, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "!!"), (12, "beta gamma delta epsilon zeta eta theta iota kappa lambda nu"), (7, "ab cd"), (8, "item"), (2, "short item")]
COLUMNS5 = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("block_words", [1_000_000, 12])
def test_decontamination_equals_brute_force(spark, awkward, block_words):
    rows = [*awkward, (70, "x Alpha, BETA gamma delta epsilon zeta eta theta iota kappa lambda mu! y"), (71, "a short item here; a short"), (72, "beta gamma delta epsilon zeta eta theta iota kappa"), (73, ("gamma delta epsilon zeta eta theta iota kappa lambda nu " * 3))]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.matches(frame(spark, rows), items, block_words=block_words).collect()
    got = sorted(((r["doc_id"], r["n_words"], sum(s["stop"] - s["start"] for s in r["spans"]), len(r["items"]), sha(",".join(r["items"])), bool(r["spans"])) for r in found), key=str)
    assert got == brute_contamination(rows, ITEMS)


def test_automaton_on_random_words():
    rng = random.Random(2)
    items = [(str(k), [rng.choice([b"a", b"b"]) for _ in range(rng.randrange(1, 9))]) for k in range(20)]
    doc = [rng.choice([b"a", b"b", b"c"]) for _ in range(400)]
    spans, found = decontaminate.Automaton(items, 4).hits(doc)
    want = brute_contamination([(0, " ".join(x.decode() for x in doc))], [(i, " ".join(x.decode() for x in w)) for i, w in items], 4)[0]
    assert (sum(b - a for a, b in spans), sha(",".join(sorted(found)))) == (want[2], want[4])


def test_decontamination_cuts_and_drops(spark):
    items = spark.createDataFrame(ITEMS[:1], "item_id long, text string")
    leak = ITEMS[0][1]
    out = {r["doc_id"]: r["text"] for r in decontaminate.cleaned(frame(spark, [(1, "clean text"), (2, leak), (3, "w " * 30 + leak + ", and more"), (4, None)]), items).collect()}
    assert out == {1: "clean text", 3: "w " * 30 + ", and more", 4: None}


@pytest.mark.parametrize("block_words", [100])
def test_decontamination_cuts_alike_for_one_and_many_blocks(spark, awkward, block_words):
    w = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(w[4 * k : 4 * k + 14])) for k in range(10)] + [(20 + k, " ".join([*w[k : k + 6], *w[50 : 54 + k]])) for k in range(6)] + ITEMS
    rows = [*awkward, (70, " ".join(w)), (71, "so " * 12 + " ".join(w[:14]) + " and " * 3 + " ".join(w[36:50])), (72, "q " * 90 + " ".join(w[:50]) + " end"), (73, "Q, " * 60 + ". ".join(w[:14]) + " so " + " ".join([*w[:6], *w[:14], *w[50:54]])), (None, "z " * 40 + " ".join(w[8:30]))]
    items = spark.createDataFrame(items, "item_id long, text string")
    one, many = (sorted((tuple(r) for r in decontaminate.cleaned(frame(spark, rows), items, block_words=n).collect()), key=str) for n in (1_000_000, block_words))
    assert len(decontaminate.item_blocks(items, block_words)) > 1 and many == one and {70, 71}.isdisjoint(r[0] for r in one)


# ---- 6 quality rules


def test_quality_figures_equal_brute_force(spark, awkward):
    rows = [*awkward, (80, "same line here\nsame line here\n\nother\nsame line here"), (81, "one two three four five six seven eight nine " * 3)]
    got = rows_of(quality.judged(frame(spark, rows)), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = []
    for i, t in rows:
        t, w = t or "", words(t)
        wins = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if wins[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)))
    assert got == sorted(want, key=str)


def test_quality_bands(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices(["ri", "ver", "sto", "ne", "wal", "ked", "un", "der", "mor", "ning", "qui", "et"], k=rng.randint(1, 4))) for _ in range(400)]
    prose = " ".join(rng.choice(vocabulary) for _ in range(900))
    noise = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=60)) for _ in range(150))
    repeated = " ".join("ab" * k for k in range(1, 200))
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(frame(spark, [(1, prose), (2, noise), (3, repeated), (4, None)])).collect()}
    assert kept == {1: True, 2: False, 3: False, 4: False}
    assert [r["doc_id"] for r in quality.kept(frame(spark, [(1, prose), (2, noise)])).collect()] == [1]


def test_quality_verdicts_equal_brute_force(spark, awkward):
    """Ratios, chunk ratios and verdicts recomputed, and what each kind of junk comes to."""
    import zstandard

    rng = random.Random(11)
    vocabulary = ["".join(rng.choices(["ri", "ver", "sto", "ne", "wal", "ked", "un", "der", "mor", "ning", "qui", "et"], k=rng.randint(1, 4))) for _ in range(4000)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    base64 = lambda n, w=5: " ".join("".join(rng.choices(letters, k=w)) for _ in range(n))
    kinds = {
        "prose": [prose(n) for n in (22, 30, 60, 150, 400, 900, 4000, 9000)],
        "base64": [base64(n) for n in (22, 30, 60, 150, 400, 900, 4000)] + [base64(40, 70)],
        "mixed": [prose(1500) + base64(2000) + prose(1500)],
        "counted": [" ".join("ab" * k for k in range(1, 200))],
    }
    rows = [*awkward, (None, prose(80)), *((1000 + 100 * g + k, t) for g, texts in enumerate(kinds.values()) for k, t in enumerate(texts))]
    bands = quality.Bands()
    size = lambda b: len(zstandard.ZstdCompressor(level=bands.level).compress(b))

    def good(part, limits):
        for below, low, high in limits:
            if len(part) < below:
                return low <= len(part) / size(part) <= high

    want = []
    figures = {(r["doc_id"], r["n_words"], r["word_chars"]): r for r in quality.judged(frame(spark, rows)).collect()}
    for i, t in rows:
        b, w = (t or "").encode(), words(t)
        r = figures[i, len(w), sum(map(len, w))]
        parts = [p for p in (b[k : k + 4096] for k in range(0, len(b), 4096)) if len(p) >= 2048] if len(b) > 4096 else []
        ratios = [len(p) / size(p) for p in parts]
        whole = len(b) / size(b) if b else None
        assert r["ratio"] == whole and r["chunk_min"] == min(ratios, default=whole) and r["chunk_max"] == max(ratios, default=whole)
        assert r["kept"] == (bool(b) and not r["base_failed"] and good(b, bands.whole) and all(good(p, bands.chunk) for p in parts))
        want.append((i, r["kept"]))
    kept = dict(want)
    shares = {kind: [kept[1000 + 100 * g + k] for k in range(len(texts))] for g, (kind, texts) in enumerate(kinds.items())}
    assert all(shares["prose"]) and kept[None] and not any(shares["base64"] + shares["mixed"] + shares["counted"])


# ---- 7 token files


def test_token_files_equal_the_library(spark, awkward):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rng = random.Random(7)
    awkward = [*awkward, (600, "".join(rng.choices("漢字文書", k=70_000))), (601, "and then <|endoftext|> " * 3)]
    got = sorted(tuple(r) for r in token_files.written_and_read(frame(spark, awkward), path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    at, want = 0, []
    for i, t in sorted(awkward, key=lambda r: r[0]):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == sorted(want)


def test_token_files_keep_added_tokens(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    rows = [(1, "<|endoftext|>"), (2, "The model prints <|endoftext|> at the end<|endoftext|>."), (3, "a<|startoftext|>B, <|STARTOFTEXT|> x<|EndOfText|>y."), (4, "<|ENDOFTEXT|><|endoftext|><|startoftext|> It's so, é<|endoftext|>É"), (5, "Plain words follow, here."), (6, "<|endoftext|>."), (7, "<|endoftext <|endo ftext|>")]
    got = sorted(tuple(r) for r in token_files.written_and_read(frame(spark, rows), path).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    at, want = 0, []
    for i, t in rows:
        ids = [*library.encode(t, add_special_tokens=False).ids, 2]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == want and library.encode(rows[1][1], add_special_tokens=False).ids.count(49407) == 2


def test_token_files_read_a_range_and_are_coded_as_said(spark, awkward, tmp_path):
    import pyarrow.parquet as pq

    path = f"{tmp_path}/tokens"
    token_files.write(frame(spark, awkward), "file://" + path, public_tokenizers.path("word_bpe_49k.json"))
    assert {r["doc_id"] for r in token_files.fetch(spark, "file://" + path, 20, 25).collect()} == set(range(20, 26))
    meta = pq.ParquetFile(next(p for p in sorted(tmp_path.rglob("*.parquet")))).metadata.row_group(0)
    by = {meta.column(k).path_in_schema: meta.column(k) for k in range(meta.num_columns)}
    assert "DELTA_BINARY_PACKED" in by["doc_id"].encodings and "RLE_DICTIONARY" in by["ids.list.element"].encodings
    assert by["doc_id"].has_offset_index


# ---- 8 language ID


def test_language_on_held_out_rows(spark):
    rng = random.Random(6)
    parts = {"aa": ["thon", "ing", "the", "er", "wh", "ly"], "bb": ["keit", "ung", "der", "sch", "zu", "lich"], "cc": ["eaux", "ment", "les", "que", "oi", "tion"]}
    rows = [(k, " ".join("".join(rng.choices(parts[g], k=rng.randint(1, 3))) for _ in range(rng.randint(8, 60))), g) for k, g in enumerate(rng.choices([*parts], k=400))]
    rows += [(900, None, "aa"), (901, "", "bb"), (902, "123 !!", None), (903, "THON ING THE ERWH", None), (904, "the thon ering " * 60_000, "aa"), (None, "keitung derlich schzu ungsch lichkeit zuder keitsch ungder", None)]
    clashing = "lang_pred string, score double, h long, `all` long, held_out string"
    docs = spark.createDataFrame([(*r, "x", 0.5, 1, 2, "y") for r in rows], "doc_id long, text string, lang string, " + clashing)
    assert {k: len(v) <= 4096 for k, v in language.dictionaries(docs, language.Limits(docs=9, dictionary_bytes=4096)).items()} == dict.fromkeys(parts, True)
    out = {r["doc_id"]: r for r in language.held_out_prediction(docs).collect()}
    assert out[904]["lang_pred"] == "aa" and out.pop(None)["lang_pred"] == "bb"
    held = [(i, g) for i, _, g in rows[:400] if out[i]["held_out"]]
    assert sum(out[i]["lang_pred"] == g for i, g in held) / len(held) > 0.95
    assert [out[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3 and out[903]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in out.items())


# ---- 9 language-model scores


def test_base_scores_equal_brute_force(spark, awkward):
    got = {(r["doc_id"], r["n_tokens"]): r for r in lattice.held_out_scores(frame(spark, awkward), public_tokenizers.path("piece_bpe_32k.model")).collect()}
    tokens = lambda t: [*words(lower(t or "")), None]
    counts = Counter()
    for i, t in awkward:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    for i, t in awkward:
        r = got[i, len(tokens(t))]
        assert r["n_known"] == sum(counts[x] > 0 for x in tokens(t)) and r["train_tokens"] == total
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in tokens(t)), abs=1e-6)
        assert math.isfinite(r["score"]) and r["score"] < 0
    assert len({r["score"] for r in got.values()}) > 10


def by_segmentations(weights, word):
    """Marginal log10 probability of a word: a sum over all segmentations, from the left."""
    text, sums, byte = lattice.START + word, [1.0], lattice.BYTES_SHARE / 256
    for j in range(1, len(text) + 1):
        own = sum(sums[i] * weights[text[i:j]] for i in range(j) if text[i:j] in weights)
        sums.append(own + (0 if text[j - 1] in weights else sums[j - 1] * byte ** len(text[j - 1].encode())))
    return math.log10(sums[-1])


def test_lattice_sums_every_segmentation():
    weights = {"▁": 0.1, "▁a": 0.2, "a": 0.1, "b": 0.1, "ab": 0.2, "ba": 0.1, "▁ab": 0.05, "aba": 0.15}
    model = lattice.Lattice(weights)

    def brute(s):
        total = 0.0 if s else 1.0
        for k in range(1, len(s) + 1):
            if s[:k] in weights:
                total += weights[s[:k]] * brute(s[k:])
        return total + (math.exp(model.byte) ** len(s[0].encode()) * brute(s[1:]) if s and s[0] not in weights else 0)

    for word in ("abab", "baba", "a", "xé", "aXb"):
        assert model.log10([word])[0] == pytest.approx(math.log10(brute("▁" + word)))
        assert by_segmentations(weights, word) == pytest.approx(math.log10(brute("▁" + word)))
    counts = np.zeros(len(weights))
    model.expect(["abab" * 40], np.array([3.0]), counts)
    assert sum(len(k) * v for k, v in zip(weights, counts)) == pytest.approx(3 * 161)


def test_lattice_is_linear_in_long_words():
    weights = {"▁": 0.1, "a": 0.1, "b": 0.1, "ab": 0.2, "漢": 0.1, "bab": 0.05}
    model, rng = lattice.Lattice(weights), random.Random(5)
    for n in (199, 200, 201, 1000, 2500):
        word = "".join(rng.choices("abx漢é", k=n))
        assert model.log10([word])[0] == pytest.approx(model._forward(next(model._groups([lattice.START + word]))[1])[0][-1, 0] / math.log(10))
    assert math.isfinite(model.log10(["q漢" * 200_000])[0])
    assert math.isfinite(model.expect(["ab" * 300_000], np.array([1.0]), np.zeros(len(weights)))[0])


def test_scores_equal_sums_over_segmentations(spark, awkward):
    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = [*awkward, (None, "no id at all"), (500, "w" * 3000 + " and more")]
    counts = Counter()
    docs = [(i, lower(t or "").split() if t and t.isascii() else words(lower(t or ""))) for i, t in rows]
    train = [w for i, w in docs if zlib.crc32(str(i).encode()) % 5 != 1 or i is None]
    for w in train:
        counts.update(w)
    aside = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i, _ in rows], "doc_id long").selectExpr("doc_id", "pmod(xxhash64(doc_id, 'aside'), 10) = 0").collect()}
    table = [(w.encode(), sum(Counter(t)[w] for i, t in docs if (i is None or zlib.crc32(str(i).encode()) % 5 != 1) and not aside[i]), sum(Counter(t)[w] for i, t in docs if (i is None or zlib.crc32(str(i).encode()) % 5 != 1) and aside[i])) for w in {w for _, t in docs for w in t}]
    weights = lattice.trained(spark.createDataFrame(table, "word binary, n long, dev long"), lattice.pieces(path))
    end = (len(train) + 1) / (sum(counts.values()) + len(train) + 2)
    want = sorted((sum(by_segmentations(weights, w) if len(w) < 300 else lattice.Lattice(weights).log10([w])[0] for w in t) + len(t) * math.log10(1 - end) + math.log10(end) for _, t in docs))
    got = sorted(r["score"] for r in lattice.held_out_scores(frame(spark, rows), path).collect())
    assert got == pytest.approx(want, rel=1e-6)


def test_training_stops_when_kept_out_words_gain_no_more(spark):
    rng = random.Random(2)
    made = ["".join(rng.choices(["ka", "ri", "mo", "st"], k=3)) for _ in range(300)]
    words_ = spark.createDataFrame([(w.encode(), 5, k % 3) for k, w in enumerate(made)], "word binary, n long, dev long")
    start = {p: 1 / 40 for p in ["▁", *{c for w in made for c in w}, "ka", "ri", "mo", "st", "kari"]}
    scores = [lattice.expected(words_, lattice.trained(words_, start, rounds=k))[1] for k in range(5)]
    assert scores[1] > scores[0] and scores[2] >= scores[1] - 0.01 and scores[-1] >= max(scores) - lattice.GAIN


# ---- 10 shards


@pytest.mark.parametrize("n", [3, 403])
def test_shards_obey_the_law(spark, n):
    rows = [(k, "hot text" if k % 3 == 0 else f"text {k // 4}" if k % 2 else f"own {k}") for k in range(n - 2)] + [(9000, None), (9000, None)]
    out = shards.sharded(frame(spark, rows)).collect()
    assert len(out) == n
    sizes, texts = Counter(r["shard"] for r in out), dict(rows)
    assert max(sizes.values()) - (min(sizes.values()) if len(sizes) == 40 else 0) <= 1 and set(sizes) <= set(range(40))
    for s, size in sizes.items():
        assert sorted(r["slot"] for r in out if r["shard"] == s) == list(range(size))
    assert all(r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16 and r["text_crc32"] == zlib.crc32((texts[r["doc_id"]] or "").encode()) and r["grown_shard"] is None and r["law"] == "rows" for r in out)
    if n > 100:
        spread = defaultdict(set)
        for r in out:
            spread[texts[r["doc_id"]]].add(r["shard"])
        groups = [t for t, c in Counter(t for _, t in rows).items() if 2 <= c <= 5]
        assert sum(len(spread[t]) > 1 for t in groups) <= 40  # a cut for each border at most


def test_propagation_brings_groups_together(spark):
    rows = [(k, f"text {k // 5}" if k % 2 else f"own {k}") for k in range(4000)]
    dealt, moved = (shards.sharded(frame(spark, rows), rounds=n) for n in (0, shards.ROUNDS))
    groups = len({t for t, c in Counter(t for _, t in rows).items() if c > 1})
    assert shards.cut_groups(dealt) > 0.8 * groups and shards.cut_groups(moved) <= 40


def test_ranks_are_gapless(spark):
    df = spark.range(1000).selectExpr("id", "(id * 7919) % 50 k")
    got = ranked(df, [df["k"].desc(), df["id"]], "test").collect()
    want = sorted(((r["k"], r["id"]) for r in got), key=lambda x: (-x[0], x[1]))
    assert [(r["k"], r["id"]) for r in sorted(got, key=lambda r: r["rank"])] == want and {r["rank"] for r in got} == set(range(1000))


# ---- empty tables


def test_empty_tables(spark):
    docs, items = frame(spark, []), spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    piece, word = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("word_bpe_49k.json")
    for out in (
        bpe.digest(docs, bpe.ranks(BPE), public_tokenizers.PATTERN),
        simhash.digest(docs),
        resample.resampled(docs, labels),
        substring.digest(docs),
        decontaminate.digest(docs, items),
        quality.judged(docs),
        token_files.written_and_read(docs, word),
        language.held_out_prediction(docs),
        lattice.held_out_scores(docs, piece),
        shards.sharded(docs),
    ):
        assert out.count() == 0
    assert decontaminate.digest(frame(spark, [(1, "a b")]), items).first()["n_hit"] == 0
