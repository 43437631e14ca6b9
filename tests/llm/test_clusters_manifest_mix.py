"""Operators 11 to 13 against brute force on awkward rows, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from siftwell.llm import centroids, merkle, mixing

from .conftest import frame


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


# ---- 11 centroid clustering


def brute_clusters(rows, clusters=16, rounds=3):
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    first = sorted((sha(f"1:{'' if i is None else i}"), x) for i, x in kept)[:clusters]
    centres = [x for _, x in first]
    square = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c))
    nearest = lambda x: min((square(x, c), k) for k, c in enumerate(centres))
    for _ in range(rounds):
        of = [nearest(x)[1] for _, x in kept]
        new = list(centres)
        for k in range(len(centres)):
            if own := [x for (_, x), c in zip(kept, of) if c == k]:
                new[k] = [sum(col) // len(own) for col in zip(*own)]
        centres = new
    found = [(i, *nearest(x)) for i, x in kept]
    sums = Counter()
    for _, d, k in found:
        sums[k] += d
    return sorted(((i, k, d, sums[k], sum(sums.values()), sha(",".join(map(str, centres[k])))) for i, d, k in found), key=str)


COLUMNS = ("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
VECTORS = "vec_id long, embedding array<float>, x string, cluster string, upper string, of string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", "b", "c", "d") for i, v in rows], VECTORS)


@pytest.fixture(scope="module")
def awkward_vectors():
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 1, (9, 64)).astype(np.float32)
    rows = [(k, (middle[k % 9] + rng.normal(0, 0.2 if k % 3 else 1, 64)).astype(np.float32).tolist()) for k in range(400)]
    same = rows[7][1]
    rows += [(1000 + k, same) for k in range(200)] + [(5, rows[5][1])] * 3 + [(None, rows[9][1]), (None, rows[10][1])]  # a third copies; repeated rows; null ids
    rows += [(2000, None), (2001, []), (2002, same[:63]), (2003, [*same, 0.0]), (2004, [None, *same[1:]]), (2005, [float("nan"), *same[1:]]), (2006, [*same[:-1], float("-inf")])]
    return rows + [(2007, [-0.01] * 64), (2008, [1000.0] * 64), (2009, [0.0] * 64)]


def test_clusters_equal_brute_force(spark, awkward_vectors):
    got = centroids.digest(vectors(spark, awkward_vectors).repartition(3))
    assert rows_of(got, *COLUMNS) == brute_clusters(awkward_vectors)


def test_bounds_spare_most_of_the_scans(spark):
    rng = np.random.default_rng(2)
    middle = rng.normal(0, 2, (16, 64))
    rows = [(k, (middle[k % 16] + rng.normal(0, 0.3, 64)).tolist()) for k in range(800)]
    found, centres = centroids.clustered(vectors(spark, rows), rounds=6)
    scans = [r["scans"] for r in found.collect()]
    assert len(centres) == 16 and min(scans) == 16 and sum(scans) < 0.35 * 7 * 16 * len(scans)


def test_few_equal_and_no_vectors(spark):
    three = [(k, [0.5] * 64) for k in range(3)]
    for rows in (three, three[:1], [(1, None)], []):
        assert rows_of(centroids.digest(vectors(spark, rows)), *COLUMNS) == brute_clusters(rows)
    got = centroids.digest(vectors(spark, []))
    assert [c for c in COLUMNS if c in got.columns] == list(COLUMNS)


def test_too_large_components_are_named(spark):
    with pytest.raises(Exception, match="would not fit a long"):
        centroids.digest(vectors(spark, [(1, [3e38] * 64)])).collect()


def test_loosened_bounds_hold_and_are_tighter_than_drift():
    """No point of a sphere comes nearer to a moved centroid by more than the bound; the bounds are below the full drift."""
    rng = np.random.default_rng(8)
    less = full = 0.0
    for _ in range(300):
        old = rng.integers(-60, 60, (4, 64))
        new = old + rng.integers(-9, 10, (4, 64)) * rng.integers(0, 2, (4, 1))
        radius = rng.uniform(0, 120, 4)
        bound = centroids.loosened(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        for a in range(4):
            others = [b for b in range(4) if b != a]
            away = rng.normal(0, 1, (40, 64))
            toward = [(new[b] - old[b]) for b in others if drift[b]]
            away = np.vstack([away, *toward, *(old[b] - old[a] for b in others)]) if toward else away
            points = old[a] + radius[a] * away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), 1e-9)
            for b in others:
                taken = np.linalg.norm(points - old[b], axis=1) - np.linalg.norm(points - new[b], axis=1)
                assert taken.max() <= bound[a, b] + 1e-9
                assert bound[a, b] <= drift[b] * (1 + 1e-9)
                less, full = less + bound[a, b], full + drift[b]
    assert less < 0.7 * full


# ---- 12 Merkle manifest


def tree(level):
    """All levels of a tree over digests."""
    out = [level]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 2])) for k in range(0, len(out[-1]), 2)])
    return out


def brute_leaf(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def brute_manifest(rows):
    """Rows of (doc_id, source, lang, n_chars, text)."""
    of = defaultdict(list)
    for r in rows:
        of[r[2]].append((r[0] is not None, r[0] or 0, brute_leaf(*r), r))
    order = sorted(of, key=lambda lang: (lang is not None, (lang or "").encode()))
    trees = {lang: tree([leaf for *_, leaf, _ in sorted(of[lang], key=lambda x: x[:3])]) for lang in order}
    over = tree([trees[lang][-1][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        for rank, (*_, leaf, r) in enumerate(sorted(of[lang], key=lambda x: x[:3])):
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            at = brute_leaf(r[0], r[1], r[2], r[3] + 1, r[4]) if bad else leaf
            proof = []
            for levels, k in ((trees[lang], rank), (over, place)):
                for level in levels[:-1]:
                    other = level[k ^ 1 : (k ^ 1) + 1]
                    proof += other
                    at = sha("".join([*other, at] if k & 1 else [at, *other]))
                    k >>= 1
            out.append((r[0], leaf, trees[lang][-1][0], over[-1][0], sha("".join(proof)), at, at == over[-1][0]))
    return sorted(out, key=str)


MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
DOCS = "doc_id long, source string, lang string, n_chars long, text string, rank string, tree string, n string, at string, name string, path string"


def manifest_frame(spark, rows):
    return spark.createDataFrame([(*r, *"uvwxyz") for r in rows], DOCS)


def awkward_documents(n, hot):
    rng = random.Random(9)
    rows = [(k * 3, rng.choice(["a", None, "ü"]), rng.choice([None, "", "de", "fr", "zz", "é"]), rng.choice([None, k]), rng.choice([None, "", "x y", "漢字 " * 9])) for k in range(n)]
    rows += [(10_000 + k, "s", "en", 3, "hot") for k in range(hot)]  # most rows in one language
    return rows + [(6, "s", "en", 1, "twice")] * 5 + [(None, None, None, None, None), (None, "s", "en", 2, "no id"), (None, "s", "en", 2, "no id"), (77, "s", "lone", 1, "alone")]


def test_manifest_equals_brute_force(spark):
    rows = awkward_documents(200, 700)
    random.Random(1).shuffle(rows)
    want = brute_manifest(rows)
    got = rows_of(merkle.digest(manifest_frame(spark, rows).repartition(5)), *MANIFEST)
    assert got == want
    assert 0 < sum(not r[-1] for r in got) < len(got) / 3


def test_manifest_of_several_buckets_of_levels(spark, monkeypatch):
    """Chunks of eight entries: trees of one to three buckets, which the join by interval must walk down."""
    monkeypatch.setattr(merkle, "LEVELS", 3)
    rows = awkward_documents(40, 130)
    assert rows_of(merkle.digest(manifest_frame(spark, rows)), *MANIFEST) == brute_manifest(rows)


def test_manifest_nodes_cover_their_leaves(spark):
    rows = [r for r in awkward_documents(90, 600) if r[2] == "en"]
    level = {r["level"] for r in merkle.nodes(manifest_frame(spark, rows)).collect()}
    got = rows_of(merkle.nodes(manifest_frame(spark, rows)), "lang", "level", "lo", "hi", "digest")
    leaves = [leaf for *_, leaf in sorted((r[0] is not None, r[0] or 0, brute_leaf(*r)) for r in rows)]
    want = [("en", j, k << j, min(k + 1 << j, len(leaves)), d) for j, nodes in enumerate(tree(leaves)) for k, d in enumerate(nodes)]
    assert got == sorted(want, key=str) and max(level) == 10


def test_manifest_of_one_row_and_none(spark):
    one = [(14, "s", "en", 4, "text")]
    assert rows_of(merkle.digest(manifest_frame(spark, one)), *MANIFEST) == brute_manifest(one)
    assert merkle.digest(manifest_frame(spark, [])).collect() == []


# ---- 13 mixing


def brute_targets(sizes, budget):
    """Level by level: shares of what is left, capped ones out of the sharing."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: k % 3 + 1 for k, s in enumerate(order)}
    capped = set()
    while True:
        left, total = budget - sum(3 * sizes[s] for s in capped), sum(weight[s] for s in order if s not in capped)
        new = {s for s in order if s not in capped and left * weight[s] >= 3 * sizes[s] * total}
        if not new:
            return {s: float(3 * sizes[s]) if s in capped else left * weight[s] / total for s in order}
        capped |= new


def brute_mix(rows):
    docs = [(i, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, s, t in rows]
    sizes = Counter()
    for _, s, n in docs:
        sizes[s] += n
    target = brute_targets(sizes, sum(sizes.values()))
    out = []
    for s in sizes:
        line = sorted((int(sha(f"mix:{'' if i is None else i}")[:15], 16), i is not None, i or 0, n) for i, x, n in docs if x == s)
        at, left = 0, int(target[s])
        for _, known, i, n in line:
            taken = sum(max(0, min(n, left - at - k * sizes[s])) for k in range(3))
            out.append((i if known else None, n, sizes[s], target[s], taken))
            at += n
    return sorted(out, key=str)


MIX = ("doc_id", "size", "source_size", "target", "taken")


def mix_frame(spark, rows):
    full = [(i, t, s, *"abcdefg") for i, s, t in rows]
    return spark.createDataFrame(full, "doc_id long, text string, source string, size string, part string, row string, weight string, `last` string, target string, upto string")


def awkward_sources():
    rng = random.Random(6)
    rows = [(k, f"s{k % 11:02}", "w " * rng.randint(0, 60)) for k in range(300)]
    rows += [(1000 + k, "hot", "a b c " * 20) for k in range(150)]  # a third of all words and copies of one text
    rows += [(2000, None, "no source here"), (2001, None, None), (2002, "", "empty name of a source"), (2003, "silent", ""), (2004, "silent", None), (2005, "tiny", "one")]
    return rows + [(7, "s07", "again and again")] * 4 + [(None, "s01", "no id"), (3000, "s03", "long " * 5000), (2999, "é", "x y z\x0bq")]


def test_mix_equals_brute_force(spark):
    rows = awkward_sources()
    got = rows_of(mixing.digest(mix_frame(spark, rows).repartition(6)), *MIX)
    assert got == brute_mix(rows)
    assert all(taken <= 3 * size for _, size, _, _, taken in got) and any(taken > 2 * size > 0 for _, size, _, _, taken in got)


def test_mix_meets_its_targets_and_reruns_agree(spark):
    docs = mix_frame(spark, awkward_sources())
    first = rows_of(mixing.digest(docs.repartition(2)), *MIX)
    assert first == rows_of(mixing.digest(docs.repartition(7, "size")), *MIX)
    taken, target = Counter(), {}
    for r in mixing.mixed(docs).groupBy("source").sum("words").collect():
        taken[r["source"]] = r["sum(words)"]
    sizes = Counter()
    for _, s, t in awkward_sources():
        sizes[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    target = brute_targets(sizes, sum(sizes.values()))
    assert all(abs(taken[s] - target[s]) < 1 for s in target)


def test_mix_is_one_line_of_copies_served_fairly(spark):
    rows = mixing.mixed(mix_frame(spark, awkward_sources())).orderBy("start").collect()
    at = 0
    for r in rows:
        assert r["start"] == at
        at += r["words"]
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows) and max(r["finish"] for r in rows) <= 1.0


def test_mix_stops_at_a_smaller_budget(spark):
    rows = mixing.mixed(mix_frame(spark, awkward_sources()), budget=1000).collect()
    assert 980 < sum(r["words"] for r in rows) <= 1000
    full = mixing.mixed(mix_frame(spark, awkward_sources()), budget=10**9).groupBy("row").count().collect()
    assert {r["count"] for r in full} == {3}  # all that there is, as often as is allowed


def test_mix_of_nothing(spark, awkward):
    assert mixing.digest(mix_frame(spark, [])).collect() == []
    assert rows_of(mixing.digest(mix_frame(spark, [(1, "s", None), (2, None, " ")])), *MIX) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    assert mixing.digest(frame(spark, awkward)).count() == len(awkward)
