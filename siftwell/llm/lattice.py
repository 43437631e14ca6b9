"""Language-model scores from a subword lattice.

The vocabulary of an existing unigram or BPE model gives pieces and scores. All segmentations of a word into pieces (a word-start
mark before it, bytes as a last resort) are weighted by the pieces' probabilities; a forward recursion in log space gives
the word's marginal probability. Pieces never reach over white space, so a document's probability is the product of its
words' marginals and of an end. The vocabulary's scores start the weights; each round re-estimates them from expected
piece counts over the words of all training documents (a forward-backward pass), so the model follows the corpus. A tenth of the
training documents is kept out of the counts and tells when to stop: when its score per word no longer rises by ``GAIN``.

Words of one length run through the recursion side by side as arrays: a step is one piece length at one place of all of
them. Pieces are found by 64-bit hashes, which are checked to be distinct among the pieces.

Spark counts each chunk's words and deals them by word: each distinct word is counted, segmented and scored once,
and its scores return by chunk (see ``dictionary``). What is collected is the vocabulary's size: one expected count per piece.

Defined results: a null or empty text has the end alone; repeated rows all count; null ids fall to bucket 0; words without any
piece fall to bytes, so every score is finite; a word of any length takes time and memory in proportion to it; with no training rows
the starting weights hold; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionary
from .common import gathered, id_bucket, in_tasks, written

START = "▁"
#: Weight of the starting probabilities in the re-estimate, in tokens.
PRIOR = 1000.0
#: Share of the probability that byte pieces get besides what they are counted.
BYTES_SHARE = 1e-4
#: Most rounds of re-estimation, and the least gain in log10 per word of the kept-out tenth for another one.
ROUNDS, GAIN = 6, 0.02
#: Words taken through the recursion at once, and the most characters of all of them.
AT_ONCE, CHARACTERS = 100_000, 400_000
#: Longer words go through the recursion alone, in steps of so many characters that hand their sums on.
STRETCH = 2_000

_U = np.uint64
_FACTOR = _U(0x9E3779B97F4A7C15)


def pieces(path: str) -> dict[str, float]:
    """Piece to starting probability. Scores of merge ranks (0, -1, -2, ...) weigh as 1 / (rank + 10), others as exp(score)."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = {model.id_to_piece(k): model.get_score(k) for k in range(model.vocab_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k) or model.is_unused(k))}
    scores = {k: v for k, v in scores.items() if v > -1e8}
    ranked = all(v == round(v) for v in scores.values())
    weight = {k: 1 / (10 - v) if ranked else math.exp(v) for k, v in scores.items()}
    total = sum(weight.values())
    return {k: v / total for k, v in weight.items()}


def _key(sums: np.ndarray, length: int) -> np.ndarray:
    x = (sums + _U(length)) * _FACTOR
    x ^= x >> _U(29)
    return x * _U(0xD6E8FEB86659FD93)


class Lattice:
    """Forward and backward log sums over words' segmentations."""

    def __init__(self, weights: dict[str, float]):
        names = list(weights)
        self.logs = np.log(np.fromiter(weights.values(), np.float64, len(names)))
        self.longest = max(map(len, names), default=1)
        self.byte = math.log(BYTES_SHARE / 256)
        keys = np.array([self._key_of(p) for p in names], np.uint64)
        order = np.argsort(keys)
        self.keys, self.which = keys[order], order
        if (self.keys[1:] == self.keys[:-1]).any():
            raise ValueError("two pieces have the same hash")
        self.there = np.zeros(1 << 20, bool)  # most hashes are of no piece and stop here
        self.there[(self.keys >> _U(44)).astype(np.int64)] = True

    def _key_of(self, piece: str) -> int:
        sums = np.zeros(1, np.uint64)
        for c in piece:
            sums = sums * _FACTOR + _U(ord(c))
        return int(_key(sums, len(piece))[0])

    def _found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``keys`` that are pieces, and which pieces."""
        rows = np.flatnonzero(self.there[(keys >> _U(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.keys, keys[rows]), len(self.keys) - 1)
        right = self.keys[at] == keys[rows] if len(self.keys) else np.zeros(len(rows), bool)
        return rows[right], self.which[at[right]]

    def _arcs(self, codes: np.ndarray, i: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces that start at place i of words (rows of ``codes``): (end, rows, pieces or -1 for bytes, log probabilities)."""
        sums = np.zeros(len(codes), np.uint64)
        for j in range(i + 1, min(codes.shape[1], i + self.longest) + 1):
            sums = sums * _FACTOR + codes[:, j - 1]
            rows, which = self._found(_key(sums, j - i))
            logs = self.logs[which]
            if j == i + 1 and len(rows) < len(codes):  # bytes where no single character fits
                rest = np.ones(len(codes), bool)
                rest[rows] = False
                c = codes[rest, i].astype(np.int64)
                rows = np.concatenate([rows, np.flatnonzero(rest)])
                which = np.concatenate([which, np.full(len(c), -1)])
                logs = np.concatenate([logs, self.byte * (1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000))])
            if len(rows):
                yield j, rows, which, logs

    def _groups(self, words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Words (with their mark) of one length: which they are, and their characters."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lengths, kind="stable")
        for same in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1) if len(words) else []:
            n = int(lengths[same[0]])
            step = max(1, CHARACTERS // n)
            for k in range(0, len(same), step):
                part = same[k : k + step]
                text = "".join([words[w] for w in part.tolist()])
                yield part, np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64).reshape(len(part), n)

    def _forward(self, codes: np.ndarray) -> tuple[np.ndarray, list]:
        """Log sums of the segmentations that reach each place, and the arcs from each place."""
        m, n = codes.shape
        sums = np.full((n + 1, m), -np.inf)
        sums[0] = 0.0
        arcs = []
        for i in range(n):
            arcs.append(list(self._arcs(codes, i)))
            for j, rows, _, logs in arcs[-1]:
                sums[j, rows] = np.logaddexp(sums[j, rows], sums[i, rows] + logs)
        return sums, arcs

    def log10(self, words: list[str]) -> np.ndarray:
        """Marginal probability of each word."""
        out, words = np.empty(len(words)), [START + w for w in words]
        for part, codes in self._groups(words):
            if len(codes) == 1 and codes.shape[1] > 200:
                out[part] = self._long_sums(words[part[0]])[-1]
            else:
                out[part] = self._forward(codes)[0][-1]
        return out / math.log(10)

    def _long_arcs(self, text: str, start: int) -> list[list[tuple[int, float, int]]]:
        """Pieces (length, log probability, which or -1 for bytes) from each place of one stretch of a long word, whatever follows the stretch."""
        codes = np.frombuffer(text[start : start + STRETCH + self.longest].encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        steps = min(STRETCH, len(text) - start)
        arcs: list[list[tuple[int, float, int]]] = [[] for _ in range(steps)]
        keys = np.zeros(len(codes), np.uint64)
        for length in range(1, min(self.longest, len(codes)) + 1):  # all places side by side
            keys = keys[: len(codes) - length + 1] * _FACTOR + codes[length - 1 :]
            rows, which = self._found(_key(keys[:steps], length))
            for at, log, piece in zip(rows.tolist(), self.logs[which].tolist(), which.tolist(), strict=True):
                arcs[at].append((length, log, piece))
        for at in range(steps):
            if not arcs[at] or arcs[at][0][0] != 1:
                arcs[at].insert(0, (1, self.byte * len(chr(int(codes[at])).encode("utf-8", "surrogatepass")), -1))
        return arcs

    def _long_sums(self, text: str) -> np.ndarray:
        """As ``_forward`` for one long word: the log sum at each of its places, eight bytes a character."""
        sums = np.full(len(text) + 1, -np.inf)
        sums[0] = 0.0
        for start in range(0, len(text), STRETCH):
            for at, arcs in enumerate(self._long_arcs(text, start), start):
                for length, log, _ in arcs:
                    sums[at + length] = _log_added(sums[at + length], sums[at] + log)
        return sums

    def _long_expected(self, text: str, times: float, counts: np.ndarray) -> float:
        """Adds the expected pieces of one long word, stretch by stretch from its end; its log probability."""
        forward = self._long_sums(text)
        backward = np.full(len(text) + 1, -np.inf)
        backward[-1] = 0.0
        for start in range((len(text) - 1) // STRETCH * STRETCH, -1, -STRETCH):
            arcs = self._long_arcs(text, start)
            for at in range(len(arcs) - 1, -1, -1):
                place = start + at
                for length, log, which in arcs[at]:
                    after = log + backward[place + length]
                    backward[place] = _log_added(backward[place], after)
                    if which >= 0:
                        counts[which] += times * math.exp(forward[place] + after - forward[-1])
        return float(forward[-1])

    def expect(self, words: list[str], times: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Adds the expected number of each piece in ``times`` occurrences of each word; the words' log10 probabilities."""
        out, marked = np.zeros(len(words)), [START + w for w in words]
        long = [k for k, w in enumerate(marked) if len(w) > STRETCH]
        for k in long:
            out[k] = self._long_expected(marked[k], float(times[k]), counts) / math.log(10)
        of = np.setdiff1d(np.arange(len(words)), long)
        for part, codes in self._groups([marked[k] for k in of.tolist()]):
            forward, arcs = self._forward(codes)
            out[of[part]] = forward[-1] / math.log(10)
            some = times[of[part]]
            backward = np.full(forward.shape, -np.inf)
            backward[-1] = 0.0
            for i in range(len(arcs) - 1, -1, -1):
                for j, rows, which, logs in arcs[i]:
                    after = logs + backward[j, rows]
                    backward[i, rows] = np.logaddexp(backward[i, rows], after)
                    real = which >= 0
                    n = some[rows] * np.exp(forward[i, rows] + after - forward[-1, rows])
                    counts += np.bincount(which[real], weights=n[real], minlength=len(counts))
        return out


def _log_added(a: float, b: float) -> float:
    high, low = (a, b) if a > b else (b, a)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def _split() -> dictionary.Split:
    return (lambda text: text.lower().split()), (lambda word: [word])


def _words(column: pa.Array) -> list[str]:
    return [w.decode("utf-8", "replace") for w in column.to_pylist()]


def expected(words: DataFrame, weights: dict[str, float]) -> tuple[dict[str, float], float]:
    """Expected piece counts over ``words`` (word, n, dev), and log10 probability per word of those that ``dev`` counts."""
    shared = words.sparkSession.sparkContext.broadcast(weights)

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = list(shared.value)
        lattice, counts, dev, score = Lattice(shared.value), np.zeros(len(names)), 0, 0.0
        for batch in gathered(batches, AT_ONCE):
            n, aside = (batch.column(k).to_numpy() for k in (1, 2))
            logs = lattice.expect(_words(batch.column(0)), n.astype(np.float64), counts)
            dev += int(aside.sum())
            score += float(logs @ aside)
        # no piece has white space
        yield pa.record_batch([pa.array([*names, "\n dev", "\n score"], pa.string()), pa.array([*counts, dev, score], pa.float64())], names=["piece", "n"])

    rows = words.where("n > 0 or dev > 0").select("word", "n", "dev").transform(in_tasks, expect, "piece string, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
    counts = {r["piece"]: r["n"] for r in rows}
    dev, score = counts.pop("\n dev", 0.0), counts.pop("\n score", 0.0)
    return counts, score / dev if dev else 0.0


def trained(words: DataFrame, start: dict[str, float], rounds: int = ROUNDS, gain: float = GAIN) -> dict[str, float]:
    """Piece probabilities re-estimated from ``words`` (word, n, dev) until the words of ``dev`` gain too little."""
    weights, best, last = start, start, -math.inf
    for _ in range(rounds):
        counts, score = expected(words, weights)
        if score <= last:
            return best
        best = weights
        mass = sum(counts.values()) + PRIOR
        weights = {k: (1 - BYTES_SHARE) * (counts.get(k, 0.0) + PRIOR * p) / mass for k, p in start.items()}
        if score - last < gain:
            break
        last = score
    return weights


def scored(docs: DataFrame, train: Column, model: str) -> DataFrame:
    """``doc_id, n_tokens, n_known, train_tokens, base_score, score`` per row; documents where ``train`` holds are learnt from."""
    aside = F.pmod(F.xxhash64("doc_id", F.lit("aside")), F.lit(10)) == 0
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train")).select("doc_id", "text", F.when(~F.col("train"), 0).when(aside, 2).otherwise(1).alias("class"))
    vocabulary, streams = dictionary.both(docs, _split, 2)
    words = written(vocabulary.groupBy("word").agg(F.sum("n1").alias("n"), F.sum("n2").alias("dev")), "words")
    counted = F.col("n") + F.col("dev")
    sums = words.agg(F.sum(counted).alias("n"), F.count(F.when(counted > 0, 1)).alias("distinct")).first()
    ends = docs.where("class > 0").count()
    in_words = sums["n"] or 0
    tokens, distinct = in_words + ends, sums["distinct"] + (ends > 0)
    weights = trained(words, pieces(model))
    # of a document's steps, each a word or the end, so many are ends
    end = (ends + 1) / (in_words + ends + 2)
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(shared.value)
        for batch in gathered(batches, AT_ONCE):
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(lattice.log10(_words(batch.column(0))))], names=["word", "n", "log10"])

    valued = words.select("word", counted.alias("n")).transform(in_tasks, score, "word binary, n long, log10 double")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.empty((batch.num_rows, 2), np.float64)
            pairs[:, 0], pairs[:, 1] = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            yield dictionary.packed(batch.column(0).to_numpy(), batch.column(1).to_numpy(), np.full(batch.num_rows, 2), pairs.ravel())

    found = vocabulary.select("word", "chunk", "at").join(valued, "word").select("chunk", "at", "n", "log10").transform(in_tasks, pack, dictionary.PACKED)
    total = math.log10(tokens + 0.5 * (distinct + 1))

    def finish(doc_ids: list, lengths: np.ndarray, numbers: np.ndarray, starts: np.ndarray, values: np.ndarray) -> pa.Table:
        n, logs = values[0::2], values[1::2]
        base, known = np.log10(n + 0.5), n > 0
        doc = np.repeat(np.arange(len(lengths)), lengths)

        def by_doc(x: np.ndarray) -> np.ndarray:
            return np.bincount(doc, weights=x[numbers], minlength=len(lengths))

        base_score = by_doc(base) + math.log10(ends + 0.5) - (lengths + 1) * total
        score_ = by_doc(logs) + lengths * math.log10(1 - end) + math.log10(end)
        n_known = by_doc(known.astype(np.float64)).astype(np.int64) + (ends > 0)
        return pa.table([pa.array(doc_ids, pa.int64()), pa.array(lengths + 1), pa.array(n_known), pa.array(base_score), pa.array(score_)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    out = dictionary.reassembled(streams, found, "<f8", finish, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.withColumn("train_tokens", F.lit(tokens).cast("long"))


def held_out_scores(docs: DataFrame, model: str) -> DataFrame:
    """Learns from ids outside crc32 bucket 1 of 5 and scores every row."""
    out = id_bucket(5) == 1
    return scored(docs, ~out, model).withColumn("held_out", out)
