"""Toxicity: a linear-chain conditional random field tags toxic words.

Labels are given for documents, so words are labelled first: among the toxic documents of a bounded
sample, a greedy cover picks the words and word stems that occur in most toxic documents not yet
covered and hardly in others; their occurrences in toxic documents are the toxic tokens, all else is
clean. The field has two states; its features are the word, its stems, the word before, and the
transitions. Forward-backward
gives every word's marginal; a document's score is a calibrated function of the largest and of the
sum of its marginals, and the words with a marginal of at least one half are its offending spans
(byte offsets).

Null and empty texts have no words and get the score of such a document: the calibration's lowest.
Every row is scored by its text alone, so repeated rows, ties and null ids change nothing. Without
labelled rows of both classes nothing is learned and every score is 0.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, read
from .learn import adam, labelled_sample, logistic, remainder, sigmoid

#: Bounds of the sample that is learned from: documents of each class, characters of each, words and stems with a weight of their own.
PER_CLASS, MAX_CHARS, MAX_FORMS = 600, 12_000, 100_000
#: Lengths of the word beginnings that are features, and the fewest toxic documents that a cover word marks anew.
STEMS, LEAST = (4, 5), 3
#: Toxic from this score on; a word is offending from this marginal on; share of other documents a cover word may occur in,
#: relative to toxic ones; steps and rate of the fit; tokens of a block in the forward-backward scan.
REJECT, OFFENDING, IMPURE, STEPS, RATE, BLOCK = 0.7, 0.5, 0.02, 40, 0.3, 64
#: Fixed rule: ASCII other than letters, digits and ' separates words; A-Z become a-z.
SEPARATE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 0x80 or 48 <= b <= 57 or 97 <= b <= 122 or b == 39 else 32 for b in range(256))


def scan(m: np.ndarray, head: np.ndarray) -> np.ndarray:
    """Running products of a row vector with 2x2 matrices (n, 2, 2), each scaled: out[i] ~ head @ m[0] @ ... @ m[i].
    The chain is cut into blocks: the blocks' products are made side by side, their chain is scanned in the
    same way, which gives each block's head, and all blocks are then run side by side from their heads."""
    n = len(m)
    if n <= 4 * BLOCK:
        out = np.empty((n, 2))
        for i in range(n):
            head = head @ m[i]
            head = head / head.max()
            out[i] = head
        return out
    rows = -(-n // BLOCK)
    parts = np.concatenate([m, np.broadcast_to(np.eye(2), (rows * BLOCK - n, 2, 2))]).reshape(rows, BLOCK, 4).transpose(1, 2, 0).copy()
    a, b, c, d = parts[0]
    for i in range(1, BLOCK):
        e, f, g, h = parts[i]
        a, b, c, d = a * e + b * g, a * f + b * h, c * e + d * g, c * f + d * h
        top = np.maximum(np.maximum(a, b), np.maximum(c, d))
        a, b, c, d = a / top, b / top, c / top, d / top
    ends = scan(np.stack([a, b, c, d], 1).reshape(rows, 2, 2), head)
    x, y = np.concatenate([head[None], ends[:-1]]).T
    out = np.empty((BLOCK, rows, 2))
    for i in range(BLOCK):
        e, f, g, h = parts[i]
        x, y = x * e + y * g, x * f + y * h
        top = np.maximum(x, y)
        x, y = x / top, y / top
        out[i, :, 0], out[i, :, 1] = x, y
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


def forward_backward(score: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, pairs: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of state 1 for tokens with log odds `score`, and with `pairs` pair marginals P(previous a, this b) for tokens
    that are no `first` of their document. trans: log weights (2, 2); start: log weights (2)."""
    n = len(score)
    emit = np.exp(np.column_stack([np.minimum(-score, 0), np.minimum(score, 0)]).clip(-60, 0))
    step = np.exp(trans)[None] * emit[:, None, :]
    fresh = np.exp(start)[None] * emit
    forward = np.where(first[:, None, None], fresh[:, None, :], step)  # a document's first token forgets what came before
    alpha = scan(forward, np.array([1.0, 0.0]))
    last = np.concatenate([first[1:], [True]])
    back = np.where(last[:, None, None], 1.0, np.concatenate([step[1:], np.ones((1, 2, 2))]).transpose(0, 2, 1))
    beta = scan(back[::-1], np.ones(2))[::-1]
    both = alpha * beta
    marginal = both[:, 1] / both.sum(1)
    pair = np.zeros((n if pairs else 0, 2, 2))
    if n > 1 and pairs:
        pair[1:] = alpha[:-1, :, None] * step[1:] * beta[1:, None, :]
        pair[first] = 0
        pair /= np.maximum(pair.sum((1, 2), keepdims=True), 1e-300)
    return marginal, pair


def tokens(texts: list[bytes]) -> tuple[list[list[bytes]], np.ndarray]:
    found = [t.translate(SEPARATE).split() for t in texts]
    return found, np.array([len(f) for f in found], np.int64)


def forms(word: bytes) -> tuple[bytes, ...]:
    """A word and its beginnings, which stand for all words built on one stem."""
    return (word, *(word[:n] + b"*" for n in STEMS if len(word) >= n))


def cover(docs: list[set[bytes]], toxic: np.ndarray) -> set[bytes]:
    """Words and stems that together mark the toxic documents: the one that marks most of those left is
    picked again and again, as long as it is pure and marks enough of them."""
    clean: dict[bytes, int] = {}
    holders: dict[bytes, set[int]] = {}
    for i, found in enumerate(docs):
        for w in {f for word in found for f in forms(word)}:
            if toxic[i]:
                holders.setdefault(w, set()).add(i)
            else:
                clean[w] = clean.get(w, 0) + 1
    n_toxic, n_clean = max(1, int(toxic.sum())), max(1, int((~toxic).sum()))
    left, picked = {i for i in range(len(docs)) if toxic[i]}, set()
    least = max(LEAST, n_toxic // 50)
    pure = {w: h for w, h in holders.items() if len(h) >= least and clean.get(w, 0) / n_clean <= IMPURE * len(h) / n_toxic}
    while left and pure:
        best = max(pure, key=lambda w: (len(pure[w] & left), -len(w), w))
        if len(pure[best] & left) < least:
            break
        picked.add(best)
        left -= pure.pop(best)
    # Documents hold several marks: of the rest, words as common as the rarest one picked are marks as well.
    enough = max(least, min((len(holders[w]) for w in picked), default=0))
    return picked | {w for w, h in pure.items() if picked and len(h) >= enough}


class Tagger:
    """The fitted field and the calibration of its document scores."""

    def __init__(self, texts: list[bytes], toxic: np.ndarray) -> None:
        found, sizes = tokens(texts)
        marks = cover([set(f) for f in found], toxic)
        count: dict[bytes, int] = {}
        for f in found:
            for w in f:
                count[w] = count.get(w, 0) + 1
        held: dict[bytes, int] = {}
        for w, c in count.items():
            for x in forms(w):
                held[x] = held.get(x, 0) + c
        kept = sorted((w for w, c in held.items() if c >= 3), key=lambda w: (w not in marks, -held[w], w))[:MAX_FORMS]
        ids = {w: i for i, w in enumerate(kept, 1)}
        size = len(kept) + 1
        words = list(count)
        number = {w: i for i, w in enumerate(words)}
        bad = np.array([any(x in marks for x in forms(w)) for w in words], bool)
        table = np.zeros((len(words), 1 + len(STEMS)), np.int64)
        for i, w in enumerate(words):
            own = [ids.get(x, 0) for x in forms(w)]
            table[i, :len(own)] = own
        at = np.fromiter((number[w] for f in found for w in f), np.int64, int(sizes.sum()))
        first = np.zeros(len(at), bool)
        first[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        gold = (bad[at] & np.repeat(toxic, sizes)).astype(float)
        was = np.concatenate([[0.0], gold[:-1]])
        pairs = np.array([[np.sum(~first & (was == a) & (gold == b)) for b in (0, 1)] for a in (0, 1)], float)
        parts, before = [table[at, j] for j in range(table.shape[1])], np.where(first, 0, np.concatenate([[0], table[at[:-1], 0]]))

        def gradient(w: np.ndarray) -> np.ndarray:
            odds = sum(w[p] for p in parts) + w[size + before] + w[2 * size]
            marginal, pair = forward_backward(odds, first, w[2 * size + 1:2 * size + 5].reshape(2, 2), w[2 * size + 5:], True)
            miss = marginal - gold
            g = np.concatenate([sum(np.bincount(p, miss, size) for p in parts), np.bincount(before, miss, size), [miss.sum()],
                                (pair.sum(0) - pairs).ravel(), [-miss[first].sum(), miss[first].sum()]])
            return g / max(1, len(at)) * 1000 + 1e-3 * w

        w = adam(gradient, 2 * size + 7, STEPS, RATE) if gold.any() else np.concatenate([np.zeros(2 * size), [-10.0], np.zeros(6)])
        self.form = {x: w[i] for x, i in ids.items()}
        self.unknown, self.prev, self.bias = w[0], {x: w[size + i] for x, i in ids.items() if not x.endswith(b"*")}, w[2 * size]
        self.unknown_prev, self.trans, self.start = w[size], w[2 * size + 1:2 * size + 5].reshape(2, 2), w[2 * size + 5:]
        self.cache: dict[bytes, tuple[float, float]] = {}
        peak, total = self.documents(texts)[:2]
        self.scale = logistic(np.column_stack([peak, total]), toxic.astype(float), ridge=1.0)
        self.cache = {}

    def weights(self, word: bytes) -> tuple[float, float]:
        """What a word adds to its own log odds and to the next word's."""
        known = self.cache.get(word)
        if known is None:
            own = forms(word)
            empty = 1 + len(STEMS) - len(own)
            known = (self.bias + sum(self.form.get(x, self.unknown) for x in own) + empty * self.unknown, self.prev.get(word, self.unknown_prev))
            if len(self.cache) >= 500_000:
                self.cache.clear()
            self.cache[word] = known
        return known

    def documents(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Each document's largest marginal (as log odds) and log sum of marginals; all marginals; first token of each."""
        found, sizes = tokens(texts)
        starts = np.cumsum(sizes) - sizes
        some = sizes > 0
        peak, total, marginal = np.full(len(texts), 1e-6), np.zeros(len(texts)), np.zeros(0)
        if some.any():
            get, weights = self.cache.get, self.weights
            both = np.array([get(w) or weights(w) for f in found for w in f])
            first = np.zeros(len(both), bool)
            first[starts[some]] = True
            odds = both[:, 0] + np.where(first, self.unknown_prev, np.concatenate([[0.0], both[:-1, 1]]))
            marginal = forward_backward(odds, first, self.trans, self.start)[0]
            peak[some] = np.maximum.reduceat(marginal, starts[some])
            # Marginals under a tenth are left out of the sum: else a long clean text would add up to a toxic one.
            total[some] = np.add.reduceat(np.where(marginal >= 0.1, marginal, 0), starts[some])
        peak = np.clip(peak, 1e-3, 1 - 1e-3)
        return np.log(peak / (1 - peak)), np.log1p(total), marginal, starts

    def judge(self, texts: list[bytes]) -> list[dict]:
        peak, total, marginal, starts = self.documents(texts)
        score = sigmoid(np.column_stack([peak, total, np.ones(len(peak))]) @ self.scale)
        offending = np.flatnonzero(marginal >= OFFENDING)
        owner = np.searchsorted(starts, offending, "right") - 1
        spans: dict[int, list[dict]] = {}
        for doc in np.unique(owner).tolist():
            words = list(re.finditer(rb"[^ ]+", texts[doc].translate(SEPARATE)))
            spans[doc] = [{"start": words[t].start(), "end": words[t].end()} for t in (offending[owner == doc] - starts[doc]).tolist()]
        return [{"score": float(s), "spans": spans.get(i, [])} for i, s in enumerate(score)]


RESULT = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("spans", T.ArrayType(
    T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))])


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, max_chars: int = MAX_CHARS) -> Tagger | None:
    """Learns from labelled rows of the training part only: crc32(id) mod 3 is not 1."""
    rows = labelled_sample(docs, labels, "toxic", remainder("doc_id", 3) != 1, per_class, max_chars)
    toxic = np.array([r["y"] == 1 for r in rows], bool)
    if not len(rows) or toxic.all() or not toxic.any():
        return None
    return Tagger([r["text"].encode() for r in rows], toxic)


def score(docs: DataFrame, tagger: Tagger | None, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct `out`: score, spans."""
    shared = docs.sparkSession.sparkContext.broadcast(tagger)  # at most MAX_FORMS words and weights

    def run(texts: pa.Array) -> pa.Array:
        kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])
        if shared.value is None:
            return pa.array([{"score": 0.0, "spans": []}] * len(texts), kind)
        return pa.array(shared.value.judge([t or b"" for t in texts.cast(pa.binary()).to_pylist()]), kind)

    return append_column(docs, out, RESULT, text_col, run)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    marked = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    value = F.col("toxicity.score")
    return marked.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), value.alias("score"),
                         (value >= REJECT).cast("int").alias("predicted"), F.size("toxicity.spans").cast("long").alias("n_spans"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under the rejection score stay. The model is learned from the labelled rows of `documents`."""
    tagger = fit(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels"))
    return score(docs, tagger, out="_toxicity").where(F.col("_toxicity.score") < REJECT).drop("_toxicity")
