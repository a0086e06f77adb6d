"""Quality classifier by co-training.

Two views of a document learn from each other: its content (words and word shapes) and its page
metadata (source, language, length, line layout, character shares). Both start from a bounded sample
of labelled rows. In each round a view labels the unlabelled documents that it is surest of, and the
other view learns from them too. At the end each view is calibrated on labelled rows that neither has
seen, at the true share of the classes, and the calibrated views are combined to score every document.

Null and empty texts have no words, and metadata of zeros; null sources and languages are values of
their own. Every row is scored by itself, so repeated rows, ties and null ids change nothing. Without
labelled rows of both classes nothing is learned and every score is 0.5.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, read
from .learn import adam, labelled_sample, logistic, remainder, sigmoid

#: Bounds of what is fitted on: labelled documents of each class, unlabelled documents, characters of each.
PER_CLASS, UNLABELLED, MAX_CHARS = 1_000, 3_000, 20_000
#: Rounds, pseudo-labels a view gives in each (for each class) and how sure it must be; word buckets; good from this score on.
ROUNDS, GIVEN, SURE, BUCKETS, GOOD = 4, 100, 0.95, 1 << 15, 0.5
#: Hash slots for sources and languages, and the character classes counted: upper, lower, digit, blank, other ASCII, non-ASCII.
SOURCES, LANGS = 64, 16
CLASSES = np.array([5 if b >= 128 else 0 if 65 <= b <= 90 else 1 if 97 <= b <= 122 else 2 if 48 <= b <= 57 else 3 if b in b" \t\n\r" else 4 for b in range(256)])
METADATA = 6 + 7 + SOURCES + LANGS


def shape(word: bytes) -> int:
    """Slot of a word's shape: case, marks and digits it holds, short or long."""
    text = word.strip(b".,;:!?")
    return (word.isupper() + 2 * word.islower() + 4 * (len(text) < len(word) - 1) + 8 * any(48 <= c < 58 for c in word)
            + 16 * any(c in b"|<>{}[]@#=_/\\" for c in word) + 32 * (len(text) > 15) + 64 * (not text))


class Words:
    """Bucket and shape slot of words; the memory of seen words is bounded."""

    def __init__(self) -> None:
        self.seen: dict[bytes, tuple[int, int]] = {}

    def slots(self, word: bytes) -> tuple[int, int]:
        known = crc32(word) % BUCKETS, BUCKETS + shape(word)
        if len(self.seen) >= 500_000:
            self.seen.clear()
        self.seen[word] = known
        return known

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(slots, two for each word; number of slots of each text)."""
        found = [t.split() for t in texts]
        get, slots = self.seen.get, self.slots
        flat = [get(w) or slots(w) for f in found for w in f]
        return np.array(flat, np.int64).reshape(-1), np.array([2 * len(f) for f in found], np.int64)


def metadata(texts: list[bytes], sources: list[str | None], langs: list[str | None]) -> np.ndarray:
    out = np.zeros((len(texts), METADATA))
    for i, t in enumerate(texts):
        if t:
            share = np.bincount(CLASSES[np.frombuffer(t, np.uint8)], minlength=6)
            lines = t.split(b"\n")
            out[i, :6] = share / len(t)
            letters = share[0] + share[1]
            out[i, 6:13] = (np.log1p(len(t)) / 10, np.log1p(len(lines)) / 10, np.log1p(len(t) / len(lines)) / 10, len(set(lines)) / len(lines),
                            share[0] / letters if letters else 0.0, max(map(len, lines)) / len(t), share[3] / max(1, len(t) - share[3]))
    for i, (source, lang) in enumerate(zip(sources, langs, strict=True)):
        out[i, 13 + (crc32(source.encode()) % (SOURCES - 1) + 1 if source is not None else 0)] = 1
        out[i, 13 + SOURCES + (crc32(lang.encode()) % (LANGS - 1) + 1 if lang is not None else 0)] = 1
    return out


class TextView:
    """Logistic regression on word buckets and shapes, each text scaled by the root of its length."""

    def __init__(self, ids: np.ndarray, sizes: np.ndarray, y: np.ndarray) -> None:
        owner, scale = np.repeat(np.arange(len(sizes)), sizes), 1 / np.sqrt(np.maximum(sizes, 1))
        n = BUCKETS + 128

        def gradient(w: np.ndarray) -> np.ndarray:
            miss = sigmoid(np.bincount(owner, w[ids], len(sizes)) * scale + w[n]) - y
            return np.append(np.bincount(ids, (miss * scale)[owner], n), miss.sum()) / len(y) + 1e-4 * w

        self.weights = adam(gradient, n + 1, 80, 0.05)

    def __call__(self, ids: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        sums = np.bincount(np.repeat(np.arange(len(sizes)), sizes), self.weights[ids], len(sizes)) if len(ids) else np.zeros(len(sizes))
        return sums / np.sqrt(np.maximum(sizes, 1)) + self.weights[-1]


def subset(ids: np.ndarray, sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.cumsum(sizes) - sizes
    return np.concatenate([ids[starts[r]:starts[r] + sizes[r]] for r in rows] or [ids[:0]]), sizes[rows]


class CoTrained:
    def __init__(self, texts, sources, langs, y: np.ndarray, aside: np.ndarray, share: float) -> None:
        """y: 0, 1 or -1 (unlabelled); aside: labelled rows kept for calibration; share: of class 1 among all labelled rows."""
        ids, sizes = Words()(texts)
        meta = metadata(texts, sources, langs)
        learn = {"text": {int(i): int(y[i]) for i in np.flatnonzero((y >= 0) & ~aside)}}
        learn["meta"] = dict(learn["text"])
        left = set(np.flatnonzero(y < 0).tolist())
        for turn in range(ROUNDS + 1):
            rows = {v: np.array(sorted(learn[v])) for v in learn}
            gold = {v: np.array([learn[v][i] for i in rows[v].tolist()], float) for v in learn}
            self.text = TextView(*subset(ids, sizes, rows["text"]), gold["text"])
            self.meta = logistic(meta[rows["meta"]], gold["meta"], ridge=0.1)
            if turn == ROUNDS or not left:
                break
            rest = np.array(sorted(left))
            for giver, taker, logit in (("text", "meta", self.text(*subset(ids, sizes, rest))), ("meta", "text", self._meta(meta[rest]))):
                del giver
                p = sigmoid(logit)
                for label, sure in ((1, p), (0, 1 - p)):
                    best = np.argsort(-sure, kind="stable")[:GIVEN]
                    for i in rest[best[sure[best] >= SURE]].tolist():
                        learn[taker].setdefault(i, label)
            left -= learn["text"].keys() & learn["meta"].keys()
        rows = np.flatnonzero(aside)
        rows = rows if len(set(y[rows])) == 2 else np.flatnonzero(y >= 0)
        gold = y[rows].astype(float)
        weight = np.where(gold == 1, share / max(gold.mean(), 1e-9), (1 - share) / max(1 - gold.mean(), 1e-9))
        views = self.text(*subset(ids, sizes, rows)), self._meta(meta[rows])
        self.scales = [logistic(v[:, None], gold, weight, ridge=1.0) for v in views]
        calibrated = np.column_stack([v * s[0] + s[1] for v, s in zip(views, self.scales, strict=True)])
        self.both = logistic(calibrated, gold, weight, ridge=1.0)

    def _meta(self, meta: np.ndarray) -> np.ndarray:
        return meta @ self.meta[:-1] + self.meta[-1]

    def judge(self, words: Words, texts, sources, langs) -> list[dict]:
        views = self.text(*words(texts)), self._meta(metadata(texts, sources, langs))
        text, meta = (v * s[0] + s[1] for v, s in zip(views, self.scales, strict=True))
        score = sigmoid(np.column_stack([text, meta, np.ones(len(text))]) @ self.both)
        return [{"score": float(a), "text_score": float(b), "metadata_score": float(c)} for a, b, c in zip(score, sigmoid(text), sigmoid(meta), strict=True)]


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, unlabelled: int = UNLABELLED, max_chars: int = MAX_CHARS) -> CoTrained | None:
    """Learns from labelled rows with crc32(id) mod 3 other than 1, and from documents without a label."""
    train = remainder("doc_id", 3) != 1
    rows = labelled_sample(docs.select("doc_id", "text"), labels, "quality", train, per_class, max_chars)
    y = [r["y"] for r in rows]
    if len(set(y)) < 2:
        return None
    share = labels.where(train & F.col("quality").isin(0, 1)).agg(F.avg("quality")).first()[0]
    bare = docs.join(labels.select(F.col("doc_id").alias("_id")).distinct(), F.col("doc_id") == F.col("_id"), "left_anti").where(
        F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= max_chars)).select("doc_id").distinct()
    wanted = bare.orderBy(F.xxhash64("doc_id"), "doc_id").limit(unlabelled).withColumn("y", F.lit(-1))
    named = docs.sparkSession.createDataFrame([(r["doc_id"], r["y"]) for r in rows], "doc_id long, y int").unionByName(wanted.select(F.col("doc_id").cast("long"), "y"))
    found = docs.join(F.broadcast(named.select(F.col("doc_id").alias("_id"), "y")), F.col("doc_id") == F.col("_id")).where(
        F.col("text").isNotNull() & (F.length("text") <= max_chars))
    row = F.struct("text", F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), "y")
    # At most 2 * per_class + unlabelled ids; rows that repeat an id count as the one with the smallest text.
    picked = found.groupBy("doc_id").agg(F.min(row).alias("row")).select("doc_id", "row.*").orderBy("doc_id").collect()
    aside = np.array([crc32(f"aside {r['doc_id']}".encode()) % 4 == 0 and r["y"] >= 0 for r in picked])
    return CoTrained([r["text"].encode() for r in picked], [r["source"] for r in picked], [r["lang"] for r in picked], np.array([r["y"] for r in picked]), aside, float(share))


RESULT = T.StructType([T.StructField(n, T.DoubleType()) for n in ("score", "text_score", "metadata_score")])


def score(docs: DataFrame, model: CoTrained | None, out: str = "quality_view") -> DataFrame:
    """docs with a struct `out`: score, and each view's own."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS weights
    packed = docs.withColumn("_views", F.struct(F.col("text").alias("text"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang")))
    words = Words()

    def run(rows: pa.Array) -> pa.Array:
        kind = pa.struct([(n, pa.float64()) for n in ("score", "text_score", "metadata_score")])
        if shared.value is None:
            return pa.array([{"score": 0.5, "text_score": 0.5, "metadata_score": 0.5}] * len(rows), kind)
        texts = [t or b"" for t in rows.field("text").cast(pa.binary()).to_pylist()]
        return pa.array(shared.value.judge(words, texts, rows.field("source").to_pylist(), rows.field("lang").to_pylist()), kind)

    return append_column(packed, out, RESULT, "_views", run).drop("_views")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    marked = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    value = F.col("quality_view.score")
    return marked.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), value.alias("score"),
                         (value >= GOOD).cast("int").alias("predicted"), "quality_view.text_score", "quality_view.metadata_score")
