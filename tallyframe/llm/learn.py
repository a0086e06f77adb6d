"""Small models: splits of labelled rows, logistic regression and calibration in numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(id_col: str, by: int) -> F.Column:
    """crc32 of the id as text, modulo `by`; null for a null id."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(by))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: F.Column, per_class: int, max_chars: int) -> list:
    """Rows (doc_id, text, y) to learn from: of each class the `per_class` with the smallest id hashes among
    labelled rows where `train` holds and the text, which is at most `max_chars` long, is not null. Both bounds
    only limit what a model is fitted on. Copies of a text count once, rows that repeat an id count as the one with
    the smallest text; a doc with contradicting labels is left out."""
    marks = labels.select(F.col("doc_id").alias("_id"), F.col(label).cast("int").alias("y")).where(F.col("y").isin(0, 1))
    marks = marks.groupBy("_id").agg(F.min("y").alias("y"), F.max("y").alias("z")).where("y = z").drop("z")
    texts = docs.select("doc_id", "text").where(train & F.col("text").isNotNull() & (F.length("text") <= max_chars))
    ids = texts.select("doc_id").join(marks, F.col("doc_id") == F.col("_id")).select("_id", "y")
    picked = None
    for y in (0, 1):
        some = ids.where(F.col("y") == y).distinct().orderBy(F.xxhash64("_id"), "_id").limit(per_class)
        picked = some if picked is None else picked.unionByName(some)
    rows = texts.join(F.broadcast(picked), F.col("doc_id") == F.col("_id")).groupBy("doc_id", "y").agg(F.min("text").alias("text"))  # at most 2 * per_class
    return sorted({r["text"]: r for r in sorted(rows.collect(), key=lambda r: -r["doc_id"])}.values(), key=lambda r: r["doc_id"])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (the last is the intercept) by Newton steps; for few columns."""
    x = np.column_stack([x, np.ones(len(x))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def adam(gradient, size: int, steps: int, rate: float) -> np.ndarray:
    """Full-batch Adam from zero."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = gradient(w)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return w
