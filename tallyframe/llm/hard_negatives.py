"""Hard negatives by an inverted multi-index.

Rows are dealt to shards of equal size by a hash of their id, anchors to blocks; every block meets every shard
in one task. There the vectors are halved, each half gets a codebook, and a pair of codewords is a cell. An
anchor's score with a row of a cell is at most the sum of its two half-scores with the codewords, each widened by the
codeword's radius (the farthest row's distance) times the length of the anchor's half. A heap of pairs of codewords visits cells by
falling bounds and stops when no cell left can change what was found: first the best rows of the anchor's label, then,
for each of these positives, the best rows of other labels whose score lies in its window. Cells wholly above all
windows are passed over. Scores are whole numbers, computed exactly, so each shard's answer is exact, and so is what is
left of all shards' answers by rank: recall is 1 by construction.

A hot label or a group of copies spreads over all shards with its ids; a task holds one shard and one block, an answer
is bounded by the number of ranks asked for. Codebooks are fitted on at most FIT rows of a shard; every row is indexed.

Rows take no part if id, label or vector is null, if a component is null or not finite, or if one is too large to be summed exactly
(RANGE or more once it is a whole number). Vectors of other lengths never meet an anchor; empty vectors score zero. Rows that
repeat an id are rows of their own and never partners of an anchor of that id; equal rows of an anchor give equal results. Ties go
to the smaller id. An empty table gives no rows. Other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, partitions, read

#: Positives of an anchor and negatives of each; a negative's least and most score in hundredths of the positive's.
POSITIVES, NEGATIVES, WINDOW = 5, 10, (30, 90)
#: Most rows in a shard and anchors in a block; rows wanted in a cell; most codewords of a half; rows a codebook is fitted on, and rounds.
SHARD, BLOCK, CELL, WORDS, FIT, ROUNDS = 65_536, 4_096, 128, 64, 4_096, 5
RANGE = 1 << 20
SCALE = 256


def quantised(vectors: DataFrame, id_col: str, label: F.Column, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, label, vector): rows that take part, components as whole numbers."""
    whole = F.transform(F.col(vector_col), lambda x: x.cast("double") * scale)
    fine = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < RANGE))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), label.cast("string").alias("label"), whole.alias("vector"), F.coalesce(fine, F.lit(False)).alias("fine"))
    return rows.where("fine AND id IS NOT NULL AND label IS NOT NULL").select("id", "label", F.transform("vector", lambda x: F.floor(x).cast("int")).alias("vector"))


class MultiIndex:
    """Rows of one length in the cells of two codebooks."""

    def __init__(self, rows: np.ndarray) -> None:
        """rows: whole numbers as doubles."""
        n, size = rows.shape
        words = int(np.clip(round((n / CELL) ** 0.5), 1, WORDS))
        self.cuts = (slice(0, size // 2), slice(size // 2, size))
        self.books, self.radii, codes = [], [], []
        for half in self.cuts:
            part = rows[:, half]
            book = _codebook(part[:: max(1, -(-n // FIT))], words)
            code, gap = _nearest(part, book)
            radius = np.zeros(len(book))
            np.maximum.at(radius, code, gap)
            self.books.append(book)
            self.radii.append(radius)
            codes.append(code)
        cell = codes[0] * len(self.books[1]) + codes[1]
        self.order = np.argsort(cell, kind="stable")
        self.start = np.searchsorted(cell[self.order], np.arange(len(self.books[0]) * len(self.books[1]) + 1))
        self.rows = np.ascontiguousarray(rows[self.order])

    def visit(self, anchor: np.ndarray) -> Iterator[tuple[float, float, slice]]:
        """(most, least) possible score and rows of each cell that holds any, by falling most."""
        high, low, order = [], [], []
        for half, book, radius in zip(self.cuts, self.books, self.radii, strict=True):
            middle, reach = book @ anchor[half], radius * np.linalg.norm(anchor[half])
            slack = 1e-6 * (1 + np.abs(middle) + reach)
            by = np.argsort(-(middle + reach + slack), kind="stable")
            high.append((middle + reach + slack)[by].tolist())
            low.append((middle - reach - slack)[by].tolist())
            order.append(by.tolist())
        many = len(order[1])
        heap = [(-(high[0][0] + high[1][0]), 0, 0)]
        while heap:
            most, i, j = heapq.heappop(heap)
            # Each pair enters the heap once: along a row, and along the first column.
            if j + 1 < many:
                heapq.heappush(heap, (-(high[0][i] + high[1][j + 1]), i, j + 1))
            if j == 0 and i + 1 < len(order[0]):
                heapq.heappush(heap, (-(high[0][i + 1] + high[1][0]), i + 1, 0))
            cell = order[0][i] * many + order[1][j]
            if self.start[cell] < self.start[cell + 1]:
                yield -most, low[0][i] + low[1][j], slice(self.start[cell], self.start[cell + 1])


def _nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codeword, distance to it) of each row."""
    code = np.concatenate([((book ** 2).sum(1) - 2 * part[at:at + 8_192] @ book.T).argmin(1) for at in range(0, len(part), 8_192)])
    return code, np.sqrt(((part - book[code]) ** 2).sum(1))


def _codebook(part: np.ndarray, words: int) -> np.ndarray:
    """A few rounds of Lloyd's method from evenly spaced rows."""
    book = part[np.linspace(0, len(part) - 1, words).astype(int)].copy()
    for _ in range(ROUNDS if words > 1 else 1):
        code, _ = _nearest(part, book)
        total, count = np.zeros_like(book), np.bincount(code, minlength=len(book))
        np.add.at(total, code, part)
        book = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], book)
    return book


class Best:
    """The first `most` rows of one window, by score and smaller id."""

    def __init__(self, most: int, low: int | None = None, high: int | None = None) -> None:
        self.most, self.low, self.high = most, low, high
        self.held: list[tuple[int, int]] = []  # (score, -id), the last at the root

    def floor(self) -> float:
        """What a score must reach to matter."""
        if len(self.held) == self.most:
            return self.held[0][0]
        return -np.inf if self.low is None else self.low

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        fits = scores >= self.floor()
        if self.high is not None:
            fits &= scores <= self.high
        for pair in zip(scores[fits].astype(np.int64).tolist(), (-ids[fits]).tolist(), strict=True):
            if len(self.held) < self.most:
                heapq.heappush(self.held, pair)
            elif pair > self.held[0]:
                heapq.heapreplace(self.held, pair)


def best_rows(index: MultiIndex, ids: np.ndarray, usable: np.ndarray, anchor: np.ndarray, windows: list[Best]) -> None:
    """Fills the windows; ids and usable are in the index's order."""
    top = max((np.inf if w.high is None else w.high for w in windows), default=-np.inf)
    for most, least, rows in index.visit(anchor):
        if most < min(w.floor() for w in windows):
            return
        if least > top:
            continue
        scores = index.rows[rows] @ anchor
        at = usable[rows] & (scores >= min(w.floor() for w in windows))
        if at.any():
            for window in windows:
                window.add(scores[at], ids[rows][at])


def _answers(rows: DataFrame, asks: DataFrame, shards: int, blocks: int, most: int, same: bool) -> DataFrame:
    """(anchor, id, score): for each ask (id, label, vector, lows, highs) each shard's best rows; of its own label
    without windows (same), else of other labels for any of its windows."""
    deal = [F.col("id"), F.col("label"), F.col("vector")]
    dealt = rows.select(F.lit(False).alias("ask"), F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int").alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                        *deal, F.lit(None).cast("array<long>").alias("lows"), F.lit(None).cast("array<long>").alias("highs"))
    asked = asks.select(F.lit(True).alias("ask"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"),
                        *deal, "lows", "highs")
    both = dealt.unionByName(asked).withColumn("size", F.size("vector")).select("shard", "block", "size", "ask", "id", "label", "vector", "lows", "highs")
    ready = both.repartition(min(shards * blocks, 4 * partitions(rows.sparkSession)), "shard", "block", "size").sortWithinPartitions("shard", "block", "size", "ask", "id", "label", "vector")

    def answer(table: pa.Table) -> pa.RecordBatch:
        ask, ids = table.column(3).to_numpy(), table.column(4).to_numpy()
        labels = table.column(5).combine_chunks().dictionary_encode().indices.to_numpy()
        vectors = table.column(6).combine_chunks().flatten().to_numpy().astype(float).reshape(len(ids), -1)
        own = np.flatnonzero(~ask)
        out: list[tuple[int, int, int]] = []
        if len(own):
            index = MultiIndex(vectors[own])
            own = own[index.order]
            for i in np.flatnonzero(ask).tolist():
                usable = ((labels[own] == labels[i]) == same) & (ids[own] != ids[i])
                lows, highs = (table.column(c)[i].as_py() for c in (7, 8))
                windows = [Best(most)] if same else [Best(most, a, b) for a, b in zip(lows, highs, strict=True) if a <= b]
                if windows:
                    best_rows(index, ids[own], usable, vectors[i], windows)
                # A row is told as often as it stands in the table, once for all windows.
                found: dict[tuple[int, int], int] = {}
                for w in windows:
                    for pair in set(w.held):
                        found[pair] = max(found.get(pair, 0), w.held.count(pair))
                out += [(int(ids[i]), -pair[1], pair[0]) for pair, times in found.items() for _ in range(times)]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], pa.int64()) for c in range(3)], names=["anchor", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = pa.Table.from_batches([*held, batch])
            keys = [table.column(c).to_numpy() for c in range(3)]
            ends = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            at = 0
            for end in ends.tolist():
                yield answer(table.slice(at, end - at))
                at = end
            held = table.slice(at).to_batches()
        if held:
            yield answer(pa.Table.from_batches(held))

    return ready.mapInArrow(run, "anchor long, id long, score long")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW,
                   shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows and anchors (id, label, vector of whole numbers)."""
    spark = rows.sparkSession
    rows, anchors = cut(rows), cut(anchors.dropDuplicates(["id", "label", "vector"]))
    n, asked = rows.count(), anchors.count()
    shards = max(1, -(-n // shard), min(partitions(spark), n // 2_048))
    blocks = max(1, -(-asked // block))
    none = F.array().cast("array<long>")
    own = anchors.withColumn("lows", none).withColumn("highs", none)
    nearest = Window.partitionBy("anchor").orderBy(F.desc("score"), "id")
    found = _answers(rows, own, shards, blocks, positives, True).withColumn("place", F.row_number().over(nearest)).where(F.col("place") <= positives)
    found = cut(found)
    low, high = window
    asks = found.groupBy("anchor").agg(F.collect_list(F.struct(  # at most `positives` entries
        F.expr(f"-floor(-{low} * score / 100D)").cast("long").alias("low"), F.expr(f"floor({high} * score / 100D)").cast("long").alias("high"))).alias("w"))
    asked_rows = anchors.join(asks, anchors.id == asks.anchor).select("id", "label", "vector", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"))
    others = cut(_answers(rows, asked_rows, shards, blocks, negatives, False))
    fits = others.join(found.select("anchor", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), "place"), "anchor").where(
        f"{low} * positive_score <= 100 * score AND 100 * score <= {high} * positive_score")
    hardest = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "id")
    return fits.withColumn("rank", F.row_number().over(hardest)).where(F.col("rank") <= negatives).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = quantised(vectors, "vec_id", label, "embedding")
    return hard_negatives(rows, rows.where("id % 100 = 0"))


ORACLE = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
ranked AS (
  SELECT p.anchor_id, p.other AS positive_id, n.other AS negative_id, p.score AS positive_score, n.score AS negative_score,
    CAST(row_number() OVER (PARTITION BY p.anchor_id, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank
  FROM positives p JOIN scored n ON p.anchor_id = n.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM ranked WHERE rank <= 10
"""
