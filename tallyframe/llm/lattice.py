"""Embedding near-dedup by lattice hashing.

Unit vectors are projected to eight dimensions several times, and each projection is decoded to the
nearest point of the E8 lattice. The points of two projections make a cell of a table. A vector is
entered in its own cell and in those where one point is replaced by the lattice neighbour it lies
next nearest to. Vectors that meet in a cell are compared
exactly, by cosine in double precision. A pair that meets in several cells counts in the first one
only (both vectors carry their lists of cells), so links are counted without listing pairs. Vectors
equal in every component are one class from the start. A cell with many classes is cut into tiles, and every
pair of tiles is a task's work of bounded size. A tile pair answers with link counts and a spanning
star for each group.

Null and zero vectors and those with null or non-finite components link with nothing, as do vectors of
different lengths with each other. Rows repeating a vec_id are counted as vectors of their own; the id's row
is repeated. Rows without an id are left out of other rows' components but count as links. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, read
from .graph import components
from .simhash import joined_labels

#: Least cosine of a link; tables; projections that make up a table's cell; length of a unit vector over the lattice's unit;
#: seed of the projections; classes in a tile. So set, of pairs at cosine 0.9 exactly 96 in 100 meet (all at 0.97 and
#: above), and of unrelated pairs in 64 dimensions one in 3,000. A larger scale or more planes part more of those.
COSINE, TABLES, PLANES, SCALE, SEED, TILE = 0.9, 16, 2, 1.6, 20, 256


def projections(size: int, tables: int = TABLES, seed: int = SEED) -> np.ndarray:
    """(tables, size, 8): orthonormal directions (random ones where size is under 8), the same for a seed and size."""
    rng = np.random.default_rng([seed, size])
    out = []
    for _ in range(tables):
        m = rng.standard_normal((size, 8))
        out.append(np.linalg.qr(m)[0] * np.sqrt(size / 8) if size >= 8 else m)
    return np.array(out)


def _d8(x: np.ndarray) -> np.ndarray:
    """Nearest points with integer coordinates of even sum."""
    near = np.round(x)
    odd = near.sum(1) % 2 != 0
    gap = x - near
    worst = np.abs(gap).argmax(1)
    rows = np.flatnonzero(odd)
    near[rows, worst[rows]] += np.where(gap[rows, worst[rows]] >= 0, 1, -1)
    return near


def decode(x: np.ndarray) -> np.ndarray:
    """Nearest E8 points, doubled so that they are whole numbers: D8, or D8 moved by one half in every coordinate."""
    a, b = _d8(x), _d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(1) <= ((x - b) ** 2).sum(1))[:, None], 2 * a, 2 * b).astype(np.int64)


def roots() -> np.ndarray:
    """The 240 shortest E8 vectors, doubled: two coordinates of one, or all of one half with an even number of minuses."""
    whole = [np.eye(8, dtype=int)[i] * 2 * s + np.eye(8, dtype=int)[j] * 2 * t for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = 1 - 2 * ((np.arange(256)[:, None] >> np.arange(8)) & 1)
    return np.array([*whole, *signs[signs.prod(1) == 1]])


ROOTS = roots()
_WEIGHTS = np.random.default_rng(SEED).integers(1 << 62, size=8) | 1


def cells(unit: np.ndarray, tables: int = TABLES, planes: int = PLANES, scale: float = SCALE) -> np.ndarray:
    """(vectors, tables * (1 + planes)) cell numbers. In a table a vector's cell is the tuple of its lattice points in all
    planes; the probed neighbours replace one of them by the lattice point next nearest."""
    through = projections(unit.shape[1], tables * planes)
    out = []
    for t in range(tables):
        homes, others = [], []
        for k in range(planes):
            x = unit @ through[t * planes + k] * scale
            home = decode(x)
            # The neighbour at root r is the nearer, the more of the rest points its way.
            homes.append((home * _WEIGHTS).sum(1))
            others.append(((home + ROOTS[((2 * x - home) @ ROOTS.T).argmax(1)]) * _WEIGHTS).sum(1))
        for moved in range(-1, planes):
            cell = np.full(len(unit), t, np.int64)
            for k in range(planes):
                cell = cell * 0x9E3779B1 + (others if k == moved else homes)[k]
            out.append(cell)
    return np.column_stack(out)


def usable(vector: str) -> F.Column:
    v = F.col(vector)
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & fine & F.exists(v, lambda x: x != 0), F.lit(False))


def _coded(classes: DataFrame) -> DataFrame:
    """classes (id, copies, vector) with the list of cells of each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = [np.asarray(v, float) for v in batch.column(2).to_pylist()]
            found: list = [None] * len(vectors)
            sizes = np.array([len(v) for v in vectors])
            for size in np.unique(sizes).tolist():
                rows = np.flatnonzero(sizes == size)
                m = np.array([vectors[r] for r in rows])
                m /= np.abs(m).max(1, keepdims=True)
                m /= np.linalg.norm(m, axis=1, keepdims=True)
                for r, c in zip(rows.tolist(), cells(m), strict=True):
                    found[r] = c
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int64()))], names=["id", "copies", "vector", "cells"])

    return classes.mapInArrow(run, "id long, copies long, vector array<double>, cells array<long>")


def _compare(ids, copies, unit, codes, tree: np.ndarray, asks: np.ndarray, cell: int, same: bool, cosine: float, links, labels) -> None:
    """Adds the links between two tiles of a cell that are not met in an earlier cell."""
    dots = unit[tree] @ unit[asks].T
    near = dots >= cosine
    if same:
        near &= np.triu(np.ones(near.shape, bool), 1)
    a, b = np.nonzero(near)
    a, b = tree[a], asks[b]
    for at in range(0, len(a), 20_000):
        p, q = a[at:at + 20_000], b[at:at + 20_000]
        # The first common cell is the smallest number that both lists hold.
        first = np.full(len(p), np.iinfo(np.int64).max)
        for j in range(codes.shape[1]):
            met = (codes[q] == codes[p, j:j + 1]).any(1)
            first = np.where(met, np.minimum(first, codes[p, j]), first)
        use = first == cell
        np.add.at(links, p[use], copies[q[use]])
        np.add.at(links, q[use], copies[p[use]])
        if use.any():
            labels[:] = joined_labels(len(labels), p[use], q[use], labels)


def found_links(classes: DataFrame, cosine: float = COSINE, tile: int = TILE) -> DataFrame:
    """(id, n, other) of classes (id, copies, vector): counts of linked vectors to be summed by id, and links
    id-other that connect what is linked (other null: only a count)."""
    spark = classes.sparkSession
    coded = cut(_coded(classes))
    entered = coded.select("id", F.explode(F.array_distinct("cells")).alias("cell"))
    sizes = entered.groupBy("cell").count().where("count > 1").select("cell", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    met = entered.join(cut(sizes), "cell").selectExpr("id", "cell", "tiles", "cast(pmod(xxhash64(id), tiles) AS int) AS tile")
    dealt = met.selectExpr("id", "cell", "tile", "explode(sequence(0, tiles - 1)) AS other").selectExpr(
        "id", "cell", "tile", "least(tile, other) AS a", "greatest(tile, other) AS b")
    rows = dealt.join(coded, "id").select("cell", "a", "b", "tile", "id", "copies", "vector", "cells")
    n = partitions(spark)
    ready = rows.repartition(n, "cell", "a", "b").sortWithinPartitions("cell", "a", "b", "tile")

    def work(group: pa.Table) -> list[tuple]:
        cell, a, b, tile_no, ids, copies = (group.column(i).to_numpy() for i in range(6))
        vectors, lists = group.column(6).to_pylist(), group.column(7).to_pylist()
        links, labels = np.zeros(len(ids), np.int64), np.arange(len(ids))
        sizes_of = np.array([len(v) for v in vectors])
        for size in np.unique(sizes_of).tolist():
            own = np.flatnonzero(sizes_of == size)
            unit, codes = np.zeros((len(ids), size)), np.zeros((len(ids), max(map(len, lists))), np.int64)
            unit[own] = [vectors[i] for i in own]
            unit[own] /= np.abs(unit[own]).max(1, keepdims=True)
            unit[own] /= np.linalg.norm(unit[own], axis=1, keepdims=True)
            codes[own] = [lists[i] for i in own]
            if a[0] == b[0]:
                _compare(ids, copies, unit, codes, own, own, int(cell[0]), True, cosine, links, labels)
            else:
                _compare(ids, copies, unit, codes, own[tile_no[own] == a[0]], own[tile_no[own] == b[0]], int(cell[0]), False, cosine, links, labels)
        some = np.flatnonzero(links)
        return [(int(ids[i]), int(links[i]), int(ids[labels[i]]) if labels[i] != i else None) for i in some.tolist()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def groups(table: pa.Table, last: bool):
            keys = [table.column(i).to_numpy() for i in range(3)]
            ends = np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1
            ends = [*ends.tolist(), *([table.num_rows] if last else [])]
            out, at = [], 0
            for end in ends:
                if end - at > 1:
                    out += work(table.slice(at, end - at).combine_chunks())
                at = end
            return out, table.slice(at)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], names=["id", "n", "other"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) >= 5_000:
                out, rest = groups(pa.Table.from_batches(held), False)
                held = rest.to_batches()
                if out:
                    yield batch_of(out)
        if held:
            out, _ = groups(pa.Table.from_batches(held), True)
            if out:
                yield batch_of(out)

    return ready.mapInArrow(run, "id long, n long, other long")


def link_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    named = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    marked = named.withColumn("key", F.when(usable("vector"), F.sha2(F.to_binary(F.array_join(F.transform("vector", lambda x: F.hex(x.cast("string").cast("binary"))), "2C"), F.lit("hex")), 256)))
    rows = marked.select("vec_id", "key")
    same = marked.where("key IS NOT NULL").groupBy("key").agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"), F.first("vector").alias("vector"))
    classes = cut(same.select(F.xxhash64("key").alias("id"), "key", "copies", "least", "vector"))
    found = cut(found_links(classes.select("id", "copies", "vector"), cosine))
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    group = components(found.where("other IS NOT NULL").select(F.col("id").alias("u"), F.col("other").alias("v")))
    of_class = classes.join(counts, "id", "left").join(cut(group), F.col("id") == F.col("node"), "left").select(
        "key", "least", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component"))
    of_class = cut(of_class)
    smallest = cut(of_class.groupBy("component").agg(F.min("least").alias("component_id")))
    result = of_class.join(smallest, "component").select("key", "n_links", "component_id")
    joined = rows.where("key IS NOT NULL").join(result, "key").select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("component_id")).alias("component_id"))
    alone = rows.where("key IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(read(spark, sf_dir, "embeddings"))


#: All pairs, so only for small tables; a lattice search that misses a link shows as a difference.
ORACLE = """
WITH RECURSIVE fine AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
usable AS (
  SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM fine
  WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM usable a JOIN usable b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) >= 0.9 * a.n * b.n),
reach AS (SELECT vec_id AS u, vec_id AS v FROM embeddings UNION SELECT reach.u, links.v FROM reach JOIN links ON reach.v = links.u),
groups AS (SELECT u, min(v) AS component_id FROM reach GROUP BY u),
counts AS (SELECT u, count(*) AS n_links FROM links GROUP BY u)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN groups ON groups.u = vec_id LEFT JOIN counts ON counts.u = vec_id
"""
