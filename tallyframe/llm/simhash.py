"""SimHash near-dedup with BK-trees.

A document's fingerprint has a bit for each place where most shingle hashes have one. Fingerprints
within three differing bits share at least one of four blocks of 16 bits, so they are dealt to one
shard for each block and value. Each shard is indexed by a BK-tree (children keyed by their Hamming
distance to the parent), and searches follow only edges within the radius. Trees hold at most
`TREE_SIZE` fingerprints: a larger shard is cut into tiles, and its fingerprints go to every pair of
tiles that they belong to, so that hot shards spread over tasks and memory stays bounded. A shard
answers with a spanning star for each group it finds, not with all pairs.

Texts without words (null, empty, blank) have the fingerprint zero and link like any other. Documents
with one fingerprint are one class from the start; rows repeating an id share its result. Rows
without an id are classes of their own id, null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, cut, partitions, read, with_hint
from .graph import components

RADIUS, SHINGLE, SEED, TREE_SIZE, PAIRS_AT_ONCE = 3, 3, 42, 512, 1_000_000
#: Of the pipeline's stage: words of a shingle, least Jaccard similarity, and bands of so many minima each. Two sets of
#: similarity s share a band with probability 1 - (1 - s ** ROWS) ** BANDS: 0.9998 at 0.8.
WORDS, LEAST, BANDS, ROWS = 5, 0.8, 16, 4
#: Equal minima below which a pair is refused; smallest ids of a bucket that all others are compared with first; classes in a tile; pairs in a block.
ENOUGH, LEADERS, IN_TILE, BLOCK = 36, 4, 2_048, 5_000
_SEEDS = np.random.default_rng(SEED).integers(0, 1 << 64, BANDS * ROWS, np.uint64)


def fingerprint(text: bytes | None) -> int:
    """Unsigned 64-bit SimHash; words are split at ASCII blanks, A-Z lower-cased."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    line = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = min(SHINGLE, len(found))
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], SEED) for a, b in zip(starts[:len(found) - size + 1].tolist(), ends[size - 1:].tolist(), strict=True)), np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[at:at + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(total * 2 > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fp") -> DataFrame:
    """docs with the fingerprint as a signed long."""
    def run(texts: pa.Array) -> pa.Array:
        prints = np.array([fingerprint(t) for t in texts.cast(pa.binary()).to_pylist()], np.uint64)
        return pa.array(prints.view(np.int64), pa.int64())

    return append_column(docs, out, T.LongType(), text_col, run)


class Forest:
    """BK-trees of many shards at once, as arrays: node i holds keys[i]; the children of a node are
    one slice of `child`, ordered by their distance to it."""

    def __init__(self, shard: np.ndarray, keys: np.ndarray) -> None:
        """shard: sorted shard number of each key. The first key of a shard is its root."""
        n = len(keys)
        self.keys = keys
        self.parent = np.full(n, -1)
        self.edge = np.zeros(n, np.int64)
        roots = np.concatenate(([True], shard[1:] != shard[:-1])) if n else np.zeros(0, bool)
        self.root_of = dict(zip(shard[roots].tolist(), np.flatnonzero(roots).tolist(), strict=True))
        where = np.maximum.accumulate(np.where(roots, np.arange(n), 0)) if n else np.zeros(0, int)
        left = np.flatnonzero(~roots)
        where = where[left]
        while len(left):
            gap = np.bitwise_count(keys[left] ^ keys[where]).astype(np.int64)
            slot = where * 65 + gap
            _, first, group = np.unique(slot, return_index=True, return_inverse=True)
            chosen = left[first]
            self.parent[chosen], self.edge[chosen] = where[first], gap[first]
            rest = np.ones(len(left), bool)
            rest[first] = False
            where, left = chosen[group][rest], left[rest]
        order = np.lexsort((self.edge, self.parent))
        self.child = order[np.searchsorted(self.parent[order], 0):]
        place = self.parent[self.child]
        self.lo, self.hi = np.searchsorted(place, np.arange(n), "left"), np.searchsorted(place, np.arange(n), "right")

    def search(self, keys: np.ndarray, nodes: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """(query number, node) of all nodes within the radius of keys, each searched from nodes[i] down."""
        found_q, found_n = [], []
        query = np.arange(len(keys))
        while len(query):
            gap = np.bitwise_count(keys[query] ^ self.keys[nodes]).astype(np.int64)
            near = gap <= radius
            found_q.append(query[near])
            found_n.append(nodes[near])
            width = self.hi[nodes] - self.lo[nodes]
            total = int(width.sum())
            back = np.repeat(np.arange(len(query)), width)
            at = np.arange(total) - np.repeat(np.cumsum(width) - width, width) + np.repeat(self.lo[nodes], width)
            below = self.child[at]
            follow = np.abs(self.edge[below] - gap[back]) <= radius
            query, nodes = query[back[follow]], below[follow]
        return np.concatenate(found_q) if found_q else query, np.concatenate(found_n) if found_n else query


def joined_labels(n: int, a: np.ndarray, b: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """Smallest member number of each of n nodes' groups under the links a-b and earlier labels."""
    label = np.arange(n) if label is None else label
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def _shard_links(shard: np.ndarray, prints: np.ndarray, role: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links among the fingerprints of each shard. role 0: tree and query, 1: tree, 2: query."""
    tree = np.flatnonzero(role != 2)
    asks = np.flatnonzero(role != 1)
    if not len(tree) or not len(asks):
        return prints[:0], prints[:0]
    forest = Forest(shard[tree], prints[tree])
    size = dict(zip(*(x.tolist() for x in np.unique(shard[tree], return_counts=True)), strict=True))
    asks = asks[[s in forest.root_of for s in shard[asks].tolist()]]
    cost = np.cumsum([size[s] for s in shard[asks].tolist()])
    label = np.arange(len(prints))
    start = 0
    while start < len(asks):
        stop = max(start + 1, int(np.searchsorted(cost, (cost[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        some = asks[start:stop]
        q, node = forest.search(prints[some], np.array([forest.root_of[s] for s in shard[some].tolist()]), radius)
        label = joined_labels(len(prints), some[q], tree[node], label)
        start = stop
    moved = np.flatnonzero(label != np.arange(len(prints)))
    return prints[moved], prints[label[moved]]


def link(prints: DataFrame, radius: int = RADIUS, tree_size: int = TREE_SIZE) -> DataFrame:
    """Edges (u, v) that connect all fingerprints (distinct, column fp) within the radius of each other."""
    if radius > 3:
        raise ValueError("four blocks find at most three differing bits")
    spark = prints.sparkSession
    shards = prints.selectExpr("fp", "explode(transform(sequence(0, 3), b -> (cast(b as bigint) << 16) | (shiftrightunsigned(fp, b * 16) & 65535))) AS shard")
    hot = shards.groupBy("shard").count().where(F.col("count") > tree_size).select(
        "shard", F.ceil(F.col("count") / tree_size).cast("int").alias("tiles"))
    dealt = shards.join(cut(hot), "shard", "left").selectExpr(
        "shard", "fp", "coalesce(tiles, 1) AS tiles", "cast(pmod(xxhash64(fp), coalesce(tiles, 1)) AS int) AS tile")
    pairs = dealt.selectExpr("shard", "fp", "tile", "explode(sequence(0, tiles - 1)) AS other").selectExpr(
        "shard", "least(tile, other) AS a", "greatest(tile, other) AS b",
        "CASE WHEN tile = other THEN 0 WHEN tile < other THEN 1 ELSE 2 END AS role", "fp")
    dealt = pairs.repartition(partitions(spark), "shard", "a", "b").sortWithinPartitions("shard", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def links(table: pa.Table) -> pa.RecordBatch:
            shard, a, b, role, fp = (table.column(c).to_numpy() for c in range(5))
            group = np.cumsum(np.concatenate(([0], (np.diff(shard) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0))))
            u, v = _shard_links(group, fp.view(np.uint64), role, radius)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            if sum(x.num_rows for x in held) < 100_000:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            keys = [table.column(c).to_numpy() for c in range(3)]
            change = np.flatnonzero((np.diff(keys[0]) != 0) | (np.diff(keys[1]) != 0) | (np.diff(keys[2]) != 0))
            if len(change):
                end = int(change[-1]) + 1
                yield links(table.slice(0, end))
                held = table.slice(end).to_batches()
        if held and sum(x.num_rows for x in held):
            yield links(pa.Table.from_batches(held).combine_chunks())

    return dealt.mapInArrow(run, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row per input row: id, fp (signed long), component_id."""
    marked = cut(fingerprints(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))).select("doc_id", "fp"))
    classes = cut(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = cut(components(link(classes.select("fp"), radius)))
    named = classes.join(groups, classes.fp == groups.node, "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = cut(named.join(cut(smallest), "component").select("fp", "component_id"))
    return marked.join(of_class, "fp").select(
        "doc_id", "fp", F.when(F.col("doc_id").isNull(), None).otherwise(F.col("component_id")).alias("component_id"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def shingles(text: bytes | None, size: int = WORDS) -> np.ndarray:
    """Sorted different hashes of a text's word shingles; words as in fingerprint()."""
    found = (text or b"").lower().split()
    size = min(size, len(found))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(found[i:i + size]), SEED) for i in range(len(found) - size + 1)] if found else [], np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of common members; two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def minima(found: np.ndarray) -> np.ndarray:
    """The least of the seeded hashes of a set, for each of BANDS * ROWS seeds."""
    least = np.full(BANDS * ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for at in range(0, len(found), 4_096):
        x = found[at:at + 4_096, None] ^ _SEEDS
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, (x ^ (x >> np.uint64(29))).min(0))
    return least


def _grouped(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of one key (the first columns) at a time, from rows sorted by it."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        table = pa.Table.from_batches([*held, batch])
        ends = np.flatnonzero(np.any([np.diff(table.column(c).to_numpy()) != 0 for c in range(keys)], axis=0)) + 1
        at = 0
        for end in ends.tolist():
            yield table.slice(at, end - at)
            at = end
        held = table.slice(at).to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _medoids(members: DataFrame) -> DataFrame:
    """(bucket, node): in each tile the member whose minima agree most with what most members have: the middle of a group of copies."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            marks = np.frombuffer(b"".join(table.column(3).to_pylist()), np.uint8).reshape(table.num_rows, -1)
            usual = np.array([np.bincount(c, minlength=256).argmax() for c in marks.T], np.uint8) if len(marks) > 2 else marks[0]
            k = int((marks == usual).sum(1).argmax())
            yield pa.RecordBatch.from_arrays([table.column(c).slice(k, 1).combine_chunks() for c in (0, 2)], names=["bucket", "node"])

    ready = members.select("bucket", "tile", "node", "marks").repartition(partitions(members.sparkSession), "bucket", "tile").sortWithinPartitions("bucket", "tile", "node")
    return ready.mapInArrow(run, "bucket long, node long")


def _fits(part: tuple[np.ndarray, np.ndarray], size: tuple[np.ndarray, np.ndarray], shared: tuple[np.ndarray, np.ndarray], marks: tuple[np.ndarray, np.ndarray], least: float) -> tuple[np.ndarray, np.ndarray]:
    """(equal minima, whether similar at all) of those that ask with the others, each column given for both. Sizes are within the bound,
    enough minima are equal (sets of similarity 0.8 agree in fewer than ENOUGH of 64 with probability under one in 100,000),
    and the shingles shared with anything suffice."""
    met = (marks[0][:, None, :] == marks[1][None, :, :]).sum(2, dtype=np.uint8)
    fits = (met >= ENOUGH) & (part[1][None, :] != part[0][:, None])
    x, y = size[0][:, None], size[1][None, :]
    fits &= np.minimum(x, y) >= least * np.maximum(x, y)
    fits &= np.minimum(shared[0][:, None], shared[1][None, :]) * (1 + least) >= least * (x + y) - 1e-6
    return met, fits


def _plausible(rows: DataFrame, least: float, wanted: str) -> DataFrame:
    """What may be similar among rows (bucket, tile, ask, node, part, size, shared, marks): those that ask with those that do not, of another part,
    by the bounds of `_fits`. wanted: `best`, (node, other, met) with the one of most equal minima in a tile; `nodes`, (node) those that have any."""
    names = {"best": ["node", "other", "met"], "nodes": ["node"]}[wanted]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            ask, node, part, size, shared = (table.column(c).to_numpy() for c in range(2, 7))
            asks, others = np.flatnonzero(ask), np.flatnonzero(~ask)
            if not len(asks) or not len(others):
                continue
            marks = np.frombuffer(b"".join(table.column(7).to_pylist()), np.uint8).reshape(len(ask), -1)
            step = max(1, 4_000_000 // (64 * len(others)))
            for at in range(0, len(asks), step):
                some = asks[at:at + step]
                met, fits = _fits(*((c[some], c[others]) for c in (part, size, shared, marks)), least)
                if wanted == "best":
                    i = np.flatnonzero(fits.any(1))
                    j = np.where(fits, met, 0).argmax(1)[i]
                    out = [node[some[i]], node[others[j]], met[i, j].astype(np.int32)]
                else:
                    out = [np.concatenate([node[some[fits.any(1)]], node[others[fits.any(0)]]])]
                if len(out[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)

    ready = rows.select("bucket", "tile", "ask", "node", "part", "size", "shared", "marks").repartition(
        partitions(rows.sparkSession), "bucket", "tile").sortWithinPartitions("bucket", "tile", "ask", "node")
    return ready.mapInArrow(run, ", ".join(f"{c} {'int' if c == 'met' else 'long'}" for c in names))


def _own_pairs(bucket: int, ask: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ask, other, equal minima) of the pairs that `_fits` leaves and that are this bucket's to look at: it is the first they share,
    and of two outside its largest group the smaller asks. Both sides: node, part, size, shared, marks, buckets, lone."""
    met, fits = _fits(*zip(ask[1:5], other[1:5], strict=True), least)
    i, j = np.nonzero(fits)
    first = (ask[5][i] == other[5][j]).argmax(1)
    mine = (ask[5][i, first] == bucket) & (~ask[6][i] | (ask[0][i] < other[0][j]))
    return i[mine], j[mine], met[i[mine], j[mine]]


def _sides(table: pa.Table, at: int) -> tuple[tuple[np.ndarray, ...], np.ndarray, np.ndarray]:
    """The columns of a block (ask and those of `_own_pairs`, from column `at`), which rows ask and which do not."""
    ask, node, part, size, shared = (table.column(at + c).to_numpy() for c in range(5))
    marks = np.frombuffer(b"".join(table.column(at + 5).to_pylist()), np.uint8).reshape(len(ask), -1)
    buckets = table.column(at + 6).combine_chunks().flatten().to_numpy().reshape(len(ask), -1)
    return (node, part, size, shared, marks, buckets, table.column(at + 7).to_numpy()), np.flatnonzero(ask), np.flatnonzero(~ask)


_FACED = ["ask", "node", "part", "size", "shared", "marks", "buckets", "lone"]


def _joining(rows: DataFrame, classes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Links (node, other) that connect the parts which similar pairs among rows (bucket, tile and _FACED) connect: of those that ask
    with those that do not. First the rows that have a pair to verify are found; then their texts meet in blocks of a tile and
    at most about IN_TILE that ask. In a block likelier pairs come first, and pairs of parts already connected there are not compared again, so links are
    fewer than its rows. Pairs themselves are never rows."""
    names = ["bucket", "tile", "ask", "node"]

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 2):
            columns, asks, others = _sides(table, 2)
            if not len(asks) or not len(others):
                continue
            used = np.zeros(table.num_rows, bool)
            step, bucket = max(1, 4_000_000 // (64 * len(others))), table.column(0)[0].as_py()
            for at in range(0, len(asks), step):
                some = asks[at:at + step]
                i, j, _ = _own_pairs(bucket, tuple(c[some] for c in columns), tuple(c[others] for c in columns), least)
                used[some[i]] = used[others[j]] = True
            if used.any():
                yield from table.select([0, 1, 2, 3]).rename_columns(names).filter(pa.array(used)).to_batches()

    n = partitions(rows.sparkSession)
    ready = rows.select("bucket", "tile", *_FACED).repartition(n, "bucket", "tile").sortWithinPartitions("bucket", "tile", "ask", "node")
    found = cut(ready.mapInArrow(hits, "bucket long, tile int, ask boolean, node long"))
    bodies = _texts_of(found.select("node"), classes, texts)
    blocks = found.where("ask").groupBy("bucket", "tile").agg(F.ceil(F.count("*") / IN_TILE).cast("int").alias("blocks"))
    whole = rows.join(found, names).join(cut(blocks), ["bucket", "tile"]).withColumn("block", F.explode(F.when(
        F.col("ask"), F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1)))).join(bodies, "node")

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _grouped(batches, 3):
            columns, asks, others = _sides(table, 3)
            if not len(asks) or not len(others):
                continue
            bodies, sets = table.column(11).cast(pa.binary()), {}
            step, bucket = max(1, 4_000_000 // (64 * len(others))), table.column(0)[0].as_py()
            pairs = []
            for at in range(0, len(asks), step):
                some = asks[at:at + step]
                i, j, met = _own_pairs(bucket, tuple(c[some] for c in columns), tuple(c[others] for c in columns), least)
                pairs.append((some[i], others[j], met))
            a, b, met = (np.concatenate(p) for p in zip(*pairs, strict=True))
            order = np.lexsort((b, a, -met.astype(np.int64)))
            node, part = columns[0].tolist(), columns[1].tolist()
            above = {p: p for p in part}

            def top(p: int) -> int:
                while above[p] != p:
                    above[p] = p = above[above[p]]
                return p

            def held(k: int) -> np.ndarray:
                if k not in sets:
                    sets[k] = shingles(bodies[k].as_py())
                return sets[k]

            out = []
            for x, y in zip(a[order].tolist(), b[order].tolist(), strict=True):
                p, q = top(part[x]), top(part[y])
                if p != q and jaccard(held(x), held(y)) >= least:
                    above[p] = q
                    out.append((node[x], node[y]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in out], pa.int64()) for c in (0, 1)], names=["node", "other"])

    dealt = whole.select("bucket", "tile", "block", *_FACED, "text").repartition(n, "bucket", "tile", "block").sortWithinPartitions("bucket", "tile", "block", "ask", "node")
    return cut(dealt.mapInArrow(links, "node long, other long"))


def _shared_counts(texts: DataFrame) -> DataFrame:
    """(node, shared): how many of a text's shingles some other text of the table (node, text) holds too."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                found = shingles(text.as_py()).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), node)), pa.array(found)], names=["node", "hash"])

    hashes = cut(texts.mapInArrow(run, "node long, hash long"))
    common = hashes.groupBy("hash").count().where("count > 1").select("hash")
    return hashes.join(common, "hash", "left_semi").groupBy("node").agg(F.count("*").alias("shared"))


def _texts_of(nodes: DataFrame, classes: DataFrame, texts: DataFrame) -> DataFrame:
    """(node, text) of some classes. Only their ids meet the texts, and texts whose ids are surely not among them are not moved."""
    wanted = cut(nodes.distinct().join(classes.select("node", "id", "key"), "node"))
    return with_hint(texts, wanted, ["id"]).where("_hint").join(wanted, ["id", "key"]).dropDuplicates(["node"]).select("node", "text")


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """Those pairs (node, other) whose shingles are similar. Pairs are dealt to blocks by both hashes; a text goes once to each
    block that has a pair of it, at most twice the square root of the number of blocks."""
    pairs = cut(pairs.select("node", "other"))
    side = max(1, math.ceil(math.sqrt(pairs.count() / BLOCK)))
    dealt = pairs.select("node", "other", F.pmod(F.xxhash64("node"), F.lit(side)).alias("a"), F.pmod(F.xxhash64("other"), F.lit(side)).alias("b"))
    named = dealt.select("a", "b", "node").union(dealt.select("a", "b", "other")).distinct()
    bodies = named.join(_texts_of(named.select("node"), classes, texts), "node").select("a", "b", F.lit(False).alias("pair"), "node", F.lit(None).cast("long").alias("other"), "text")
    rows = bodies.unionByName(dealt.select("a", "b", F.lit(True).alias("pair"), "node", "other", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, sets = None, {}
        for batch in batches:
            found = []
            a, b, pair, node, other = (batch.column(c).to_pylist() for c in range(5))
            text = batch.column(5).cast(pa.binary())
            for k in range(batch.num_rows):
                if block != (a[k], b[k]):
                    block, sets = (a[k], b[k]), {}
                if not pair[k]:
                    sets[node[k]] = shingles(text[k].as_py())
                elif jaccard(sets[node[k]], sets[other[k]]) >= least:
                    found.append((node[k], other[k]))
            yield pa.RecordBatch.from_arrays([pa.array([f[c] for f in found], pa.int64()) for c in (0, 1)], names=["node", "other"])

    ready = rows.repartition(min(side * side, 4 * partitions(pairs.sparkSession)), "a", "b").sortWithinPartitions("a", "b", "pair", "node")
    return cut(ready.mapInArrow(run, "node long, other long"))


def _close_prints(marked: DataFrame) -> DataFrame:
    """Links (node, other) that connect the classes (column whole) of all texts whose fingerprints BK-trees find within the radius, op2's links."""
    held = cut(marked.select(F.xxhash64("whole").alias("node"), "fp").distinct())
    groups = cut(components(link(held.select("fp").distinct())))
    of = cut(held.join(groups, held.fp == groups.node, "left").select(held.node, F.coalesce("component", "fp").alias("part")).distinct())
    first = of.groupBy("part").agg(F.min("node").alias("other"))
    return of.join(first, "part").where(F.col("node") != F.col("other")).select("node", "other").distinct()


def repeated_in_groups(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(gone): ids all whose rows have a document of a smaller id in their group. Groups are what op2's links (SimHash fingerprints within three
    bits, found by BK-trees) and similar documents that share a band connect together, so of a group one document stays, and one may go that is similar to it only through others.

    Texts with equal shingles are one class. First each class is compared with its buckets' leaders, the medoid of each tile and
    the smallest ids: the one most like it by their minima is verified. That joins a group of copies whatever its size. Then
    classes of different groups that still share a bucket are compared, all but those within a bucket's largest group: those that the bounds on
    sizes and minima leave are looked at for the shingles they share with any other of them, and the pairs that this bound leaves
    too are verified where their texts meet (`_joining`), until their groups are connected. There are two passes whatever the data; hot buckets are cut into tiles."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, sizes, marks, buckets, prints = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                found = shingles(text)
                low = minima(found)
                prints.append(fingerprint(text))
                whole.append(xxhash.xxh3_128_hexdigest(found.tobytes()))
                sizes.append(len(found))
                marks.append((low >> np.uint64(17)).astype(np.uint8).tobytes())
                buckets.append(np.array([xxhash.xxh64_intdigest(r.tobytes(), b) for b, r in enumerate(low.reshape(BANDS, ROWS))] if len(found) else [], np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(whole, pa.string()), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary()),
                                              pa.array(buckets, pa.list_(pa.int64())), pa.array(np.array(prints, np.uint64).view(np.int64), pa.int64())],
                                             names=["id", "key", "whole", "size", "marks", "buckets", "fp"])

    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.md5("text"), F.lit("")).alias("key"), "text")
    marked = cut(texts.mapInArrow(run, "id long, key string, whole string, size long, marks binary, buckets array<long>, fp long"))
    classes = cut(marked.groupBy("whole").agg(F.min(F.struct("id", "key")).alias("first"), F.min("size").alias("size"), F.min("marks").alias("marks"), F.min("buckets").alias("buckets")).select(
        "whole", F.xxhash64("whole").alias("node"), "first.id", "first.key", "size", "marks", "buckets"))
    entered = classes.select(F.explode("buckets").alias("bucket"), "node", "id", "size", "marks")
    counts = entered.groupBy("bucket").count().where("count > 1").select("bucket", F.ceil(F.col("count") / IN_TILE).cast("int").alias("tiles"))
    members = cut(entered.join(cut(counts), "bucket").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int")))
    told = lambda ask: F.lit(ask).alias("ask")
    columns = ["bucket", "node", "size", "marks"]
    whole = F.col("size").alias("shared")
    first = members.withColumn("k", F.row_number().over(Window.partitionBy("bucket").orderBy("id", "node"))).where(F.col("k") <= LEADERS)
    leaders = first.select("bucket", "node").union(_medoids(members)).distinct()
    every = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile")
    own = F.col("node").alias("part")
    led = members.join(cut(leaders), ["bucket", "node"], "left_semi").select(*columns, every, told(False), own, whole).unionByName(members.select(*columns, "tile", told(True), own, whole))
    nearest = _plausible(led, least, "best").groupBy("node").agg(F.max_by("other", F.struct("met", "other")).alias("other"))
    links = cut(_verified(nearest, classes, texts, least).unionByName(_close_prints(marked)))
    groups = cut(components(links.select(F.col("node").alias("u"), F.col("other").alias("v"))))
    parted = cut(members.join(groups, "node", "left").select(*columns, F.coalesce("component", "node").alias("part")))
    main = parted.groupBy("bucket", "part").count().groupBy("bucket").agg(F.max_by("part", F.struct("count", "part")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most"))
    mixed = cut(main.where("n > most").select("bucket", "main", F.ceil((F.col("n") - F.col("most")) / IN_TILE).cast("int").alias("tiles")))
    open_ = parted.join(mixed, "bucket").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))

    def facing(rows: DataFrame, *shared: F.Column | str) -> DataFrame:
        return rows.select(*columns, every, told(True), "part", *shared).unionByName(rows.where("part <> main").select(*columns, "tile", told(False), "part", *shared))

    flagged = cut(_plausible(facing(open_, whole), least, "nodes").distinct())
    counts = cut(_shared_counts(_texts_of(flagged, classes, texts)))
    bounded = open_.join(counts, "node").join(classes.select("node", "buckets"), "node")
    more = _joining(facing(bounded, F.col("shared"), "buckets", (F.col("part") != F.col("main")).alias("lone")), classes, texts, least)
    groups = cut(components(links.unionByName(more).select(F.col("node").alias("u"), F.col("other").alias("v"))))
    named = classes.join(groups, "node", "left").select("whole", "id", F.coalesce("component", "node").alias("part"))
    smallest = named.groupBy("part").agg(F.min("id").alias("first"))
    fate = cut(named.join(cut(smallest), "part").select("whole", "first"))
    rows = marked.select("id", "whole").join(fate, "whole").select("id", (F.col("first") < F.col("id")).alias("out"))
    return rows.groupBy("id").agg(F.min("out").alias("out")).where("out").select(F.col("id").alias("gone"))


def similar_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pipeline's stage: of documents that op2's links or similar five-word shingles connect, the one with the smallest id stays, with
    all rows of that id; rows without an id stay. op2's links alone (three words, three bits) miss most copies of 0.8 to 0.95."""
    gone = repeated_in_groups(docs)
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


def keep_one_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """op2's contract as a stage: of each component the document with the smallest id stays, with all rows of that id; rows without an id stay."""
    best = near_duplicates(docs).where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("component_id").alias("_best"))
    gone = best.where(F.col("_best") < F.col("doc_id")).select(F.col("doc_id").alias("_gone"))
    return docs.join(gone, F.col("doc_id") == F.col("_gone"), "left_anti")
