"""Which occurrences of a key are not its first one, for more keys than fit anywhere.

Documents yield items (number of the item in the document, 128-bit key). Tasks look for repeats among
what they have read, so that a key held by many documents leaves a task once; what is left travels to
the key's bucket in packed arrays, where the first occurrence overall is found. Marks on items travel
back to their documents in the same form. Occurrences are ordered by document id (nulls first), text
hash and item number; rows that repeat id and text are one document.

Marks: REPEAT, an earlier item has this key; SHARED, this is the first item with the key, and another
key has the same first half; HOT, as SHARED, with more than `HOT_KEYS` such keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, utf8

REPEAT, SHARED, HOT = 1, 2, 3
HOT_KEYS, LOAD, SPREAD = 4096, 1_000_000, 8
NULL_ID = -(1 << 63)

Items = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(k, h, text): the id with nulls replaced, and a hash of the text."""
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), F.xxhash64(text_col).alias("h"), F.col(text_col).cast("string").alias("text"))


def pack(doc: np.ndarray, ids: np.ndarray, hashes: np.ndarray, *columns: np.ndarray) -> bytes:
    """Items as bytes: the documents that occur with their number of items, then the columns in document order."""
    order = np.argsort(doc, kind="stable")
    used, count = np.unique(doc, return_counts=True)
    parts = [np.array([len(used), len(doc)], np.int64), ids[used], hashes[used], count.astype(np.uint32), *(c[order] for c in columns)]
    return b"".join(p.tobytes() for p in parts)


def unpack(payload: bytes, *kinds: type) -> tuple[np.ndarray, ...]:
    """ids, hashes, document number of each item, columns."""
    docs, items = np.frombuffer(payload, np.int64, 2).tolist()
    at = 16
    out = []
    for kind, n in ((np.int64, docs), (np.int64, docs), (np.uint32, docs), *((k, items) for k in kinds)):
        out.append(np.frombuffer(payload, kind, n, at))
        at += np.dtype(kind).itemsize * n
    ids, hashes, count, *columns = out
    return ids, hashes, np.repeat(np.arange(docs), count), *columns


def gathered(payloads: list[bytes], *kinds: type) -> tuple[np.ndarray, ...]:
    """Many payloads as one, with documents ranked: ids and hashes sorted, without repeats."""
    parts = [unpack(p, *kinds) for p in payloads]
    ids, hashes = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    base = np.cumsum([0] + [len(p[0]) for p in parts[:-1]])
    rank, ids, hashes = ranked(ids, hashes)
    return ids, hashes, rank[np.concatenate([p[2] + b for p, b in zip(parts, base, strict=True)])], *(np.concatenate([p[3 + i] for p in parts]) for i in range(len(kinds)))


def ranked(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((hashes, ids))
    a, b = ids[order], hashes[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    rank = np.empty(len(a), np.int64)
    rank[order] = np.cumsum(new) - 1
    return rank, a[new], b[new]


def firsts(rank: np.ndarray, idx: np.ndarray, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by key and place, which of these begin a key, which are at a later place than their key's first)."""
    place = (rank << 32) | idx.astype(np.int64)
    order = np.lexsort((place, lo, hi))
    a, b, p = hi[order], lo[order], place[order]
    new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]))) if len(a) else np.zeros(0, bool)
    head = np.maximum.accumulate(np.where(new, np.arange(len(a)), 0)) if len(a) else np.zeros(0, int)
    return order, new, p > p[head]


def by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for rows in np.split(order, cut) if len(order) else ():
        yield int(bucket[rows[0]]), rows


def _rows(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int8()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.binary())], names=["kind", "bucket", "payload"])


def document_bucket(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)


def mark_rows(rank: np.ndarray, ids: np.ndarray, hashes: np.ndarray, buckets: int, *columns: np.ndarray) -> list[tuple[int, int, bytes]]:
    target = document_bucket(ids, buckets)[rank] if len(rank) else rank
    return [(1, b, pack(rank[rows], ids, hashes, *(c[rows] for c in columns))) for b, rows in by_bucket(target)]


def marks(docs: DataFrame, items: Callable[[np.ndarray, np.ndarray], Items]) -> DataFrame:
    """(k, h, marks) for documents (k, h, text) with marked items. items: from offsets and bytes of a batch of texts
    to (document, item number, first and second half of the key) arrays."""
    buckets = partitions(docs.sparkSession) * SPREAD

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def load() -> pa.RecordBatch:
            base = np.cumsum([0] + [len(x[0]) for x in held[:-1]])
            rank, ids, hashes = ranked(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
            doc = rank[np.concatenate([x[2] + b for x, b in zip(held, base, strict=True)])]
            idx, hi, lo = (np.concatenate([x[i] for x in held]) for i in (3, 4, 5))
            held.clear()
            order, new, later = firsts(doc, idx, hi, lo)
            sent, again = order[new], order[later]
            rows = mark_rows(doc[again], ids, hashes, buckets, idx[again].astype(np.uint32), np.full(len(again), REPEAT, np.uint8))
            for b, some in by_bucket((mix(hi[sent]) % np.uint64(buckets)).astype(np.int64)):
                at = sent[some]
                rows.append((0, b, pack(doc[at], ids, hashes, idx[at].astype(np.uint32), hi[at], lo[at])))
            return _rows(rows)

        for batch in batches:
            doc, idx, hi, lo = items(*utf8(batch.column(2)))
            if len(doc):
                held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), doc, idx, hi, lo))
                if sum(len(x[2]) for x in held) >= LOAD:
                    yield load()
        if held:
            yield load()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for batch in batches:
            rows = list(zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True))
            held += [p for kind, _, p in rows if kind == 0]
            passed = [r for r in rows if r[0] == 1]
            if passed:
                yield _rows(passed)
        if held:
            ids, hashes, rank, idx, hi, lo = gathered(held, np.uint32, np.uint64, np.uint64)
            held.clear()
            order, new, later = firsts(rank, idx, hi, lo)
            sorted_hi = hi[order]
            group = np.cumsum(np.concatenate(([0], sorted_hi[1:] != sorted_hi[:-1])))
            keys = np.bincount(group, new)[group]
            mark = np.where(later, REPEAT, np.where(new & (keys > HOT_KEYS), HOT, np.where(new & (keys > 1), SHARED, 0))).astype(np.uint8)
            use = np.flatnonzero(mark)
            at = order[use]
            yield _rows(mark_rows(rank[at], ids, hashes, buckets, idx[at], mark[use]))

    n = partitions(docs.sparkSession)
    schema = "kind byte, bucket int, payload binary"
    found = docs.mapInArrow(emit, schema).repartition(n, "bucket").mapInArrow(resolve, schema)
    return per_document(found, (np.uint32, np.uint8))


def per_document(rows: DataFrame, kinds: tuple) -> DataFrame:
    """(k, h, marks): the packed rows of each document together; marks are the columns' bytes, one after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [p for batch in batches for p in batch.column(2).to_pylist()]
        if held:
            ids, hashes, rank, *columns = gathered(held, *kinds)
            held.clear()
            order = np.argsort(rank, kind="stable")
            columns = [c[order] for c in columns]
            ends = np.searchsorted(rank[order], np.arange(len(ids) + 1))
            for at in range(0, len(ids), 2000):
                some = range(at, min(at + 2000, len(ids)))
                yield pa.RecordBatch.from_arrays([pa.array(ids[some.start:some.stop]), pa.array(hashes[some.start:some.stop]), pa.array(
                    [b"".join(c[ends[i]:ends[i + 1]].tobytes() for c in columns) for i in some], pa.binary())], names=["k", "h", "marks"])

    return rows.repartition(partitions(rows.sparkSession), "bucket").mapInArrow(run, "k long, h long, marks binary")


def split(marks: bytes | None, kinds: tuple) -> list[np.ndarray]:
    """The columns of per_document's marks."""
    data = marks or b""
    n = len(data) // sum(np.dtype(k).itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        out.append(np.frombuffer(data, k, n, at))
        at += np.dtype(k).itemsize * n
    return out
