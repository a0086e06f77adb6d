"""Substring dedup by content-defined chunking.

A gear hash rolls over a document's bytes; where its top bits are zero, and the chunk is long enough,
a chunk ends. Boundaries depend on the last 32 bytes alone, so text moved by an insertion is cut at
the same places again. Chunks are compared by a 128-bit digest, and all but the first occurrence
(smallest document id, then offset) are duplicates. Runs of neighbouring duplicate chunks are removed
if they have `MIN_RUN` bytes, or are a whole document: shorter ones are phrases that recur by chance.

Null and empty texts have no chunks. Rows repeating id and text are one document and get one result;
rows without an id are documents before all others. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, read, utf8
from .occurrences import NULL_ID, REPEAT, keyed, marks, mix, split

#: Bytes of the shortest and longest chunk, zero bits at a boundary (so 32 + 2**5 bytes is the mean), and of the shortest run removed.
MIN_CHUNK, MAX_CHUNK, ZERO_BITS, MIN_RUN = 32, 256, 5, 100
GEAR = mix(np.arange(1, 257)).astype(np.uint32)


def boundaries(data: np.ndarray) -> np.ndarray:
    """Places after which the gear hash of the last 32 bytes has zeros on top."""
    rolled = GEAR[data]
    for span in (1, 2, 4, 8, 16):  # hash of 2, 4, ... 32 bytes
        longer = rolled.copy()
        longer[span:] += rolled[:-span] << np.uint32(span)
        rolled = longer
    return np.flatnonzero(rolled >> np.uint32(32 - ZERO_BITS) == 0) + 1


def chunks(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, end) of all chunks of a batch; places are within the batch's bytes."""
    found = boundaries(data)
    doc, start, end = [], [], []
    edges = offsets.tolist()
    slots = np.searchsorted(found, offsets).tolist()
    places = found.tolist()
    for d in range(len(edges) - 1):
        at, last = edges[d], edges[d + 1]
        for place in [*places[slots[d]:slots[d + 1]], last]:
            if place - at < MIN_CHUNK and place != last:
                continue
            while place - at > MAX_CHUNK:
                doc.append(d)
                start.append(at)
                at += MAX_CHUNK
                end.append(at)
            if place > at and (place - at >= MIN_CHUNK or place == last):
                doc.append(d)
                start.append(at)
                end.append(place)
                at = place
    return np.array(doc, np.int64), np.array(start, np.int64), np.array(end, np.int64)


def _items(offsets: np.ndarray, data: np.ndarray):
    doc, start, end = chunks(offsets, data)
    body = data.tobytes()
    digest = np.frombuffer(b"".join(hashlib.blake2b(body[a:b], digest_size=16).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True)), np.uint64).reshape(-1, 2)
    first = np.searchsorted(doc, np.arange(len(offsets) - 1))
    return doc, np.arange(len(doc)) - first[doc] if len(doc) else doc, digest[:, 0], digest[:, 1]


RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("n_chunks", T.LongType()), T.StructField("n_duplicate", T.LongType()),
                       T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))), T.StructField("kept", T.BinaryType())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RESULT = pa.struct([("n_bytes", pa.int64()), ("n_chunks", pa.int64()), ("n_duplicate", pa.int64()), ("removed", _SPANS), ("kept", pa.binary())])


def dedup_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "chunked") -> DataFrame:
    """(id, struct `out`): bytes, chunks, duplicate chunks, removed spans (byte offsets) and the bytes kept."""
    whole = keyed(docs, id_col, text_col)
    joined = whole.join(marks(whole, _items), ["k", "h"], "left").select("k", F.struct("text", "marks").alias("both"))

    def run(rows: pa.Array) -> pa.Array:
        offsets, data = utf8(rows.field("text"))
        doc, start, end = chunks(offsets, data)
        first = np.searchsorted(doc, np.arange(len(offsets)))
        body = data.tobytes()
        result = []
        for d, mark in enumerate(rows.field("marks").to_pylist()):
            idx, kind = split(mark, (np.uint32, np.uint8))
            a, b = first[d], first[d + 1]
            again = np.zeros(b - a, bool)
            again[idx[kind == REPEAT]] = True
            spans, base = [], int(offsets[d])
            for i in np.flatnonzero(again).tolist():
                s, e = int(start[a + i]) - base, int(end[a + i]) - base
                if spans and spans[-1][1] == s:
                    spans[-1][1] = e
                else:
                    spans.append([s, e])
            size = int(offsets[d + 1]) - base
            spans = [s for s in spans if s[1] - s[0] >= MIN_RUN or s[1] - s[0] == size]
            edges = [0, *(x for s in spans for x in s), size]
            kept = b"".join(body[base + edges[i]:base + edges[i + 1]] for i in range(0, len(edges), 2))
            result.append({"n_bytes": size, "n_chunks": int(b - a), "n_duplicate": int(again.sum()), "removed": [{"start": s, "end": e} for s, e in spans], "kept": kept})
        return pa.array(result, _RESULT)

    found = append_column(joined, out, RESULT, "both", run)
    return found.select(F.when(F.col("k") != NULL_ID, F.col("k")).alias(id_col), out)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("chunked")
    return dedup_chunks(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", found["n_bytes"].alias("n_bytes"), found["n_chunks"].alias("n_chunks"), found["n_duplicate"].alias("n_duplicate"),
        (found["n_bytes"] - F.length(found["kept"])).alias("n_removed"), F.size(found["removed"]).cast("long").alias("n_spans"), F.sha2(found["kept"], 256).alias("kept_sha256"))
