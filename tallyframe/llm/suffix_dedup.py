"""Suffix-array dedup: repeats of 100 bytes and more, by threshold-bounded interval expansion.

A window of 100 bytes is judged together with all windows that could equal it. Its anchor, the 32
bytes in it with the smallest hash, is part of its content, so equal windows have equal anchors, and
neighbouring windows that share one form a run. Three steps find every repeated window:

1. Runs equal as a whole repeat all their windows; only the first such run goes on (`occurrences`).
   Runs whose anchor no other content has are free of repeats.
2. What is left, the first run of each content whose anchor other contents share, goes to the
   anchor's bucket. There each text is cut down to the windows whose hash another window has, for no other can be
   repeated. What is left is put together, its suffixes sorted to a bounded depth, and
   the Burrows-Wheeler transform is extended backwards, breadth first: from the intervals of all strings of
   length l come those of length l + 1, and every new boundary between intervals is a common prefix of
   length l. At the minimum length expansion stops; suffixes without a boundary between them share at
   least 100 bytes. All but the first of them are repeats. Anchors with very many contents are dealt out
   window by window, keyed by the window's hash, to keep buckets small.
3. The repeats' bytes are removed from their documents.

Null and empty texts have no bytes. Rows repeating id and text are one document and get one result;
rows without an id are documents before all others; rows with one id and different texts are ordered
by the texts' hashes. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, cut, partitions, read, utf8, with_hint
from .occurrences import HOT, NULL_ID, REPEAT, SHARED, SPREAD, by_bucket, document_bucket, keyed, marks, mix, pack, per_document, ranked, split

#: Bytes of a repeat and of an anchor; bytes handled at once when anchors are sought (their numbers stay in a core's cache), and by one transform.
MIN_LENGTH, ANCHOR, PIECE, TRANSFORM = 100, 32, 1 << 19, 1 << 20
_WIDTH = MIN_LENGTH - ANCHOR + 1
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mix(np.arange(257, 513))


def pieces(offsets: np.ndarray) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first document, edges of its and the next documents' bytes, bytes of the first document left out before them):
    groups of whole documents, and parts of long ones that overlap by a window less one byte."""
    at, n = 0, len(offsets) - 1
    while at < n:
        if offsets[at + 1] - offsets[at] > PIECE:
            for start in range(int(offsets[at]), int(offsets[at + 1]) - MIN_LENGTH + 1, PIECE):
                yield at, np.array([start, min(start + PIECE + MIN_LENGTH - 1, int(offsets[at + 1]))]), start - int(offsets[at])
            at += 1
            continue
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        yield at, offsets[at:stop + 1], 0
        at = stop


def runs(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, place in the batch's bytes, number of windows, anchor) of all runs of a batch, in order."""
    found = []
    powers = [np.uint64(pow(int(_BASE), 1 << i, 1 << 64)) for i in range(5)]
    for first, edges, _ in pieces(offsets):
        part = data[edges[0]:edges[-1]]
        n = len(part)
        if n < MIN_LENGTH:
            continue
        rolled = _BYTES[part]
        for i, power in enumerate(powers):
            span = 1 << i
            rolled = rolled[:-span] * power + rolled[span:]
        order = (mix(rolled) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(rolled), dtype=np.uint64)
        span = 1
        while span * 2 <= _WIDTH:
            order = np.minimum(order[:-span], order[span:])
            span *= 2
        order = np.minimum(order[:len(order) - (_WIDTH - span)], order[_WIDTH - span:])
        anchor = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        doc = np.repeat(np.arange(len(edges) - 1), np.diff(edges))[:len(anchor)]
        valid = np.arange(len(anchor)) + MIN_LENGTH <= (edges[1:] - edges[0])[doc]
        begins = valid.copy()
        begins[1:] &= ~valid[:-1] | (anchor[1:] != anchor[:-1])
        start = np.flatnonzero(begins)
        if len(start):
            found.append((doc[start] + first, start + int(edges[0]), np.bincount(np.cumsum(begins)[valid] - 1), mix(rolled[anchor[start]] ^ _BASE)))
    if not found:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    return tuple(np.concatenate([f[i] for f in found]) for i in range(4))


def _numbered(doc: np.ndarray, size: int) -> np.ndarray:
    return np.arange(len(doc)) - np.searchsorted(doc, np.arange(size))[doc] if len(doc) else doc


def _items(offsets: np.ndarray, data: np.ndarray):
    doc, start, windows, anchor = runs(offsets, data)
    body, digest = data.tobytes(), xxhash.xxh3_64_intdigest
    whole = np.fromiter((digest(body[a:b]) for a, b in zip(start.tolist(), (start + windows + MIN_LENGTH - 1).tolist(), strict=True)), np.uint64, len(start))
    return doc, _numbered(doc, len(offsets) - 1), anchor, whole


def bounded_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Rotations of text (values below 512) in the order of their first `depth` characters or more."""
    n = len(text)
    rank = np.zeros(n, np.int64)
    for i in range(7):
        rank = rank << 9 | np.roll(text, -i)
    rank = np.unique(rank, return_inverse=True)[1]
    known = 7
    while known < depth:
        rank = np.unique(rank * n + np.roll(rank, -known), return_inverse=True)[1]
        known *= 2
    return np.argsort(rank, kind="stable")


def bounded_boundaries(bwt: np.ndarray, limit: int) -> np.ndarray:
    """For each place in suffix order, whether the suffix there shares less than `limit` characters with the one before.

    Level by level: the interval of w in the order, extended by a character c that precedes it, is the interval
    of cw. Its right edge is just after the row of the last c within; if no boundary was there, the two suffixes
    that meet there share exactly the level's length, and cw's interval is worth expanding in turn."""
    n = len(bwt)
    order = np.argsort(bwt, kind="stable")
    row = np.empty(n, np.int64)
    row[order] = np.arange(n)
    after, before = np.full(n, n), np.full(n, -1)
    same = bwt[order[1:]] == bwt[order[:-1]]
    after[order[:-1][same]], before[order[1:][same]] = order[1:][same], order[:-1][same]
    edge = np.zeros(n + 1, bool)
    edge[[0, n]] = True
    lo, hi = np.array([0]), np.array([n])
    for _ in range(limit):
        if not len(lo):
            break
        width = hi - lo
        owner = np.repeat(np.arange(len(lo)), width)
        at = np.arange(len(owner)) + np.repeat(lo - (np.cumsum(width) - width), width)
        last = np.flatnonzero(after[at] >= hi[owner])
        right = row[at[last]] + 1
        fresh = ~edge[right]
        last, right = last[fresh], right[fresh]
        first = np.flatnonzero(before[at] < lo[owner])
        key = owner[first] * 512 + bwt[at[first]]
        by_key = np.argsort(key)
        left = row[at[first[by_key[np.searchsorted(key[by_key], owner[last] * 512 + bwt[at[last]])]]]]
        edge[right] = True
        lo, hi = left, right
    return edge[:n]


def _hashes(data: np.ndarray, length: int) -> np.ndarray:
    """A hash of each `length` bytes, put together from those of powers of two."""
    n = len(data) - length + 1
    found, done, span, block = np.zeros(n, np.uint64), 0, 1, _BYTES[data]
    while True:
        if length & span:
            found = found * np.uint64(pow(int(_BASE), span, 1 << 64)) + block[done:done + n]
            done += span
        if span * 2 > length:
            return found
        block = block[:-span] * np.uint64(pow(int(_BASE), span, 1 << 64)) + block[span:]
        span *= 2


def _alike(texts: list[bytes], windows: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last window) of the texts with windows whose hash another window has. No other window can equal one."""
    sizes = np.array([len(t) for t in texts])
    starts = np.cumsum(sizes) - sizes
    text = np.repeat(np.arange(len(texts)), windows)
    window = _numbered(text, len(texts))
    hashes = _hashes(np.frombuffer(b"".join(texts), np.uint8), length)[starts[text] + window]
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    some = np.zeros(len(hashes), bool)
    some[order[1:][same]] = some[order[:-1][same]] = True
    text, window = text[some], window[some]
    new = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])) if len(text) else np.zeros(0, bool))
    return text[new], window[new], window[np.append(new[1:], len(text)) - 1] if len(text) else window


def repeated(texts: list[bytes], windows: np.ndarray, place: np.ndarray, length: int = MIN_LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(text, window) of the windows that an earlier one equals. place: of each text's first window, to be compared."""
    whole, first, last = _alike(texts, windows, length)
    if not len(whole):
        return whole, first
    texts = [texts[i][a:b + length] for i, a, b in zip(whole.tolist(), first.tolist(), last.tolist(), strict=True)]
    text, window = _transformed(texts, last - first + 1, place[whole] + first, length)
    return whole[text], window + first[text]


def _transformed(texts: list[bytes], windows: np.ndarray, place: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The same by suffix order and transform, exactly."""
    sizes = np.array([len(t) + 1 for t in texts])
    starts = np.cumsum(sizes) - sizes
    joined = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.int64) + 1
    joined[starts + sizes - 1] = 0  # a mark that no byte equals
    order = bounded_order(joined, length)
    edge = bounded_boundaries(joined[order - 1], length)
    group = np.empty(len(joined), np.int64)
    group[order] = np.cumsum(edge)
    text = np.repeat(np.arange(len(texts)), windows)
    window = _numbered(text, len(texts))
    group, key = group[starts[text] + window], place[text] + window
    by = np.lexsort((key, group))
    g, k = group[by], key[by]
    head = np.maximum.accumulate(np.where(np.concatenate(([True], g[1:] != g[:-1])), np.arange(len(g)), 0))
    again = np.sort(by[k > k[head]])
    return text[again], window[again]


def _collected(payloads: list[bytes]) -> tuple[np.ndarray, ...]:
    """ids, hashes, rank, start, windows, anchor and text of the runs in payloads."""
    out = []
    for p in payloads:
        docs, items = np.frombuffer(p, np.int64, 2).tolist()
        head = 16 + docs * 20
        ids, hashes = np.frombuffer(p, np.int64, docs, 16), np.frombuffer(p, np.int64, docs, 16 + 8 * docs)
        doc = np.repeat(np.arange(docs), np.frombuffer(p, np.uint32, docs, 16 + 16 * docs))
        start, windows, anchor = np.frombuffer(p, np.uint32, items, head), np.frombuffer(p, np.uint32, items, head + 4 * items), np.frombuffer(p, np.uint64, items, head + 8 * items)
        ends = head + 16 * items + np.cumsum(windows.astype(np.int64) + MIN_LENGTH - 1)
        out.append((ids, hashes, doc, start, windows, anchor, [p[e - w - MIN_LENGTH + 1:e] for e, w in zip(ends.tolist(), windows.tolist(), strict=True)]))
    base = np.cumsum([0] + [len(x[0]) for x in out[:-1]])
    rank, ids, hashes = ranked(np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out]))
    return ids, hashes, rank[np.concatenate([x[2] + b for x, b in zip(out, base, strict=True)])], *(np.concatenate([x[i] for x in out]) for i in (3, 4, 5)), [t for x in out for t in x[6]]


def _candidates(joined: DataFrame, buckets: int) -> DataFrame:
    """From (k, h, text, marks): rows of kind 2 with the spans of a document's repeated runs (k, h), and rows of kind 1
    with the texts of runs to compare, by bucket."""
    schema = "kind byte, bucket int, k long, h long, payload binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ks, hs = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            offsets, data = utf8(batch.column(2))
            doc, start, windows, anchor = runs(offsets, data)
            first = np.searchsorted(doc, np.arange(len(offsets)))
            rows, picked = [], []
            for d, mark in enumerate(batch.column(3).to_pylist()):
                if not mark:
                    continue
                idx, kind = split(mark, (np.uint32, np.uint8))
                at = first[d] + np.sort(idx[kind == REPEAT].astype(np.int64))
                if len(at):
                    begin = start[at] - offsets[d]
                    rows.append((2, 0, int(ks[d]), int(hs[d]), begin.astype(np.uint32).tobytes() + (windows[at] + MIN_LENGTH - 1).astype(np.uint32).tobytes()))
                picked += [(first[d] + idx[kind == SHARED].astype(np.int64), False), (first[d] + idx[kind == HOT].astype(np.int64), True)]
            plain = np.concatenate([p for p, hot in picked if not hot] or [np.zeros(0, np.int64)])
            hot = np.concatenate([p for p, hot in picked if hot] or [np.zeros(0, np.int64)])
            alone = np.repeat(hot, windows[hot])  # each window of a hot run by itself
            place = np.concatenate([start[plain], start[alone] + _numbered(np.repeat(np.arange(len(hot)), windows[hot]), len(hot))])
            size = np.concatenate([windows[plain], np.ones(len(alone), np.int64)])
            owner = np.concatenate([doc[plain], doc[alone]])
            body = data.tobytes()
            own = np.fromiter((xxhash.xxh3_64_intdigest(body[p:p + MIN_LENGTH]) for p in place[len(plain):].tolist()), np.uint64, len(alone))
            key = np.concatenate([anchor[plain], own])
            for b, some in by_bucket((mix(key) % np.uint64(buckets)).astype(np.int64)):
                some = some[np.argsort(owner[some], kind="stable")]
                texts = b"".join(body[p:p + w + MIN_LENGTH - 1] for p, w in zip(place[some].tolist(), size[some].tolist(), strict=True))
                payload = pack(owner[some], ks, hs, (place[some] - offsets[owner[some]]).astype(np.uint32), size[some].astype(np.uint32), key[some]) + texts
                rows.append((1, b, None, None, payload))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int8(), pa.int32(), pa.int64(), pa.int64(), pa.binary()))], names=["kind", "bucket", "k", "h", "payload"])

    return joined.mapInArrow(run, schema)


def _compared(candidates: DataFrame, buckets: int) -> DataFrame:
    """(k, h, marks) with the starts and lengths of repeated bytes found by comparing the runs of each bucket."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [p for batch in batches for p in batch.column(1).to_pylist()]
        if not held:
            return
        ids, hashes, rank, start, windows, anchor, texts = _collected(held)
        held.clear()
        order = np.argsort(anchor, kind="stable")
        cuts = np.flatnonzero(np.concatenate(([True], anchor[order][1:] != anchor[order][:-1], [True])))
        total = np.concatenate(([0], np.cumsum(windows[order].astype(np.int64) + MIN_LENGTH)))
        at = 0
        while at < len(cuts) - 1:
            stop = max(at + 1, int(np.searchsorted(total[cuts], total[cuts[at]] + TRANSFORM, "right")) - 1)
            some = order[cuts[at]:cuts[stop]]
            at = stop
            text, window = repeated([texts[i] for i in some.tolist()], windows[some].astype(np.int64), (rank[some] << 32) | start[some].astype(np.int64))
            if not len(text):
                continue
            new = np.concatenate(([True], (text[1:] != text[:-1]) | (window[1:] != window[:-1] + 1)))
            head = np.flatnonzero(new)
            count = np.diff(np.append(head, len(text)))
            run_of = some[text[head]]
            begin, size = (start[run_of] + window[head]).astype(np.uint32), (count + MIN_LENGTH - 1).astype(np.uint32)
            rows = [(b, pack(rank[run_of[r]], ids, hashes, begin[r], size[r])) for b, r in by_bucket(document_bucket(ids, buckets)[rank[run_of]])]
            yield pa.RecordBatch.from_arrays([pa.array([1] * len(rows), pa.int8()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["kind", "bucket", "payload"])

    n = partitions(candidates.sparkSession)
    found = candidates.where("kind = 1").select("bucket", "payload").repartition(n, "bucket").mapInArrow(run, "kind byte, bucket int, payload binary")
    return per_document(found, (np.uint32, np.uint32))


def repeats(docs: DataFrame) -> DataFrame:
    """(k, h, spans) for documents (k, h, text) with repeated bytes; spans: list of packed starts and lengths."""
    buckets = partitions(docs.sparkSession) * SPREAD
    marked = cut(marks(docs, _items))
    # Texts without a marked run are not moved to meet marks.
    joined = with_hint(docs, marked, ["k", "h"]).where("_hint").join(marked, ["k", "h"]).select("k", "h", "text", "marks")
    candidates = cut(_candidates(joined, buckets))
    whole = candidates.where("kind = 2").select("k", "h", F.col("payload").alias("marks"))
    return whole.unionByName(_compared(candidates, buckets)).groupBy("k", "h").agg(F.collect_list("marks").alias("spans"))


def covered(spans: list[bytes] | None) -> list[tuple[int, int]]:
    """Merged (start, end) byte spans."""
    parts = [split(s, (np.uint32, np.uint32)) for s in spans or ()]
    out: list[list[int]] = []
    for a, n in sorted((a, n) for p in parts for a, n in zip(p[0].tolist(), p[1].tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


RESULT = T.StructType([T.StructField("n_bytes", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
                       T.StructField("kept", T.BinaryType())])
_RESULT = pa.struct([("n_bytes", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])


def _removed(rows: pa.Array) -> pa.Array:
    offsets, data = utf8(rows.field("text"))
    body, result = data.tobytes(), []
    for d, spans in enumerate(rows.field("spans").to_pylist()):
        base, size = int(offsets[d]), int(offsets[d + 1] - offsets[d])
        gone = covered(spans)
        edges = [0, *(x for s in gone for x in s), size]
        result.append({"n_bytes": size, "removed": [{"start": a, "end": b} for a, b in gone], "kept": b"".join(body[base + edges[i]:base + edges[i + 1]] for i in range(0, len(edges), 2))})
    return pa.array(result, _RESULT)


def dedup_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "repeats") -> DataFrame:
    """(id, struct `out`): bytes, removed spans (byte offsets) and the bytes kept."""
    whole = keyed(docs, id_col, text_col)
    joined = whole.join(repeats(whole), ["k", "h"], "left").select("k", F.struct("text", "spans").alias("both"))
    return append_column(joined, out, RESULT, "both", _removed).select(F.when(F.col("k") != NULL_ID, F.col("k")).alias(id_col), out)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.col("repeats")
    return dedup_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", found["n_bytes"].alias("n_bytes"), (found["n_bytes"] - F.length(found["kept"])).cast("long").alias("n_removed"),
        F.size(found["removed"]).cast("long").alias("n_spans"), F.sha2(found["kept"], 256).alias("kept_sha256"))


def cut_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated bytes; n_chars follows. Broken characters at the edges go as a whole: bytes
    of a cut character are dropped. Documents that nothing is left of go; untouched ones stay as they are, empty ones too."""
    row = docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)), "_h": F.xxhash64("text")})
    spans = cut(repeats(keyed(docs)).select(F.col("k").alias("_k"), F.col("h").alias("_h"), F.col("spans").alias("_spans")))
    hinted = with_hint(row, spans, ["_k", "_h"])
    # Documents without repeats stay where they are; only the others meet their spans.
    met = hinted.where("_hint").join(spans, ["_k", "_h"], "left").unionByName(hinted.where("NOT _hint").withColumn("_spans", F.lit(None).cast(spans.schema["_spans"].dataType)))
    joined = met.drop("_hint").withColumn("_both", F.struct(F.col("text").alias("text"), F.col("_spans").alias("spans")))

    def kept(rows: pa.Array) -> pa.Array:
        done = _removed(rows)
        return pa.array([k.decode("utf-8", "ignore") if r else None for k, r in zip(done.field("kept").to_pylist(), done.field("removed").to_pylist(), strict=True)], pa.string())

    cleaned = append_column(joined, "_kept", T.StringType(), "_both", kept).where("_kept IS NULL OR _kept <> ''")
    changes = {"text": F.coalesce("_kept", "text")}
    if "n_chars" in docs.columns:
        changes["n_chars"] = F.when(F.col("_kept").isNotNull(), F.length("_kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return cleaned.withColumns(changes).select(*docs.columns)


#: Every window of 100 bytes as hexadecimal text, so only for small tables; texts repeat no id there.
ORACLE = """
WITH texts AS (SELECT doc_id, CAST(hex(encode(coalesce(text, ''))) AS VARCHAR) AS x FROM documents),
windows AS (SELECT doc_id, p, md5(substr(x, 2 * p + 1, 200)) AS w FROM (SELECT doc_id, x, unnest(range(0, length(x) // 2 - 99)) AS p FROM texts WHERE length(x) >= 200)),
repeats AS (SELECT doc_id, p FROM windows QUALIFY row_number() OVER (PARTITION BY w ORDER BY doc_id, p) > 1),
marked AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 100 THEN 0 ELSE 1 END AS new FROM repeats),
numbered AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS k FROM marked),
spans AS (SELECT doc_id, k, min(p) AS a, max(p) + 100 AS b FROM numbered GROUP BY doc_id, k),
edges AS (SELECT doc_id, k, b AS a, coalesce(lead(a) OVER (PARTITION BY doc_id ORDER BY k), 1000000000) AS b FROM (SELECT doc_id, k, a, b FROM spans UNION ALL SELECT doc_id, 0, 0, 0 FROM texts)),
kept AS (SELECT doc_id, sha256(unhex(string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY k))) AS kept_sha256 FROM edges JOIN texts USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(x) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, kept_sha256
FROM texts JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id) USING (doc_id)
"""
