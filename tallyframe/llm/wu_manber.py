"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of ten consecutive words of a benchmark item (a shorter item is one pattern).
Words are the alphabet: patterns of equal length share one search with a shift table over blocks of
two words, buckets by the hash of the last block, and a direct comparison. Documents are never
shuffled: the patterns go to the tasks in blocks of bounded size, one map over the documents each.

Null and empty texts have no words and no hits. Rows are judged one by one, so repeated rows and
repeated or null ids get equal results. An empty benchmark hits nothing.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import append_column, read

#: Words per window, and the most patterns that one broadcast holds.
WINDOW, BLOCK_PATTERNS = 10, 200_000
#: Fixed rule: A-Z become a-z, every other ASCII character that is no digit or letter separates words.
SEPARATE = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() and b < 0x80 else 0x20 for b in range(256))

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.LongType())),
])


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(SEPARATE).split()


class Search:
    """Shift table, suffix buckets and patterns of one pattern length."""

    def __init__(self, length: int, patterns: dict[tuple[int, ...], set[int]], base: int) -> None:
        self.length, self.block, self.base = length, min(2, length), base
        self.shift: dict[int, int] = {}
        self.buckets: dict[int, dict[int, list[tuple[tuple[int, ...], set[int]]]]] = {}
        self.far = length - self.block + 1
        for pattern, items in patterns.items():
            for end in range(self.block, length + 1):
                key = self.key(pattern, end)
                self.shift[key] = min(self.shift.get(key, self.far), length - end)
            self.buckets.setdefault(self.key(pattern, length), {}).setdefault(pattern[0], []).append((pattern, items))

    def key(self, ids, end: int) -> int:
        """Of the block of words that ends before position `end`."""
        return ids[end - 1] if self.block == 1 else ids[end - 2] * self.base + ids[end - 1]

    def find(self, ids: list[int]):
        """(start, items) of every occurrence, by start. Words outside the patterns have id 0."""
        length, far, shift, buckets, base, pair = self.length, self.far, self.shift, self.buckets, self.base, self.block == 2
        end, total = length, len(ids)
        while end <= total:
            last = ids[end - 1]
            key = ids[end - 2] * base + last if pair else last
            step = shift.get(key, far)
            if step:
                end += step
                continue
            start = end - length
            for pattern, items in buckets[key].get(ids[start], ()):
                if tuple(ids[start:end]) == pattern:
                    yield start, items
            end += 1


class Patterns:
    """All searches over one block of patterns."""

    def __init__(self, windows: dict[tuple[bytes, ...], set[int]]) -> None:
        self.ids = {w: i for i, w in enumerate(sorted({w for p in windows for w in p}), 1)}
        by_length: dict[int, dict[tuple[int, ...], set[int]]] = {}
        for pattern, items in windows.items():
            by_length.setdefault(len(pattern), {})[tuple(self.ids[w] for w in pattern)] = items
        self.searches = [Search(n, p, len(self.ids) + 1) for n, p in sorted(by_length.items())]

    def hits(self, found: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged word spans that occurrences cover, and the items they belong to."""
        get = self.ids.get
        ids = [get(w, 0) for w in found]
        covered: list[tuple[int, int]] = []
        items: set[int] = set()
        for search in self.searches:
            for start, owners in search.find(ids):
                covered.append((start, start + search.length))
                items |= owners
        return merged(covered), items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def pattern_blocks(benchmark: DataFrame, window: int = WINDOW, most: int = BLOCK_PATTERNS, id_col: str = "item_id", text_col: str = "text"):
    """The benchmark's patterns in blocks of at most about `most`; items come to the driver one partition at a time."""
    block: dict[tuple[bytes, ...], set[int]] = {}
    for row in benchmark.select(F.col(id_col).cast("long"), F.col(text_col).cast("binary")).where(F.col(id_col).isNotNull()).toLocalIterator():
        item = words(bytes(row[1]) if row[1] is not None else None)
        for i in range(max(1, len(item) - window + 1) if item else 0):
            block.setdefault(tuple(item[i:i + window]), set()).add(row[0])
        if len(block) >= most:
            yield Patterns(block)
            block = {}
    yield Patterns(block)


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
                       most: int = BLOCK_PATTERNS, text_col: str = "text", out: str = "contamination") -> DataFrame:
    """docs with a struct column `out`: n_words, n_hit, spans (word positions), items. One block of
    patterns after the other is searched in the same pass; a later one adds to what an earlier one found."""
    for k, patterns in enumerate(pattern_blocks(benchmark, window, most)):
        shared = spark.sparkContext.broadcast(patterns)

        def scan(texts: pa.Array, shared=shared) -> pa.Array:
            search = shared.value
            rows = []
            for text in texts.cast(pa.binary()).to_pylist():
                found = words(text)
                spans, items = search.hits(found)
                rows.append({"n_words": len(found), "n_hit": sum(e - s for s, e in spans),
                             "spans": [{"start": s, "end": e} for s, e in spans], "items": sorted(items)})
            kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()),
                              ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.int64()))])
            return pa.array(rows, kind)

        if not k:
            docs = append_column(docs, out, RESULT, text_col, scan)
            continue
        docs = append_column(docs, f"{out}_more", RESULT, text_col, scan)
        cover = F.array_sort(F.concat(f"{out}.spans", f"{out}_more.spans"))
        joined = F.aggregate(cover, F.array().cast(RESULT["spans"].dataType), lambda done, s: F.when(
            (F.size(done) > 0) & (s["start"] <= F.element_at(done, -1)["end"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(
                F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], s["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(s))))
        docs = docs.withColumn(out, F.struct(
            F.col(f"{out}.n_words").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), joined.alias("spans"),
            F.array_union(f"{out}.items", f"{out}_more.items").alias("items"))).drop(f"{out}_more")
        docs = docs.withColumn(out, F.col(out).withField("n_hit", F.aggregate(
            F.col(f"{out}.spans"), F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])))
    return docs


def contamination_report(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = F.col("contamination")
    return find_contamination(spark, docs.select("doc_id", "text"), benchmark).select(
        "doc_id", found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"),
        F.size(found["items"]).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort(F.transform(found["items"], lambda i: i.cast("string")))), 256).alias("items_sha256"),
        (found["n_hit"] > 0).alias("contaminated"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(spark, read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def clean_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with no benchmark window stay."""
    found = find_contamination(spark, docs, read(spark, sf_dir, "benchmark"), out="_contamination")
    return found.where(F.col("_contamination.n_hit") == 0).drop("_contamination")


_WORDS = r"regexp_extract_all(translate({t}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce({_WORDS.format(t='text')}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format(t='text')} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
      FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0),
g AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
      FROM d, (SELECT DISTINCT n FROM p), LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)),
m AS (SELECT g.r, g.i, g.n, p.item_id FROM g JOIN p USING (n, g)),
h AS (SELECT r, count(DISTINCT j) AS n_hit FROM m, LATERAL (SELECT unnest(range(i, i + n)) AS j) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS k FROM m) GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN t USING (r)
"""
