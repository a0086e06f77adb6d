"""Spelling variants: words one edit apart, found through variable-length grams.

The dictionary holds all grams of GRAM[0] signs and the longer ones, up to GRAM[1], whose beginning is frequent. A word, with
a sign before and after it, is decomposed into the longest dictionary gram at each place, unless an earlier one covers it.
An edit can change only grams that end in a window of GRAM[1] + 1 places around it (one less for the longest
grams), so the fullest window bounds how many of a word's grams one edit affects; near words share all but so many.
Hence they share one of the rarest grams that are left out of that count, at about the same place, and only the lists
of those grams are merged. In a list, words whose letters of odd count differ in at most two are verified sign by sign. Words all of
whose grams one edit could change are compared with each other through what is left of them without one sign; with
all other words they meet in lists.

A list is cut into tiles, and pairs of tiles are dealt out, so a gram of a third of all words neither fills a task nor
loses a pair. Only frequent grams are sent to all executors; there are at most 1 / LISTED for each length.

Null texts hold no words, a null doc_id counts as the empty string before the colon, repeated rows count each; very long texts are
taken whole, very long words one by one. An empty table gives no words. Ties go to the smallest word in code-point order. Other
columns are not looked at, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, partitions, read

#: Signs of the shortest and longest gram; share of all grams above which one is extended, and above which its count is
#: kept to order lists; words in a tile; least length of a word; least ratio of a form's occurrences; every which run is marred.
GRAM, EXTENDED, LISTED, TILE, LEAST, RATIO, MARRED = (3, 4), 1e-3, 1e-4, 4_096, 7, 10, 31
PAIRS_AT_ONCE, ROWS_AT_ONCE, WIDE = 1_000_000, 100_000, 40
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurring_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """(word, n): runs of letters, A-Z lower-cased, of at least so many signs, every 31st (by checksum) short of a sign; n >= 2."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(F.translate(F.col(text_col), UPPER, LOWER), F.lit(f"[a-zÀ-ÿ]{{{least},}}"), F.lit(0))).alias("run"))
    hashed = runs.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.expr("cast(h % length(run) AS int)")
    word = F.when(F.col("h") % MARRED == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(F.col("run"))
    return hashed.select(word.alias("word")).where(F.length("word") >= least).groupBy("word").agg(F.count("*").alias("n")).where("n >= 2")


class Dictionary:
    """Which grams are extended, and how often the frequent ones occur."""

    def __init__(self, counts: dict[str, int], total: int, gram: tuple[int, int] = GRAM, extended: float = EXTENDED) -> None:
        self.short, self.long = gram
        self.counts = counts
        self.extended = {g for g, c in counts.items() if len(g) < self.long and c > extended * total}

    def grams(self, word: str) -> list[tuple[int, int]]:
        """(start, end) of the grams that a word (with its outer signs) is decomposed into."""
        out, covered, n = [], 0, len(word)
        for start in range(n - self.short + 1):
            end = start + self.short
            while end < n and end - start < self.long and word[start:end] in self.extended:
                end += 1
            if end > covered:
                out.append((start, end))
                covered = end
        return out

    def affected(self, grams: list[tuple[int, int]]) -> int:
        """The most grams that one edit can change. Grams ending in [b - 1, b + long - 1] may change where the unchanged rest begins at b; full ones not if they end at b - 1."""
        full = {e: e - s == self.long for s, e in grams}
        most = 0
        for b in range(1, grams[-1][1] + 1 if grams else 0):
            most = max(most, sum(e in full for e in range(b, b + self.long)) + (not full.get(b - 1, True)))
        return most

    def rarest(self, word: str) -> tuple[list[tuple[int, int]], bool]:
        """(the grams whose lists are merged, whether sharing one of them is certain for near words that are sure as well)."""
        grams = self.grams(word)
        bound = len(grams) - self.affected(grams)
        grams.sort(key=lambda g: (self.counts.get(word[g[0]:g[1]], 0), word[g[0]:g[1]], g[0]))
        return grams[:len(grams) - max(bound, 1) + 1], bound >= 1


def dictionary(words: DataFrame, gram: tuple[int, int] = GRAM, extended: float = EXTENDED, listed: float = LISTED) -> Dictionary:
    """From the grams of all words (word)."""
    outer = words.select(F.concat(F.lit("\x02"), "word", F.lit("\x03")).alias("w"))
    total = outer.agg(F.coalesce(F.sum(F.length("w")), F.lit(0))).first()[0]
    found = None
    for size in range(gram[0], gram[1] + 1):
        some = outer.where(F.length("w") >= size).select(F.explode(F.expr(f"transform(sequence(1, length(w) - {size - 1}), i -> substring(w, i, {size}))")).alias("g"))
        found = some if found is None else found.unionByName(some)
    kept = found.groupBy("g").count().where(F.col("count") > listed * total).collect()
    return Dictionary({r.g: r["count"] for r in kept}, total, gram, extended)


def _entries(words: DataFrame, known: Dictionary) -> DataFrame:
    """(word, n, keys, asks, sure): lists that a word is in, and lists of words longer by one sign that it may be near."""
    sent = words.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, known = xxhash.xxh64_intdigest, sent.value
        for batch in batches:
            keys, asks, sure = [], [], []
            for word in batch.column(0).to_pylist():
                outer = f"\x02{word}\x03"
                grams, certain = known.rarest(outer)
                n = len(outer)
                keys.append([digest(f"{outer[s:e]} {s} {n}") for s, e in grams])
                asks.append(list({digest(f"{outer[s:e]} {s + k} {n + 1}") for s, e in grams for k in (0, 1)}))
                sure.append(certain)
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in c]))), pa.int32()),
                                              pa.array(np.array([h for x in c for h in x], np.uint64).view(np.int64))) for c in (keys, asks)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists, pa.array(sure, pa.bool_())], names=["word", "n", "keys", "asks", "sure"])

    spread = words.select("word", "n").repartition(partitions(words.sparkSession), "word")  # a small table has few splits
    return spread.mapInArrow(run, "word string, n long, keys array<long>, asks array<long>, sure boolean")


def one_edit(a: str, b: str) -> bool:
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + (len(a) == len(b)):] == b[k + 1:]


class Spelled:
    """Words as rows of code points, and the letters that each holds an odd number of times."""

    def __init__(self, words: list[str]) -> None:
        self.words = words
        self.length = np.array([len(w) for w in words])
        self.points = np.zeros((len(words), WIDE), np.uint32)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        begin = np.cumsum(self.length) - self.length
        row = np.repeat(np.arange(len(words)), self.length)
        column = np.arange(len(flat)) - begin[row]
        self.odd = np.zeros(len(words), np.uint64)
        np.bitwise_xor.at(self.odd, row, np.uint64(1) << (flat & 63).astype(np.uint64))
        inside = column < WIDE
        self.points[row[inside], column[inside]] = flat[inside]

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs a, b are one edit apart."""
        swap = self.length[a] > self.length[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        la, lb = self.length[a], self.length[b]
        out = np.zeros(len(a), bool)
        same = la == lb
        at = np.flatnonzero(same & (lb <= WIDE))
        out[at] = (self.points[a[at]] != self.points[b[at]]).sum(1) == 1
        at = np.flatnonzero((lb - la == 1) & (lb <= WIDE))
        if len(at):
            p, q = self.points[a[at]], self.points[b[at]]
            inside = np.arange(WIDE) < la[at, None]
            head = ((p == q) & inside).cumprod(1, dtype=np.int8).sum(1)
            tail = ((p == np.roll(q, -1, 1)) | ~inside)[:, ::-1].cumprod(1, dtype=np.int8).sum(1) - (WIDE - la[at])
            out[at] = head + tail >= la[at]
        for i in np.flatnonzero(lb > WIDE).tolist():
            out[i] = one_edit(self.words[a[i]], self.words[b[i]])
        return out


def _merged(group: np.ndarray, ask: np.ndarray, tile: np.ndarray | None, which: np.ndarray, spelled: Spelled) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows one edit apart in each list (rows sorted by list, members before asks; which: each row's word)."""
    odd = spelled.odd[which]
    end = np.searchsorted(group, group, "right")
    count = np.where(ask, 0, end - np.arange(len(group)) - 1)
    total = np.cumsum(count)
    start = 0
    while start < len(group):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + PAIRS_AT_ONCE, "right")))
        a = np.repeat(np.arange(start, stop), count[start:stop])
        if len(a):
            b = np.arange(len(a)) - (total[a] - count[a] - (total[start - 1] if start else 0)) + a + 1
            close = np.bitwise_count(odd[a] ^ odd[b]) <= 2
            if tile is not None:
                close &= tile[a] != tile[b]
            a, b = a[close], b[close]
            fits = spelled.near(which[a], which[b])
            yield a[fits], b[fits]
        start = stop


def _pairs(entries: DataFrame, tile: int = TILE) -> DataFrame:
    """(a, na, b, nb): pairs one edit apart that meet in a list, once for each list."""
    rows = entries.selectExpr("word", "n", "explode(concat(transform(keys, k -> struct(k AS key, false AS ask)), transform(asks, k -> struct(k AS key, true AS ask)))) AS e").selectExpr(
        "e.key", "e.ask", "word", "n")
    hot = rows.groupBy("key").count().where(F.col("count") > tile).select("key", F.ceil(F.col("count") / tile).cast("int").alias("tiles"))
    dealt = rows.join(cut(hot), "key", "left").selectExpr("key", "ask", "word", "n", "coalesce(tiles, 1) AS tiles", "cast(pmod(xxhash64(word), coalesce(tiles, 1)) AS int) AS tile")
    spread = dealt.selectExpr("key", "ask", "word", "n", "tile", "explode(sequence(0, tiles - 1)) AS other").selectExpr(
        "key", "least(tile, other) AS a", "greatest(tile, other) AS b", "ask", "tile", "word", "n")
    ready = spread.repartition(partitions(entries.sparkSession), "key", "a", "b").sortWithinPartitions("key", "a", "b", "ask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(table: pa.Table, group: np.ndarray) -> Iterator[pa.RecordBatch]:
            one, other, ask, tiles = (table.column(c).to_numpy() for c in range(1, 5))
            n = table.column(6).to_numpy()
            words = table.column(5).combine_chunks().dictionary_encode()
            spelled, which = Spelled(words.dictionary.to_pylist()), words.indices.to_numpy()
            for apart in (False, True):
                rows = np.flatnonzero((one != other) == apart)
                for a, b in _merged(group[rows], ask[rows], tiles[rows] if apart else None, which[rows], spelled):
                    a, b = rows[a], rows[b]
                    yield pa.RecordBatch.from_arrays(
                        [words.dictionary.take(pa.array(which[a])), pa.array(n[a]), words.dictionary.take(pa.array(which[b])), pa.array(n[b])], names=["a", "na", "b", "nb"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size < ROWS_AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            group = _numbered(table)
            end = int(np.searchsorted(group, group[-1], "left"))
            if end:
                yield from work(table.slice(0, end), group[:end])
                held = table.slice(end).to_batches()
                size -= end
        if size:
            table = pa.Table.from_batches(held)
            yield from work(table, _numbered(table))

    return ready.mapInArrow(run, "a string, na long, b string, nb long")


def _numbered(table: pa.Table) -> np.ndarray:
    change = np.any([np.diff(table.column(c).to_numpy()) != 0 for c in range(3)], axis=0)
    return np.concatenate(([0], np.cumsum(change)))


def _unsure_pairs(entries: DataFrame) -> DataFrame:
    """Pairs one edit apart of words that lists need not bring together: equal but for one sign at one place, or one is what is left of the other."""
    unsure = entries.where("NOT sure").select("word", "n")
    less = unsure.where("word <> ''").selectExpr("word", "n", "explode(transform(sequence(1, length(word)), i -> struct(i, concat(substring(word, 1, i - 1), substring(word, i + 1, length(word))) AS rest))) AS e").selectExpr(
        "word", "n", "e.i", "e.rest")
    a, b = less.alias("a"), less.alias("b")
    replaced = a.join(b, F.expr("a.i = b.i AND a.rest = b.rest AND a.word < b.word")).selectExpr("a.word AS a", "a.n AS na", "b.word AS b", "b.n AS nb")
    removed = less.join(unsure.select(F.col("word").alias("b"), F.col("n").alias("nb")), F.col("rest") == F.col("b")).selectExpr("word AS a", "n AS na", "b", "nb")
    return replaced.unionByName(removed)


def near_words(words: DataFrame, gram: tuple[int, int] = GRAM, extended: float = EXTENDED, tile: int = TILE) -> DataFrame:
    """(word, n, near, near_n): every word of the table (word, n; words differ) with each word one edit from it."""
    words = cut(words.where("word IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n")))
    entries = cut(_entries(words, dictionary(words, gram, extended)))
    found = _pairs(entries, tile).unionByName(_unsure_pairs(entries))
    both = found.selectExpr("inline(array(struct(a AS word, na AS n, b AS near, nb AS near_n), struct(b AS word, nb AS n, a AS near, na AS near_n)))")
    return both.distinct()


def group_spellings(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """words (word, n) with form, root, n_near and form_n, as the query's contract says."""
    words = cut(words)
    best = cut(near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")))
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(-F.col("best.less") >= ratio * F.col("n"), F.col("best.near")).alias("form"),
                                                   F.when(-F.col("best.less") >= ratio * F.col("n"), -F.col("best.less")).alias("form_n"))
    rows = cut(rows)
    # A form occurs at least `ratio` times as often, so chains are short: twice as far every round.
    steps = math.log(max(rows.agg(F.max("n")).first()[0] or 1, 1), ratio)
    roots = rows.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(max(steps, 1))))):
        roots = cut(roots)
        on = roots.select(F.col("word").alias("root"), F.col("root").alias("far"))
        roots = roots.join(on, "root", "left").select("word", F.coalesce("far", "root").alias("root"))
    return rows.join(cut(roots), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return group_spellings(occurring_words(read(spark, sf_dir, "documents")))


#: The checksum is built byte by byte from a table that the polynomial gives.
ORACLE = r"""
WITH RECURSIVE poly AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM (SELECT unnest(range(256)) AS i))),
runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents),
kept AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS key, run, count(*) AS c FROM runs WHERE length(run) >= 7 GROUP BY ALL),
bytes AS (SELECT run, c, CAST(hex(encode(key)) AS VARCHAR) AS x FROM kept),
hashed AS (
  SELECT run, c, xor(4294967295, list_reduce([4294967295] || list_transform(range(1, length(x), 2), lambda i: CAST('0x' || x[i:i + 1] AS BIGINT)),
    lambda s, b: xor(s >> 8, t[xor(s, b) % 256 + 1]))) AS h FROM bytes, poly),
marred AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, c FROM hashed),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM marred WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
less AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS (
  SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, less.n, w.word, w.n FROM less JOIN words w ON w.word = less.rest
  UNION SELECT w.word, w.n, less.word, less.n FROM less JOIN words w ON w.word = less.rest),
best AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k, count(*) OVER (PARTITION BY word) AS n_near FROM pairs),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 10 * words.n THEN near END AS form, CASE WHEN near_n >= 10 * words.n THEN near_n END AS form_n
  FROM words LEFT JOIN best ON best.word = words.word AND k = 1),
chain AS (
  SELECT word, word AS root FROM formed WHERE form IS NULL
  UNION ALL SELECT formed.word, chain.root FROM formed JOIN chain ON formed.form = chain.word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)
"""
