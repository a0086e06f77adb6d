"""Hard negatives, spelling variants and byte-level BPE against brute force, with nulls, ties, repeats, clashing names and empty tables."""

from __future__ import annotations

import collections
import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyframe.llm import bpe, hard_negatives, simhash, spelling

# ---- hard negatives -----------------------------------------------------------------------------------


def mined_by_hand(rows, anchors, positives=5, negatives=10, low=30, high=90):
    out = []
    for i, label, v in sorted(set(anchors)):
        others = [(-sum(a * b for a, b in zip(v, w, strict=True)), j, m) for j, m, w in rows if j != i and len(w) == len(v)]
        near = sorted((s, j) for s, j, m in others if m == label)[:positives]
        for p, j in near:
            fits = sorted((s, k) for s, k, m in others if m != label and low * -p <= -100 * s <= high * -p)
            out += [(i, j, r, k, -p, -s) for r, (s, k) in enumerate(fits[:negatives], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    middle = rng.standard_normal((6, 8)) / 2
    rows = [(i, str(i % 4), tuple(np.floor(256 * (middle[i % 6] + rng.standard_normal(8) / 6)).astype(int).tolist())) for i in range(900)]
    rows += [(1000 + i, "1", rows[7][2]) for i in range(40)] + [(2000, "2", (0,) * 8), (2001, "3", (5, -4, 3)), (2100, "3", (5, 4, 3)), (2101, "x", (5, 2, 1)), (2200, "only", rows[3][2])]
    return rows


ROWS = "id long, label string, vector array<int>"


@pytest.mark.parametrize("shard, block", [(65_536, 4_096), (130, 3)])
def test_hard_negatives(spark, vectors, shard, block):
    rows = spark.createDataFrame(vectors, ROWS)
    got = hard_negatives.hard_negatives(rows, rows.where("id % 100 = 0"), shard=shard, block=block)
    want = mined_by_hand(vectors, [r for r in vectors if r[0] % 100 == 0])
    assert sorted(tuple(r) for r in got.collect()) == want and len({r[0] for r in want}) > 9


def test_bounds_of_the_multi_index_hold(vectors):
    rows = np.array([v for _, _, v in vectors if len(v) == 8], float)
    index = hard_negatives.MultiIndex(rows)
    for anchor in rows[:20]:
        seen, last = 0, math.inf
        for most, least, part in index.visit(anchor):
            scores = index.rows[part] @ anchor
            assert least <= scores.min() and scores.max() <= most <= last
            seen, last = seen + len(scores), most
        assert seen == len(rows)


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), math.inf
    rows = [(0, 1, [0.5, 0.25]), (1, 1, [0.5, 0.1]), (2, 2, [0.25, 0.125]), (None, 2, [0.3, 0.1]), (3, None, [0.3, 0.1]), (4, 2, None), (5, 2, [None, 0.1]),
            (6, 2, [nan, 0.1]), (7, 2, [inf, 0.1]), (8, 2, [1e30, 0.1]), (9, 2, [0.25, 0.125]), (9, 2, [0.25, 0.125]), (0, 1, [0.5, 0.25]), (11, 1, [])]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("score", F.lit(1)).withColumn("shard", F.lit("x"))
    q = hard_negatives.quantised(df, "vec_id", F.col("label"), "embedding")
    got = hard_negatives.hard_negatives(q, q.where("id % 100 = 0")).orderBy("positive_id", "rank").collect()
    assert [tuple(r) for r in got if r.positive_id == 1] == [(0, 1, k + 1, i, 128 * 128 + 64 * 25, 64 * 128 + 32 * 64) for k, i in enumerate([2, 9, 9])]
    assert hard_negatives.hard_negatives(q.limit(0), q.limit(0)).count() == 0


# ---- spelling variants --------------------------------------------------------------------------------


def near_by_hand(words):
    return {w: {v for v in words if spelling.one_edit(v, w)} for w in words}


@pytest.fixture(scope="module")
def vocabulary():
    rng = random.Random(3)
    syllables = ["in", "the", "ti", "on", "éa", "ou", "sh", "a", "wh", "ion", "n"]
    base = ["".join(rng.choice(syllables) for _ in range(rng.randint(2, 5))) for _ in range(90)]
    words = collections.Counter()
    for w in base + ["a" * 9, "ab" * 5, "q", "", "𝒳𝒴𝒵𝒳𝒴", "y" * 60, "y" * 59, "y" * 30 + "z" + "y" * 29]:
        words[w] += rng.choice([2, 30, 400])
        for _ in range(5):
            i = rng.randrange(len(w) + 1)
            words[rng.choice([w[:i] + w[i + 1:], w[:i] + rng.choice("ane𝒳") + w[i:], w[:i] + rng.choice("ane") + w[i + 1:]])] += rng.randint(1, 3)
    return dict(words)


@pytest.mark.parametrize("gram, extended, tile", [((3, 4), 1e-3, 4096), ((2, 5), 1e-3, 7), ((2, 2), 1, 20)])
def test_near_words(spark, vocabulary, gram, extended, tile):
    df = spark.createDataFrame([*vocabulary.items(), (None, 3)], "word string, n long")
    got = collections.defaultdict(set)
    for r in spelling.near_words(df, gram, extended, tile).collect():
        assert r.n == vocabulary[r.word] and r.near_n == vocabulary[r.near] and r.near not in got[r.word]
        got[r.word].add(r.near)
    assert got == {w: s for w, s in near_by_hand(vocabulary).items() if s}


def test_bound_of_affected_grams(vocabulary):
    """Words one edit apart share at least as many grams, at about the same place, as the bounds of both say."""
    counts = collections.Counter(f"\x02{w}\x03"[i:i + q] for w in vocabulary for q in (2, 3, 4) for i in range(len(w) + 3 - q))
    known = spelling.Dictionary(dict(counts), sum(len(w) + 2 for w in vocabulary), (2, 4), 0.002)
    assert len(known.extended) > 20
    for w, others in near_by_hand(vocabulary).items():
        for v in others:
            a, b = f"\x02{w}\x03", f"\x02{v}\x03"
            g, h = known.grams(a), known.grams(b)
            left = [(b[s:e], s) for s, e in h]
            shared = 0
            for s, e in g:
                hit = next((x for x in left if x[0] == a[s:e] and abs(x[1] - s) <= 1), None)
                shared += hit is not None
                if hit:
                    left.remove(hit)
            assert shared >= max(len(g) - known.affected(g), len(h) - known.affected(h))


def test_forms_and_roots(spark):
    words = [("colour", 4000), ("color", 400), ("colr", 40), ("cold", 39), ("colt", 40), ("zebra", 10), ("zebras", 100), ("zebraz", 100), ("alone", 5)]
    got = {r.word: tuple(r)[1:] for r in spelling.group_spellings(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got["colr"] == ("color", "colour", 40, 3, 400) and got["color"][:2] == ("colour", "colour") and got["colour"] == (None, "colour", 4000, 1, None)
    assert got["cold"] == (None, "cold", 39, 2, None) and got["zebra"] == ("zebras", "zebras", 10, 2, 100) and got["alone"] == (None, "alone", 5, 0, None)
    assert spelling.group_spellings(spark.createDataFrame([], "word string, n long")).count() == 0


def test_occurring_words(spark):
    rows = [(i, "Überfall ÜBERFALL überfall abcdefgh ABCDEFGH short") for i in range(40)] + [(None, "Nullwörter nullwörter"), (5, None), (6, ""), (7, "x" * 100_000), (7, "x" * 100_000)]
    got = {r.word: r.n for r in spelling.occurring_words(spark.createDataFrame(rows, "doc_id long, text string").withColumn("run", F.lit(1))).collect()}
    want = collections.Counter()
    import re
    import zlib
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", (text or "").translate(str.maketrans(spelling.UPPER, spelling.LOWER))):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[:h % len(run)] + run[h % len(run) + 1:] if h % 31 == 0 else run] += 1
    assert got == {w: n for w, n in want.items() if n >= 2 and len(w) >= 7}


# ---- byte-level BPE -----------------------------------------------------------------------------------

public = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    signs = ["'", "s", "t", "re", "ll", "ve", "d", "m", " ", "  ", "\n", "\t", " ", " ", "　", "a", "B", "é", "ß", "1", "٣", "²", ".", "!", "-", "€", "😀",
             "Ᲊ", "<|endoftext|>", "<|endof", "|>", "\x00", "\x1c", "́", "中", "eee"]
    out = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    return [*out, "", None, "a" * 5000, "ab" * 3000 + " " * 50, " " * 200, "'s's's", "it's we're I'LL 's", "x" * 70, out[0], out[0]]


def test_bpe_against_the_library(spark, texts, monkeypatch):
    path = public.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary.of(path)
    want = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    decoded = library.decode_batch(want, skip_special_tokens=False)
    for at_once, short in ((1 << 20, 64), (60, 4)):  # short: long pieces go through single trees
        monkeypatch.setattr(bpe, "AT_ONCE", at_once)
        monkeypatch.setattr(bpe, "REMEMBERED", 500 if at_once == 60 else 500_000)
        ids = bpe.encode_array(own, pa.array(texts))
        assert ids.to_pylist() == want and bpe.decode_array(own, ids).to_pylist() == decoded
    docs = spark.createDataFrame([(k, t, 7, "x") for k, t in enumerate(texts)], "doc_id long, text string, ids int, decoded string")
    rows = bpe.decode(bpe.encode(docs, own), own).collect()
    assert docs.columns == ["doc_id", "text", "ids", "decoded"] and {r.doc_id: (r.ids, r.decoded) for r in rows} == dict(enumerate(zip(want, decoded, strict=True)))
    assert bpe.encode(docs.limit(0), own).count() == 0


def test_single_trees_equal_tables_of_trees():
    own = bpe.Vocabulary.of(public.path("byte_bpe_50k.json"))
    rng = random.Random(2)
    pieces = [bytes(rng.choice(b" thein\xc3\xa9xao") for _ in range(rng.randint(1, 60))) for _ in range(400)] + [b"x"]
    lengths = np.array([len(p) for p in pieces])
    codes = np.array([list(p.ljust(60, b"\0")) for p in pieces])
    ids, stays = bpe.merged_rows(own, own.first[codes], lengths)
    assert [row[keep].tolist() for row, keep in zip(ids, stays, strict=True)] == [bpe.PairTree(own, p).merged() for p in pieces]


def test_decoding_of_any_ids(spark):
    path = public.path("byte_bpe_50k.json")
    library, own = tokenizers.Tokenizer.from_file(path), bpe.Vocabulary.of(path)
    rng = random.Random(4)
    lists = [[rng.randrange(50257) for _ in range(rng.randint(0, 9))] for _ in range(2000)]
    assert bpe.decode_array(own, pa.array(lists, pa.list_(pa.int32()))).to_pylist() == library.decode_batch(lists, skip_special_tokens=False)
    assert bpe.decode_array(own, pa.array([None, [64, None, -1, 99_999, 65], []], pa.list_(pa.int32()))).to_pylist() == ["", "ab", ""]


def test_other_vocabularies_are_refused(tmp_path):
    with pytest.raises(ValueError):
        bpe.Vocabulary.of(public.path("word_bpe_49k.json"))


# ---- near duplicates of the pipeline ------------------------------------------------------------------


def test_recall_of_near_duplicates_on_documents(spark):
    """All pairs of the small tables' documents, by similarity: one of each group that they connect is kept, no other document goes."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    sets = {r.doc_id: set(simhash.shingles((r.text or "").encode()).tolist()) for r in docs.collect()}
    holders = collections.defaultdict(list)
    for i in sorted(sets):
        for h in sets[i]:
            holders[h].append(i)
    common = collections.Counter((i, j) for ids in holders.values() for k, i in enumerate(ids) for j in ids[k + 1:])
    similar = {p: c / (len(sets[p[0]]) + len(sets[p[1]]) - c) for p, c in common.items()}
    similar = {p: s for p, s in similar.items() if s >= 0.8}
    label = {i: i for i in sets}
    while True:  # smallest member of each group
        low = {p: min(label[p[0]], label[p[1]]) for p in similar}
        new = dict(label)
        for (i, j), x in low.items():
            new[i], new[j] = min(new[i], x), min(new[j], x)
        if new == label:
            break
        label = new
    gone = {r.gone for r in simhash.repeated_in_groups(docs).collect()}
    empty = sorted(i for i, s in sets.items() if not s)[1:]
    assert len(similar) > 90 and gone == {i for i in sets if label[i] < i} | set(empty)
