"""Deduplication operators against brute force on small tables, with nulls, ties, repeats and empty tables."""

from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest
import xxhash

from tallyframe.llm import chunk_dedup, lattice, occurrences, simhash, suffix_dedup
from tallyframe.llm.graph import components

DOCS = "doc_id long, text string"


def prose(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice("abcdefgäö") for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, base = prose(rng, 60), prose(rng, 150)
    out = [(i, prose(rng, rng.randint(0, 60))) for i in range(30)]
    out += [(100 + i, prose(rng, 20) + shared + prose(rng, 10)) for i in range(6)]
    out += [(200 + i, base[:i * 37] + "X" + base[i * 37:]) for i in range(8)]
    out += [(300, base), (301, base), (302, "a" * 1500), (303, "ab" * 300), (304, ""), (305, None), (306, "   \n"), (307, shared + shared), (301, base)]
    return out


def repeats_by_hand(rows):
    """doc_id -> (bytes, removed, spans, digest of the rest)."""
    seen, out = set(), {}
    for i, text in sorted(set(rows), key=lambda r: r[0]):
        body = (text or "").encode()
        gone = bytearray(len(body))
        for p in range(len(body) - 99):
            window = body[p:p + 100]
            if window in seen:
                gone[p:p + 100] = b"\1" * 100
            seen.add(window)
        kept = bytes(b for b, g in zip(body, gone, strict=True) if not g)
        out[i] = (len(body), sum(gone), sum(1 for j, g in enumerate(gone) if g and (not j or not gone[j - 1])), hashlib.sha256(kept).hexdigest())
    return out


def removed(rows):
    return {r.doc_id: (r.repeats.n_bytes, r.repeats.n_bytes - len(r.repeats.kept), len(r.repeats.removed), hashlib.sha256(bytes(r.repeats.kept)).hexdigest()) for r in rows}


def test_suffix_dedup(spark, rows):
    got = suffix_dedup.dedup_repeats(spark.createDataFrame(rows, DOCS)).collect()
    assert len(got) == len(rows)
    assert removed(got) == repeats_by_hand(rows)


def test_suffix_dedup_of_hot_anchors(spark, rows):
    """Windows dealt out one by one give the same repeats as whole runs."""
    docs = occurrences.keyed(spark.createDataFrame(rows, DOCS))
    found = occurrences.marks(docs, suffix_dedup._items)

    def heated(batches):
        for b in batches:
            b["marks"] = [m[:len(m) // 5 * 4] + m[len(m) // 5 * 4:].replace(b"\2", b"\3") for m in b["marks"]]
            yield b

    hot = found.mapInPandas(heated, found.schema)
    spans = {}
    for marked in (found, hot):
        candidates = suffix_dedup.cut(suffix_dedup._candidates(docs.join(marked, ["k", "h"]).select("k", "h", "text", "marks"), 16))
        compared = suffix_dedup._compared(candidates, 16).collect()
        spans[marked is hot] = {r.k: suffix_dedup.covered([bytes(r.marks)]) for r in compared}
    assert spans[True] == spans[False] and spans[True]


def test_bounded_expansion_equals_shared_prefixes():
    rng = np.random.default_rng(3)
    text = rng.integers(1, 4, 600)
    text[300:420] = text[20:140]
    for limit in (1, 5, 30, 100):
        order = suffix_dedup.bounded_order(text, limit)
        doubled = np.concatenate([text, text])
        prefix = [tuple(doubled[o:o + limit]) for o in order]
        assert prefix == sorted(prefix)
        edge = suffix_dedup.bounded_boundaries(text[order - 1], limit)
        assert edge.tolist() == [i == 0 or prefix[i] != prefix[i - 1] for i in range(len(order))]


def test_suffix_dedup_cuts_long_texts_in_pieces(monkeypatch):
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 5000).astype(np.uint8)
    offsets = np.array([0, 40, 4000, 4000, 5000])
    whole = suffix_dedup.runs(offsets, data)
    monkeypatch.setattr(suffix_dedup, "PIECE", 700)
    parts = suffix_dedup.runs(offsets, data)
    windows = [{(d, p + i) for d, p, n in zip(r[0].tolist(), r[1].tolist(), r[2].tolist(), strict=True) for i in range(n)} for r in (whole, parts)]
    assert windows[0] == windows[1] == {(d, p) for d in range(4) for p in range(offsets[d], offsets[d + 1] - 99)}


def test_stage_keeps_columns(spark, rows):
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1) for i, t in rows] + [(None, None, None, None, None, None)], DOCS + ", lang string, source string, n_chars long, k int")
    out = suffix_dedup.cut_stage(spark, docs, "")
    assert out.columns == docs.columns
    got = {r.doc_id: r for r in out.collect()}
    assert None in got and got[305].text is None and got[304].text == "" and 301 not in got
    assert all(r.n_chars == len(r.text or "") for i, r in got.items() if i is not None) and len(got[302].text) == 1


def fingerprint_by_hand(text):
    words = [w for w in (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).translate(
        {c: " " for c in (9, 10, 11, 12, 13)}).split(" ") if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups_by_hand(keys, linked):
    label = {k: k for k in keys}
    changed = True
    while changed:
        changed = False
        for a in keys:
            for b in keys:
                if linked(a, b) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return label


def test_simhash(spark, rows):
    more = [*rows, (400, "One two\tTHREE four\x0bfive"), (401, "one two three four five"), (402, "q"), (None, "q")]
    got = simhash.near_duplicates(spark.createDataFrame(more, DOCS)).collect()
    prints = {i: fingerprint_by_hand(t) for i, t in more if i is not None}
    assert {r.doc_id: r.fp % 2 ** 64 for r in got if r.doc_id is not None} == prints
    label = groups_by_hand(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {r.doc_id: r.component_id for r in got} == label | {None: None}
    assert len(got) == len(more)
    kept = {r.doc_id for r in simhash.keep_one_stage(spark, spark.createDataFrame(more, DOCS), "").collect()}
    assert kept == {i for i in label if label[i] == i} | {None}


def test_stage_finds_five_word_copies(spark):
    rng = random.Random(8)
    words, rows = [[prose(rng, 1) for _ in range(120)] for _ in range(6)], []
    for i, base in enumerate(words):
        rows.append((100 * i, " ".join(base)))
        for k in range(1, 9):  # up to four words replaced: similarities on both sides of the bound
            some = list(base)
            for at in rng.sample(range(5, 115), 1 + k % 4):
                some[at] = prose(rng, 1)
            rows.append((100 * i + k, " ".join(some)))
    rows += [(900, None), (901, ""), (902, "one"), (903, " ONE "), (None, rows[0][1]), (1, prose(rng, 80))]
    sets = [(i, simhash.shingles((t or "").encode())) for i, t in rows if i is not None]
    kept = {r.doc_id for r in simhash.similar_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert None in kept and {1, 900, 902} <= kept and not {901, 903} & kept  # one row of id 1 is like no other
    near = {(i, j) for i, a in sets for j, b in sets if i < j and simhash.jaccard(a, b) >= 0.8}
    assert len([p for p in near if p[0] % 100 == 0]) > 20
    assert not [(i, j) for i, j in near if i in kept and j in kept and 1 not in (i, j)]
    assert all(j in kept or any((i, j) in near for i, _ in sets) for j, _ in sets if j not in (901, 903))


def test_trees_in_tiles(spark):
    rng = random.Random(2)
    ball = [rng.getrandbits(64)]
    for _ in range(150):
        ball.append(rng.choice(ball) ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(1, 4))))
    keys = sorted(set(ball + [rng.getrandbits(64) for _ in range(150)]))
    signed = [k - 2 ** 64 if k >= 2 ** 63 else k for k in keys]
    label = groups_by_hand(signed, lambda a, b: ((a ^ b) % 2 ** 64).bit_count() <= 3)
    for size in (8, 512):
        edges = simhash.link(spark.createDataFrame([(k,) for k in signed], "fp long"), tree_size=size)
        got = {r.node: r.component for r in components(edges).collect()}
        assert {k: got.get(k, k) for k in signed} == label


def test_components_of_nothing_and_chains(spark):
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (7, 7), (1, 0)]
    got = {r.node: r.component for r in components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_lattice(spark):
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((12, 64))
    vectors = [(int(i), (centres[i % 12] + rng.standard_normal(64) * rng.uniform(0.02, 0.12)).tolist()) for i in range(240)]
    vectors += [(900, vectors[0][1]), (901, None), (902, [0.0] * 64), (903, [float("nan")] + [1.0] * 63), (904, [None] + [1.0] * 63),
                (905, [float("inf")] + [1.0] * 63), (906, []), (907, [3.0, 4.0]), (908, [6.0, 8.0]), (909, vectors[5][1]), (910, [x * 7 for x in vectors[5][1]])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in lattice.link_vectors(df).collect()}
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in vectors if v and None not in v and np.isfinite(v).all() and np.any(v)}
    linked = {(a, b) for a in unit for b in unit if a != b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9}
    true = {i: sum((i, j) in linked for j in unit) for i, _ in vectors}
    assert sum(r.n_links for r in got.values()) >= 0.95 * len(linked)
    assert all(got[i].n_links <= n for i, n in true.items())
    label = groups_by_hand(sorted(unit), lambda a, b: (a, b) in linked)
    assert sum(got[i].component_id == label[i] for i in unit) >= 0.95 * len(unit)
    assert all(got[i].n_links == 0 and got[i].component_id == i and got[i].kept for i in (901, 902, 903, 904, 905, 906))
    assert lattice.link_vectors(spark.createDataFrame([], df.schema)).count() == 0


def test_tiles_count_each_link_once(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, 1, (np.ones(16) + rng.standard_normal(16) * 0.05).tolist()) for i in range(120)]
    df = spark.createDataFrame(vectors, "id long, copies long, vector array<double>")
    for tile in (7, 1000):
        counts = {r.id: r.n for r in lattice.found_links(df, tile=tile).groupBy("id").sum("n").withColumnRenamed("sum(n)", "n").collect()}
        assert counts == {i: 119 for i in range(120)}


def test_decoding_gives_the_nearest_point():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((200, 8)) * 2
    found = lattice.decode(x)
    assert (found % 2 == found[:, :1] % 2).all() and (found.sum(1) % 4 == 0).all()
    gap = ((2 * x - found) ** 2).sum(1)
    for root in lattice.ROOTS:
        assert (gap <= ((2 * x - found - root) ** 2).sum(1) + 1e-9).all()


def chunks_by_hand(body: bytes):
    out, at, rolled = [], 0, 0
    for i, b in enumerate(body):
        rolled = (rolled << 1) + int(chunk_dedup.GEAR[b]) & 0xFFFFFFFF
        if (i + 1 - at >= 32 and i >= 31 and rolled >> 27 == 0) or i + 1 - at == 256:
            out.append((at, i + 1))
            at = i + 1
    return out + ([(at, len(body))] if at < len(body) else [])


def test_chunking_matches_a_rolling_hash(rows):
    for text in [t for _, t in rows if t] + [prose(random.Random(1), 900)]:
        body = np.frombuffer(text.encode(), np.uint8)
        doc, start, end = chunk_dedup.chunks(np.array([0, len(body)]), body)
        assert list(zip(start.tolist(), end.tolist(), strict=True)) == chunks_by_hand(text.encode())


def test_chunk_dedup(spark, rows):
    got = {r.doc_id: r.chunked for r in chunk_dedup.dedup_chunks(spark.createDataFrame(rows, DOCS)).collect()}
    seen, expected = set(), {}
    for i, text in sorted(set(rows), key=lambda r: r[0]):
        body = (text or "").encode()
        spans, again = [], 0
        for a, b in chunks_by_hand(body):
            if body[a:b] in seen:
                again += 1
                if spans and spans[-1][1] == a:
                    spans[-1] = (spans[-1][0], b)
                else:
                    spans.append((a, b))
            seen.add(body[a:b])
        expected[i] = (again, [s for s in spans if s[1] - s[0] >= 100 or s[1] - s[0] == len(body)])
    assert {i: (c.n_duplicate, [(s.start, s.end) for s in c.removed]) for i, c in got.items()} == expected
    assert sum(bool(c.removed) for i, c in got.items() if 100 <= i < 106) == 5  # the shared passage, at other places each
    assert got[301].kept == b"" and got[305].n_chunks == 0
