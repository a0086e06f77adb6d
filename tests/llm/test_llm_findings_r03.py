"""Findings of the third review on the corpus operators: work done once, and rows that do not move."""
from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tallyframe.llm import langid, simhash, suffix_dedup
from tallyframe.llm.common import cut, with_hint


def test_texts_are_scored_once_for_calibration_and_verdict(spark, monkeypatch):
    rows = [(i, f"the {'abcdefgh'[i % 8]} and of {i} " * (1 + i % 3), "en") for i in range(40)] + [(100 + i, f"der die {'stuvwxyz'[i % 8]} und ", "de") for i in range(40)]
    rows += [(500, "12 34", "de"), (501, None, "en"), (502, "the und", None), (None, "die of", "de"), (0, "der der", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = F.coalesce(F.col("doc_id") % 5 != 0, F.lit(False))
    for most in (langid.MOST, 50):
        models = langid.fit(docs, train, most)
        apart = langid.identify(docs.select("doc_id", "text"), models).select("doc_id", "language")
        monkeypatch.setattr(langid, "scored_rows", None)  # no second pass over the learning texts
        once = langid.fit_and_identify(docs, train, most).select("doc_id", "language")
        assert sorted(map(str, once.collect())) == sorted(map(str, apart.collect()))
        monkeypatch.undo()
    nothing = langid.fit_and_identify(docs, F.lit(False)).select("language.*").distinct().collect()
    assert [(r.lang, r.score, r.rejected) for r in nothing] == [("und", 0.0, True)]


def test_hint_keeps_every_wanted_row_and_drops_most_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("id"), (F.col("id") % 7).alias("key"))
    wanted = cut(rows.where("id % 50 = 3 OR id IS NULL"))
    hinted = with_hint(rows, wanted, ["id", "key"])
    assert hinted.columns == ["id", "key", "_hint"] and hinted.count() == 20_000
    assert hinted.where("_hint AND (id % 50 = 3 OR id IS NULL)").count() == wanted.count() == 401
    assert hinted.where("_hint").count() < 401 + 20_000 // 8
    assert with_hint(rows, cut(rows.where("id < 0")), ["id"]).where("_hint").count() == 0


def _similar_texts() -> list[str]:
    """Groups of near copies, many of them less than similar to each other, and texts of their own."""
    rng, words = np.random.default_rng(7), [f"word{i}" for i in range(400)]
    out = []
    for _ in range(3):
        base = list(rng.choice(words, 120))
        for k in range(30):
            text = list(base)
            for at in rng.choice(120, 1 + k % 6, replace=False):
                text[at] = f"x{rng.integers(1 << 30)}"
            out.append(" ".join(text))
    return out + [" ".join(rng.choice(words, 60)) for _ in range(20)]


def test_similar_pairs_are_verified_in_place_and_never_rows(spark, monkeypatch):
    texts = _similar_texts()
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    made = []
    inner = simhash._joining
    monkeypatch.setattr(simhash, "_joining", lambda *a: made.append(inner(*a)) or made[-1])
    monkeypatch.setattr(simhash, "IN_TILE", 8)
    gone = {r.gone for r in simhash.repeated_in_groups(docs).collect()}
    sets, prints = [simhash.shingles(t.encode()) for t in texts], [simhash.fingerprint(t.encode()) for t in texts]
    group = list(range(len(texts)))
    for a, x in enumerate(sets):
        for b in range(a):
            if group[a] != group[b] and (simhash.jaccard(x, sets[b]) >= simhash.LEAST or (prints[a] ^ prints[b]).bit_count() <= simhash.RADIUS):
                low, high = sorted((group[a], group[b]))
                group = [low if g == high else g for g in group]
    assert gone == {k + 1 for k, g in enumerate(group) if g != k}
    assert len(made) == 1 and made[0].count() < 16 * len(texts)


def test_texts_without_repeats_are_not_moved(spark, monkeypatch):
    twice = "a passage that is found in two documents, long enough for a hundred bytes and for some more bytes besides them all "
    rows = [(i, f"own text {i} " * 20, 0) for i in range(300)] + [(1000, "first " + twice, 0), (1001, "second " + twice, 0), (None, twice, 0), (None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    seen = []
    inner = suffix_dedup.with_hint
    monkeypatch.setattr(suffix_dedup, "with_hint", lambda *a: seen.append(inner(*a)) or seen[-1])
    kept = {(r.doc_id, r.text) for r in suffix_dedup.cut_stage(spark, docs, "").collect()}
    assert len(seen) == 2 and seen[1].where("_hint").count() < 304
    assert (None, twice) in kept and (None, None) in kept and (1000, "first " + twice) not in kept and len(kept) <= 304
