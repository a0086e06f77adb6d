"""Text operators: brute force, SQL, held-out accuracy, and odd rows."""

from __future__ import annotations

import itertools
import math
from hashlib import md5

import duckdb
import numpy as np
import pytest

from tallyframe.llm import chat, cotrain, langid, mixing, toxicity, wu_manber
from tallyframe.llm.learn import labelled_sample, remainder

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {t: spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark")}


def in_sql(sql, folder=SF):
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con.sql(sql)


def same_as_sql(df, sql):
    names = sorted(df.columns)
    want = in_sql(sql).df()[names]
    got = df.toPandas()[names]
    assert sorted(map(repr, got.astype(str).values.tolist())) == sorted(map(repr, want.astype(str).values.tolist()))


def test_queries_equal_their_sql(spark):
    same_as_sql(chat.op4(spark, SF), chat.ORACLE)
    same_as_sql(wu_manber.op8(spark, SF), wu_manber.ORACLE)
    same_as_sql(mixing.op10(spark, SF), mixing.ORACLE)


def test_contamination(spark):
    items = [(1, "a b c d e f g h i j k"), (2, "short one"), (3, "x"), (4, None), (5, "..."), (None, "a b"), (6, "short one"), (7, "b c d e f g h i j k l")]
    texts = ["A b, c d e f g h i j k l m", "nothing here", "x a short ONE x", None, "", "a b c d e f g h i", "short x one", "short short one one", "É x é"]
    docs = spark.createDataFrame([(i % 7, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, contamination int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for i, t in items:
        w = wu_manber.words(t.encode() if t else None)
        if i is not None and w:
            for a in range(max(1, len(w) - 9)):
                windows.setdefault(tuple(w[a:a + 10]), set()).add(i)
    for most in (1, 2, 1000):
        got = wu_manber.find_contamination(spark, docs, bench, most=most).collect()
        for row in got:
            w = wu_manber.words(row.text.encode() if row.text else None)
            hit, found = set(), set()
            for a, p in itertools.product(range(len(w)), windows):
                if tuple(w[a:a + len(p)]) == p:
                    hit |= set(range(a, a + len(p)))
                    found |= windows[p]
            c = row.contamination
            assert (c.n_words, c.n_hit, sorted(c["items"])) == (len(w), len(hit), sorted(found)), row.text
            assert {j for s in c.spans for j in range(s.start, s.end)} == hit
    none = wu_manber.find_contamination(spark, docs, bench.limit(0)).collect()
    assert len(none) == len(texts) and not any(r.contamination.n_hit for r in none)
    assert wu_manber.find_contamination(spark, docs.limit(0), bench).count() == 0


def test_chat_round_trip_and_rewriting(spark):
    nasty = ["", "\\", "\\\\", "### user: x </turn>\n", " </turn>\n", "a: b", "\\### Assistant: </turn> ok", "é😀\x00\x01", "#:<\\:"]
    turns = [(1, i, r, t) for i, (r, t) in enumerate(itertools.product(("user", "assistant", "a: b\\", ""), nasty))]
    turns += [(2, 0, None, None), (2, 0, None, None), (None, None, "assistant", "x"), (3, 1, "assistant", "b"), (3, 1, "assistant", "a")]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    for row in chat.format_conversations(df).collect():
        own = sorted(((t or -1), r or "", x or "") for c, t, r, x in turns if c == row.conv_id)
        assert chat.read_back(row.chat.formatted) == [(r, x) for _, r, x in own]
        loss = [chat._unescaped(row.chat.formatted[m.start:m.end]) for m in row.chat["mask"]]
        assert loss == [x for _, r, x in own if r == "assistant"]
    done = chat.render([("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")], chat.forgetful_template)
    assert done["rewritten_at"] == 2 and not done["mask"]
    assert chat.digests(chat.format_conversations(df.limit(0))).count() == 0


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    score, trans, start = rng.standard_normal(7) * 2, rng.standard_normal((2, 2)), rng.standard_normal(2)
    first = np.array([1, 0, 0, 1, 0, 0, 0], bool)
    got, pairs = toxicity.forward_backward(score, first, trans, start, True)
    for a, b in ((0, 3), (3, 7)):
        weight = {}
        for path in itertools.product((0, 1), repeat=b - a):
            total = start[path[0]] + sum(s * p for s, p in zip(score[a:b], path, strict=True)) + sum(trans[x, y] for x, y in itertools.pairwise(path))
            weight[path] = math.exp(total)
        z = sum(weight.values())
        for i in range(b - a):
            assert got[a + i] == pytest.approx(sum(w for p, w in weight.items() if p[i]) / z)
            if i:
                assert pairs[a + i][0, 1] == pytest.approx(sum(w for p, w in weight.items() if (p[i - 1], p[i]) == (0, 1)) / z)
    long = rng.standard_normal(3000)
    heads = rng.random(3000) < 0.05
    heads[0] = True
    whole = toxicity.forward_backward(long, heads, trans, start)[0]
    edges = [*np.flatnonzero(heads).tolist(), 3000]
    apart = np.concatenate([toxicity.forward_backward(long[a:b], np.arange(b - a) == 0, trans, start)[0] for a, b in itertools.pairwise(edges)])
    assert np.allclose(whole, apart)


ODD = [(None, None), (-1, ""), (-2, " \n "), (-2, " \n "), (-3, "word " * 5000), (-4, "12 34 !!")]


def test_toxicity(spark, tables):
    docs = tables["documents"].select("doc_id", "text")
    tagger = toxicity.fit(docs, tables["labels"])
    odd = spark.createDataFrame([(i, t, "x") for i, t in ODD], "doc_id long, text string, toxicity string")
    got = toxicity.score(odd, tagger).collect()
    assert len(got) == len(ODD) and all(0 <= r.toxicity.score < 0.7 for r in got)
    truth = {r.doc_id: r.toxic for r in tables["labels"].collect()}
    rows = [r for r in toxicity.op6(spark, SF).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert not any(r.predicted for r in rows if not truth[r.doc_id])
    assert np.mean([r.predicted for r in rows if truth[r.doc_id]]) > 0.7  # 33 toxic documents teach it at this size
    spans = toxicity.score(spark.createDataFrame([(1, "Ä such an idiot, you")], "doc_id long, text string"), tagger).first().toxicity.spans
    assert [("Ä such an idiot, you".encode()[s.start:s.end]) for s in spans] == [b"idiot"]
    assert toxicity.fit(docs, tables["labels"].limit(0)) is None
    assert {r.toxicity.score for r in toxicity.score(odd, None).collect()} == {0.0}


def test_language(spark, tables):
    docs = tables["documents"]
    models = langid.fit(docs, remainder("doc_id", 5) != 0)
    got = langid.identify(spark.createDataFrame([(i, t, 1) for i, t in ODD], "doc_id long, text string, language int"), models).collect()
    assert [r.language.lang for r in got if not any(c.isalpha() for c in r.text or "")] == ["und"] * 5
    rows = langid.op7(spark, SF).join(docs.select("doc_id", "lang"), "doc_id").where("held_out AND lang IS NOT NULL").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97 and all(0 <= r.score <= 1 for r in rows)
    # Probabilities after a context add up to at most one, and to nearly one over the letters seen.
    letters = langid.grams(["abcdefghijklmnopqrstuvwxyzäöüßéèêçñíóá "])[0] & 4095
    context = int(langid.grams(["the"])[0][-1]) << langid.BITS
    total = np.exp(models.log_probs(np.unique(letters) | (context & ((1 << 60) - 1)))).sum(0)
    assert (total < 1.0001).all() and total[models.languages.index("en")] > 0.9
    nothing = langid.fit(docs.limit(0), remainder("doc_id", 5) != 0)
    assert {r.language.lang for r in langid.identify(docs.limit(5), nothing).collect()} == {"und"}


def test_models_in_shards_keep_all_grams(spark, tables):
    docs = tables["documents"].select("doc_id", "text", "lang")
    rare = spark.createDataFrame([(10 ** 6 + i, t, "xx") for i, t in enumerate(["\u03b1\u03b2\u03b3 \u03b4\u03b5\u03b6", "\u03b6\u03b7\u03b8 \u03b1\u03b2\u03b3"])], "doc_id long, text string, lang string")
    both, always = docs.unionByName(rare), remainder("doc_id", 5) >= 0
    one, many = langid.fit(both, always), langid.fit(both, always, most=20_000)
    assert isinstance(one, langid.Models) and isinstance(many, langid.Sharded) and many.parts > 3
    assert sum(len(m.grams[-1].hashes) for _, m in many.shards()) == len(one.grams[-1].hashes)
    odd = spark.createDataFrame([(i, t, 1) for i, t in ODD] + [(900, "\u03b1\u03b2\u03b3 \u03b6\u03b7\u03b8", 1), (900, "\u03b1\u03b2\u03b3 \u03b6\u03b7\u03b8", 1)], "doc_id long, text string, language int")
    for some in (odd, both.where("doc_id < 300")):
        want, got = (sorted(langid.identify(some, m).collect(), key=lambda r: repr((r.doc_id, r.text))) for m in (one, many))
        assert [(r.doc_id, r.text, r.language.lang, r.language.rejected) for r in got] == [(r.doc_id, r.text, r.language.lang, r.language.rejected) for r in want]
        assert np.allclose([r.language.score for r in got], [r.language.score for r in want], atol=1e-4)
    assert {r.language.lang for r in langid.identify(odd.where("doc_id = 900"), many).collect()} == {"xx"}


def test_samples_hold_an_id_once(spark):
    docs = spark.createDataFrame([(i % 5 if i < 400 else i, f"word {i:04d}", "en") for i in range(420)], "doc_id long, text string, lang string")
    labels = spark.range(0, 420).selectExpr("id AS doc_id", "id % 2 AS toxic")
    some = labelled_sample(docs, labels, "toxic", remainder("doc_id", 3) >= 0, 12, 100)
    assert len({r["doc_id"] for r in some}) == len(some) == 24  # 12 of the 13 even ids, and all 12 odd ones
    assert all(r["text"] == f"word {r['doc_id']:04d}" for r in some)
    rows = langid.calibration_rows(docs, ["en"], 10)
    assert len(rows) == len({r["text"] for r in rows}) == 10
    assert len(langid.calibration_rows(docs, ["en"], 100)) == 25 and langid.calibration_rows(docs, ["xx"]) == []


def test_gram_counts_cover_all_rows(spark):
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate([("abab", "x"), ("ab", "x"), (None, "x"), ("ab", None), ("Ab--ab", "y")])], "doc_id long, text string, lang string")
    counts = {(r.lang, r.gram): r["count"] for r in langid.count_grams(docs).collect()}
    want = {}
    for t, lang in (("abab", "x"), ("ab", "x"), ("ab ab", "y")):
        for i in range(len(t)):
            gram = 0
            for c in t[max(0, i - 4):i + 1]:
                gram = gram << 12 | (0 if c == " " else ord(c))
            want[lang, gram] = want.get((lang, gram), 0) + 1
    assert counts == want


def test_quality(spark, tables):
    truth = {r.doc_id: r.quality for r in tables["labels"].collect()}
    rows = [r for r in cotrain.op9(spark, SF).collect() if r.held_out and truth.get(r.doc_id) is not None]
    assert np.mean([r.predicted == truth[r.doc_id] for r in rows]) > 0.95
    odd = spark.createDataFrame([(i, t, None, None, 1) for i, t in ODD], "doc_id long, text string, source string, lang string, text_score int")
    model = cotrain.fit(tables["documents"], tables["labels"])
    assert all(0 <= r.quality_view.score <= 1 for r in cotrain.score(odd, model).collect())
    assert cotrain.fit(tables["documents"], tables["labels"].where("quality = 1")) is None
    assert {r.quality_view.score for r in cotrain.score(odd, None).collect()} == {0.5}


def copies_by_hand(rate, i, text):
    parts, total = max(1, math.ceil(rate / 16)), 0
    for part in range(1, parts + 1):
        key = md5((text or "").encode()).hexdigest()
        u = int(md5(f"{mixing.SEED}|{'' if i is None else i}|{key}|{part}".encode()).hexdigest()[:12], 16) / 2 ** 48
        mean, k = rate / parts, 0
        p = c = math.exp(-mean)
        while c <= u and k < mixing.STEPS:
            k += 1
            p *= mean / k
            c += p
        total += k
    return total


def test_mixing(spark):
    docs = spark.createDataFrame([(i, f"t{i}", s, 0) for i, s in enumerate(["a"] * 60 + ["b"] * 5 + [None] * 3)] + [(1, "t1", "a", 0), (None, None, "b", 0)],
                                 "doc_id long, text string, source string, copy int")
    for weights in (None, {"a": 1.0, "b": 9.0}, {"a": 0.5, None: 4.0, "zz": 3.0, "b": float("nan")}):
        given = None if weights is None else spark.createDataFrame(list(weights.items()), "source string, weight double")
        rows = docs.collect()
        sizes = {s: sum(r.source == s for r in rows) for s in ("a", "b", None)}
        weight = {s: n ** 0.5 for s, n in sizes.items()} if weights is None else {s: (weights.get(s) or 0.0) if weights.get(s) == weights.get(s) else 0.0 for s in sizes}
        rate = {s: weight[s] / sum(weight.values()) * 300 / sizes[s] for s in sizes}
        want = sorted((str(r.doc_id), c) for r in rows for c in range(copies_by_hand(rate[r.source], r.doc_id, r.text)))
        mixed = mixing.mix(docs, given, 300)
        got = mixed.collect()
        assert sorted((str(r.doc_id), r["copy"]) for r in got) == want
        keys = [r.shuffle_key for r in got]
        assert keys == sorted(keys) and set(mixed.columns) == {*docs.columns, "shuffle_key"}
    assert mixing.mix(docs.limit(0)).count() == 0
