"""The pipeline's stages, each on its own input, against what the operators and brute force say."""

from __future__ import annotations

import corpus_pipeline
from tallyframe.llm import mixing, wu_manber

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {}
    for k, (name, fn) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        fn(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        kept[name] = {r.doc_id: r for r in docs.collect()}
        assert kept[name].keys() <= before.keys()
        if name != "mix":
            assert docs.columns == columns
        if name == "repeat_dedup":
            seen = set()
            for i in sorted(before):  # no window of 100 bytes is lost
                body = before[i].text.encode()
                seen |= {body[p:p + 100] for p in range(len(body) - 99)}
            left = [w for r in kept[name].values() for b in [r.text.encode()] for p in range(len(b) - 99) for w in [b[p:p + 100]] if w in seen]
            assert len(left) == len(set(left))
        if name == "decontaminate":
            windows = {tuple(w[a:a + 10]) for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() for w in [wu_manber.words(t.encode())] for a in range(max(1, len(w) - 9))}
            dirty = {i for i, r in before.items() for w in [wu_manber.words(r.text.encode())] if any(tuple(w[a:a + len(p)]) == p for p in windows for a in range(len(w)))}
            assert kept[name].keys() == before.keys() - dirty
        if name == "mix":
            assert docs.columns == [*columns, "copy", "shuffle_key"]
            assert docs.count() == mixing.mix(spark.read.parquet(f"{tmp_path}/{k - 1}")).count()


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (_, fn) in enumerate(corpus_pipeline.STAGES):
        fn(spark, docs, SF).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        assert docs.count() == 0
