"""Findings of the third review: work done once, and what it gives."""
from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyframe.operators import answers, reports

PICK = "category:string,category_confidence:double,owner_confidence:double,evidence_sufficient:double,needs_human_review:double"


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _stored(confidence: float) -> str:
    pick = lambda v: {"type": "choice", "choice": v, "confidence": confidence, "probabilities": {v: confidence}}
    score = {"type": "score", "score": 1, "confidence": 0.8, "probabilities": {"1": 0.8}}
    yes = {"type": "noul", "noul": 0.2}
    return json.dumps({"decision_category": pick("MONITOR"), "owner_group": pick("data"), "urgency": score, "risk_without_evidence": score,
                       "primary_missing_evidence": pick("none"), "evidence_sufficient": yes, "needs_human_review": yes, "change_material": yes})


def test_a_filter_on_the_answer_does_not_parse_again(spark):
    rows = spark.createDataFrame([(1, _stored(0.9)), (2, "{}"), (3, None)], "i int, answers string")
    good = answers.validate_answers(rows).where(F.col("answer").isNotNull()).select("i", "answer.category", "answer.owner")
    assert [tuple(r) for r in good.collect()] == [(1, "MONITOR", "data")]
    assert _plan(good).count("from_json") == 1 and "lambdafunction(named_struct(bad" not in _plan(good)
    assert answers.validate_answers(rows).count() == 3


def test_variant_report_reads_stored_values(spark):
    rows = spark.createDataFrame([("a", _stored(c)) for c in (0.1, 0.2, 0.9, 0.5)] + [("b", "{}")], "variant string, answers string")
    found = answers.validate_answers(rows).select("variant", F.lit("service").alias("dimension"), F.lit("MONITOR").alias("rule_category"), "answer")
    report = reports.variant_report(found)
    assert "from_json" not in _plan(report)
    [row] = report.collect()
    assert (row.variant, row.findings, row.agreed, row.median_confidence, row.median_owner_confidence) == ("a", 4, 4, 0.35, 0.35)


def test_agreement_reads_stored_values(spark):
    rows = spark.createDataFrame([(_stored(c),) for c in (0.1, 0.2, 0.9)] + [("{}",)], "answers string")
    found = answers.validate_answers(rows).select(
        F.lit("MONITOR").alias("rule_category"), F.col("answer.category").alias("model_category"), F.lit("MONITOR").alias("final_category"),
        F.col("answer.category_confidence").alias("confidence"), F.lit(False).alias("review_required"))
    report = reports.agreement(found)
    assert "from_json" not in _plan(report)
    row = report.first()
    assert (row.findings, row.agreed, row.confidence_min, row.confidence_median, row.confidence_max) == (4, 3, 0.1, 0.2, 0.9)


def _star(spark, folder) -> str:
    """Twelve months of four line items each, in one region."""
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    put("region", [(0, "ASIA")], "r_regionkey long, r_name string")
    put("nation", [(0, "CHINA", 0)], "n_nationkey long, n_name string, n_regionkey long")
    put("customer", [(1, 0, "HOUSEHOLD"), (2, 0, "BUILDING")], "c_custkey long, c_nationkey long, c_mktsegment string")
    put("supplier", [(1, "s1", 0)], "s_suppkey long, s_name string, s_nationkey long")
    put("part", [(1, "Brand#1", "TIN"), (2, "Brand#2", "TIN")], "p_partkey long, p_brand string, p_type string")
    put("orders", [(1, 1, "F"), (2, 2, "O")], "o_orderkey long, o_custkey long, o_orderstatus string")
    lines = [(o, p, 1, m * 2 + p, 1.0 * m, 1000.0 * m * p, 0.05, "A", f"2001-{m:02d}-01") for m in range(1, 11) for o in (1, 2) for p in (1, 2)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, "
                          "l_returnflag string, d string").selectExpr("*", "cast(d AS timestamp) AS l_shipdate").drop("d").write.parquet(f"{folder}/lineitem.parquet")
    return str(folder)


def test_star_records_are_joined_once_and_only_rows_of_asked_months_are_unpivoted(spark, tmp_path):
    from tallyframe.plans import queries, star
    folder = _star(spark, tmp_path)
    a = queries.analysis(spark, folder, "untagged")
    assert "Join" not in _plan(a.records)
    assert sorted(map(str, a.records.collect())) == sorted(map(str, star.records(spark, folder, "untagged").collect()))
    assert a.records.count() == 40 and a.records.where("unallocated").count() == 20
    plan = _plan(a.refs)
    assert "LeftSemi" in plan.split("Expand")[1]  # below the unpivot
    refs = {r.evidence_id: r.refs for r in a.refs.collect()}
    gap = [v for k, v in refs.items() if "unallocated" in k]
    # Line keys of October: customers' orders 1 and 2 share every unallocated label but the tag.
    assert [[x.line for x in v] for v in gap] == [[29, 30, 37, 38]]
    queries.forget()


def test_language_calibration_scores_every_learning_text(spark):
    import numpy as np

    from tallyframe.llm import langid
    rows = [(i, f"the {'abcdefgh'[i % 8]} and of {i} " * (1 + i % 3), "en") for i in range(40)] + [(100 + i, f"der die {'stuvwxyz'[i % 8]} und ", "de") for i in range(40)]
    rows += [(500, "und der " * 4_000, "de"), (501, "12 34", "de"), (502, None, "en")]  # one longer than the sample took, one without letters
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, many = (langid.fit(docs, F.lit(True), most=m) for m in (langid.MOST, 50))
    assert isinstance(many, langid.Sharded)
    texts, truth = [t for _, t, _ in rows], [g for _, _, g in rows]
    sums, sizes = one.sums(texts)
    use = sizes > 0
    assert langid.scored_rows(docs, one).count() == langid.scored_rows(docs, many).count() == use.sum() == len(rows) - 2
    found = langid.entropies(sums, sizes)
    for j, lang in enumerate(one.languages):
        own = np.array([e[j] for e, t, u in zip(found, truth, use, strict=True) if u and t == lang])
        assert np.isclose(one.limit[j], own.mean() + 6 * own.std() + 0.1) and np.isclose(many.limit[j], one.limit[j])
    right = [one.languages.index(t) for t in truth]
    loss = lambda s: sum(np.log(np.exp(-s * (e - e[r])).sum()) for e, r, u in zip(found, right, use, strict=True) if u)
    best = loss(one.sharpness)
    assert all(best <= loss(0.5 * 1.5 ** i) + 1e-9 for i in range(12)) and np.isclose(many.sharpness, one.sharpness)


def test_the_stage_links_by_fingerprints_too(spark):
    from tallyframe.llm import simhash
    loop = "alpha beta gamma " * 50
    texts = [loop, loop + " ".join(f"w{i}" for i in range(40)), "quite another text of its own, with words enough"]
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id long, text string")
    a, b = (simhash.fingerprint(t.encode()) for t in texts[:2])
    sets = [simhash.shingles(t.encode()) for t in texts[:2]]
    assert (a ^ b).bit_count() <= 3 and simhash.jaccard(*sets) < 0.1
    assert {r.doc_id for r in simhash.similar_stage(spark, docs, "").collect()} == {1, 3}
