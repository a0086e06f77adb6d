from __future__ import annotations

import json

from pyspark.sql import functions as F

from tallyframe.functions.labels import notable_reasons
from tallyframe.operators import answers, gate, history, packets, records, reports
from tallyframe.operators.ranks import middles

TYPED = "struct<category:string,category_confidence:double,owner_confidence:double,needs_human_review:double,change_material:double>"


def _decide(spark, rule, material, answer, score=80, reason=None):
    df = spark.createDataFrame([(rule, material, answer, reason, score)], f"r string, m boolean, a {TYPED}, u string, s int")
    return df.select(gate.decide(*[F.col(c) for c in "rmaus"]).alias("d")).first().d


def test_gate(spark):
    good = ("INVESTIGATE", 0.9, 0.8, 0.2, 0.9)
    d = _decide(spark, "INVESTIGATE", True, good)
    assert (d.final_category, d.model_status, d.policy_status, d.policy_reasons, d.review_required) == ("INVESTIGATE", "SUCCEEDED", "PASSED", [], False)
    d = _decide(spark, "MONITOR", True, good)
    assert (d.final_category, d.policy_status, d.review_required) == ("MONITOR", "POLICY_BLOCKED", False)
    d = _decide(spark, "ESCALATE", True, None, reason="no_consent")
    assert (d.policy_status, d.policy_reasons) == ("REVIEW_REQUIRED", ["classification_unavailable:no_consent"])
    d = _decide(spark, "INVESTIGATE", True, good, score=40)
    assert (d.final_category, d.policy_status) == ("REQUEST_EVIDENCE", "POLICY_BLOCKED") and d.policy_reasons == ["readiness_below_threshold"]
    d = _decide(spark, "INVESTIGATE", True, ("INVESTIGATE", 0.4, 0.4, 0.6, 0.45))
    assert d.policy_reasons == ["low_confidence:category", "low_confidence:owner", "low_confidence:materiality", "model_requested_review", "materiality_conflict"]
    assert d.model_status == "LOW_CONFIDENCE"


def _answers(**changes):
    pick = lambda v: {"type": "choice", "choice": v, "confidence": 0.9, "probabilities": {v: 0.9}}
    score = lambda n: {"type": "score", "score": n, "confidence": 0.8, "probabilities": {"1": 0.8}}
    yes = {"type": "noul", "noul": 0.2}
    base = {"decision_category": pick("MONITOR"), "owner_group": pick("data"), "urgency": score(2.5), "risk_without_evidence": score(1),
            "primary_missing_evidence": pick("none"), "evidence_sufficient": yes, "needs_human_review": yes, "change_material": yes}
    return json.dumps({**base, **changes})


def test_malformed_answers_are_rejected(spark):
    pick = {"type": "choice", "choice": "MONITOR", "confidence": 0.9, "probabilities": {"MONITOR": 0.9}}
    bad = [_answers(decision_category={**pick, "choice": "DELETE"}), _answers(decision_category={**pick, "confidence": 1.2}),
           _answers(decision_category={**pick, "confidence": True}), _answers(decision_category={**pick, "probabilities": {"DELETE": 0.1}}),
           _answers(decision_category={**pick, "type": "score"}), _answers(urgency={"type": "score", "score": 4, "confidence": 0.8, "probabilities": {}}),
           _answers(change_material={"type": "noul"}), "{}", "not json", None]
    rows = spark.createDataFrame([(i, a) for i, a in enumerate([_answers(), *bad])], "i int, answers string")
    got = answers.validate_answers(rows).orderBy("i").collect()
    assert [r.valid for r in got] == [True] + [False] * len(bad)
    assert (got[0].answer.category, got[0].answer.urgency) == ("MONITOR", "high")  # 2.5 goes to the even level


def test_stand_in_answers_survive_validation(spark):
    df = spark.createDataFrame([("new_service", "AWS Lambda", "0.2000")], "kind string, safe_label string, s string").withColumn(
        "share_of_current", F.col("s").cast("decimal(20,4)"))
    made = answers.rule_answers(df).withColumn("answers", answers.answer_json(F.col("answer"))).drop("answer")
    row = answers.validate_answers(made).first()
    assert row.valid and (row.answer.owner, row.answer.urgency, row.answer.primary_missing) == ("application_engineering", "high", "owner_confirmation")


def test_availability_order_and_missing_merge(spark):
    df = spark.createDataFrame([("pending",), (None,), ("granted",)], "c string")
    got = [r.v for r in df.select(answers.answer_availability(F.col("c"), F.lit(True), F.lit(False)).alias("v")).collect()]
    assert got == ["awaiting_unlock", "no_consent", "not_configured"]
    rules = F.array(*map(F.lit, ("owner_confirmation", "utilization_metrics", "change_context")))
    row = spark.range(1).select(gate.merge_missing(rules, F.lit("allocation_tags")).alias("a"), gate.merge_missing(rules, F.lit("none")).alias("b"),
                                notable_reasons(F.array(F.lit("model_requested_review"), F.lit("low_confidence:owner")), F.lit(0.3)).alias("n")).first()
    assert row.a == ["owner_confirmation", "utilization_metrics", "allocation_tags"] and row.b[2] == "change_context"
    assert row.n == ["low_confidence:owner"]


def test_history_uses_report_month_not_arrival(spark):
    runs = spark.createDataFrame([("t1", "r7", "2026-07-01", 3), ("t2", "r8", "2026-08-01", 1), ("t1", "r6", "2026-06-01", 9), ("t1", "old7", "2026-07-01", 2)],
                                 "tenant_id string, run_id string, month string, created_at int").select(
        "tenant_id", "run_id", F.to_date("month").alias("month"), "created_at", F.lit("completed").alias("status"), F.lit(1).alias("completed_at"))
    owners = spark.createDataFrame([("t1", "o"), ("t2", "o")], "tenant_id string, owner string")
    prev = history.previous_run(runs, owners)
    assert {r.run_id: r.previous_run_id for r in prev.collect()} == {"r8": "r7", "r7": "r6", "old7": "r6"}
    f = spark.createDataFrame([("t1", "r7", "a", 100.0), ("t1", "r7", "b", 100.0), ("t1", "r7", "c", 100.0), ("t2", "r8", "a", 103.0), ("t2", "r8", "b", 99.0), ("t2", "r8", "d", 1.0)],
                              "tenant_id string, run_id string, finding_key string, observed_value double").select(
        "*", F.col("finding_key").alias("title"), F.lit("MONITOR").alias("final_category"), F.lit(1.0).alias("delta_value"))
    got = {r.finding_key: r.outcome for r in history.carry_over(prev, f).where("run_id = 'r8'").collect()}
    assert got == {"a": "grew", "b": "unchanged", "c": "resolved"}
    assert {r.run_id: r.new_count for r in history.new_subjects(prev, f).collect()} == {"r8": 1}


def test_agreement_median_is_the_upper_middle(spark):
    df = spark.createDataFrame([("MONITOR", "MONITOR", c) for c in (0.1, 0.2, 0.3, 0.4)], "rule_category string, model_category string, confidence double").select(
        "*", F.col("rule_category").alias("final_category"), F.lit(False).alias("review_required"))
    row = reports.agreement(df).first()
    assert (row.confidence_median, row.agreed_pct, row.overridden) == (0.3, 100, 0)


def test_middles_are_exact_over_ranges(spark):
    rows = [("a", float(i * 37 % 101)) for i in range(100)] + [("b", 1.0)] * 7 + [(None, 2.0), (None, 4.0), ("c", None)]
    got = {r.k: (r.lower, r.upper) for r in middles(spark.createDataFrame(rows, "k string, v double").repartition(7), ["k"], "v").collect()}
    want = sorted(v for k, v in rows if k == "a")
    assert got == {"a": (want[49], want[50]), "b": (1.0, 1.0), None: (2.0, 4.0)}
    assert middles(spark.createDataFrame([], "v double"), [], "v").first().upper is None


def test_alias_numbers_match_a_plain_rank(spark):
    names = spark.range(500).select(F.lit("t").alias("tenant_id"), F.lit("e").alias("export_id"), F.lit("account").alias("dimension"),
                                    F.sha2(F.col("id").cast("string"), 256).alias("label"))
    got = {r.label: r.number for r in packets.alias_numbers(names.limit(20), names).collect()}
    order = sorted(r.label for r in names.collect())
    assert len(got) == 20 and all(order[n - 1] == label for label, n in got.items())


def test_previous_value_across_slices(spark, monkeypatch):
    """Slices of the file are only a way to split work: every slice size gives the plain lag."""
    monkeypatch.setattr(records, "SLICE", 7)
    df = spark.range(200).select(F.lit("k").alias("k"), F.col("id").alias("line"), (F.col("id") * 31 % 17).alias("v"))
    got = {r.line: r.previous for r in records.previous_in(df, ["k"], F.col("v")).collect()}
    assert got == {i: (None if i == 0 else (i - 1) * 31 % 17) for i in range(200)}
