"""The decision gate: rules decide the category, a stored answer can only ask for a review."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.schema import KEYS, MAX_MISSING, READINESS_FLOOR

SUCCEEDED, LOW_CONFIDENCE, UNAVAILABLE = "SUCCEEDED", "LOW_CONFIDENCE", "UNAVAILABLE_REVIEW_REQUIRED"


def decide(rule_category: Column, material: Column, answer: Column, unavailable_reason: Column, score: Column,
           low: float = 0.5, margin: float = 0.3) -> Column:
    """struct(final_category, model_status, policy_status, reasons, review_required)."""
    has = answer.isNotNull()
    yes = lambda c: F.coalesce(c, F.lit(False))
    weak = F.array_compact(F.array(
        F.when(yes(answer["category_confidence"] < low), "low_confidence:category"),
        F.when(yes(answer["owner_confidence"] < low), "low_confidence:owner"),
        F.when(yes(F.abs(answer["change_material"] * 2 - 1) < margin), "low_confidence:materiality"),
    ))
    thin = (score < READINESS_FLOOR) & (rule_category != "REQUEST_EVIDENCE")
    final = F.when(thin, "REQUEST_EVIDENCE").otherwise(rule_category)
    reasons = F.concat(
        F.array_compact(F.array(F.when(~has, F.concat(
            F.lit("classification_unavailable:"), F.coalesce(unavailable_reason, F.lit("unknown")))))),
        F.when(has, weak).otherwise(F.array().cast("array<string>")),
        F.array_compact(F.array(
            F.when(yes(answer["needs_human_review"] >= 0.5), "model_requested_review"),
            F.when(has & yes((answer["change_material"] >= 0.5) != material), "materiality_conflict"),
            F.when(thin, "readiness_below_threshold"))),
    )
    review = F.size(reasons) > 0
    status = F.when(~has, UNAVAILABLE).when(F.size(weak) > 0, LOW_CONFIDENCE).otherwise(SUCCEEDED)
    policy = (F.when(yes(answer["category"] != final), "POLICY_BLOCKED").when(review, "REVIEW_REQUIRED")
              .otherwise("PASSED"))
    return F.struct(final.alias("final_category"), status.alias("model_status"), policy.alias("policy_status"),
                    reasons.alias("policy_reasons"), review.alias("review_required"))


def gate(findings: DataFrame, readiness: DataFrame, low: float = 0.5, margin: float = 0.3) -> DataFrame:
    """Findings carry `answer` (typed, may be NULL) and `unavailable_reason`; adds the decision."""
    material = F.col("material_absolute") | F.col("material_relative")
    return (
        findings.join(readiness.select(*KEYS, F.col("score").alias("readiness_score")), KEYS)
        .withColumn("_d", decide(F.col("default_category"), material, F.col("answer"), F.col("unavailable_reason"),
                                 F.col("readiness_score"), low, margin))
        .select("*", "_d.*").drop("_d")
    )


def run_model_status(decided: DataFrame) -> DataFrame:
    """Worst status of the run's findings; runs without findings are absent."""
    order = F.when(F.col("model_status") == UNAVAILABLE, 0).when(F.col("model_status") == LOW_CONFIDENCE, 1).otherwise(2)
    return decided.groupBy(*KEYS).agg(F.min(order).alias("_worst")).select(
        *KEYS, F.get(F.array(*map(F.lit, (UNAVAILABLE, LOW_CONFIDENCE, SUCCEEDED))), F.col("_worst")).alias("model_status"))


def merge_missing(rules: Column, named: Column) -> Column:
    """The rule-based gaps plus one the answer names on top; the generic gap makes way when full."""
    new = F.coalesce(named, F.lit("none"))
    add = (new != "none") & ~F.array_contains(rules, new)
    room = F.when(F.size(rules) >= MAX_MISSING, F.array_remove(rules, "change_context")).otherwise(rules)
    return F.slice(F.when(add, F.array_append(room, new)).otherwise(rules), 1, MAX_MISSING)
