"""Corpus reports: rules against stored answers, packet variants, replay of stored answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.answers import validate_answers
from tallyframe.operators.ranks import middles
from tallyframe.schema import KEYS
from tallyframe.session import cut


def confusion(decisions: DataFrame) -> DataFrame:
    """How often each pair of rule and answered category occurs."""
    return decisions.groupBy("rule_category", F.coalesce("model_category", F.lit("-")).alias("model_category")).agg(
        F.count(F.lit(1)).alias("findings"))


def agreement(decisions: DataFrame) -> DataFrame:
    """One row: agreement, overrides, reviews and the spread of confidence.

    decisions: rule_category, model_category, final_category, confidence, review_required. The median
    is the upper middle element, found over ranges of the values.
    """
    # Read twice, so what both passes need is stored.
    decisions = cut(decisions.select("rule_category", "model_category", "final_category", "confidence", "review_required"))
    rule, model = F.col("rule_category"), F.coalesce("model_category", F.lit("-"))
    return decisions.agg(
        F.count(F.lit(1)).alias("findings"),
        F.count_if(rule == model).alias("agreed"), F.count_if(rule != model).alias("differed"),
        F.count_if((model != "-") & (model != F.col("final_category"))).alias("overridden"),
        F.count_if("review_required").alias("review"),
        F.min("confidence").alias("confidence_min"),
        F.max("confidence").alias("confidence_max"),
    ).withColumn("confidence_median", middles(decisions, [], "confidence").select("upper").scalar()).withColumn("agreed_pct", F.floor(F.col("agreed") * 100 / F.greatest("findings", F.lit(1))).cast("bigint"))


def reason_counts(decisions: DataFrame) -> DataFrame:
    # Outer, then filtered: a plain explode pushes "has reasons" below everything that computed them.
    return decisions.select(F.explode_outer("policy_reasons").alias("reason")).where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def variant_report(answered: DataFrame) -> DataFrame:
    """One row per packet variant over classified findings, with the five pre-set bars.

    answered: variant, dimension, rule_category, answer (typed).
    """
    # Read three times, so the values that the passes need are stored once.
    needed = ["category", "category_confidence", "owner_confidence", "evidence_sufficient", "needs_human_review"]
    a = F.col("answer")
    found = cut(answered.where(a.isNotNull()).select(
        "variant", "dimension", "rule_category", F.struct(*[a[c].alias(c) for c in needed]).alias("answer")))

    def half(value: Column, name: str) -> DataFrame:
        middle = middles(found.select("variant", value.alias("_value")), ["variant"], "_value")
        return middle.select(F.col("variant").alias(f"_of{name}"), F.round(F.col("lower") * 0.5 + F.col("upper") * 0.5, 3).alias(name))

    confidence = half(a["category_confidence"], "median_confidence")
    owner = half(F.when(F.col("dimension") == "service", a["owner_confidence"]), "_owner")
    counts = found.groupBy("variant").agg(
        F.count(F.lit(1)).alias("findings"),
        F.min(a["category_confidence"]).alias("confidence_min"), F.max(a["category_confidence"]).alias("confidence_max"),
        F.count_distinct(a["category"]).alias("categories_used"),
        F.count_distinct(F.bround(a["evidence_sufficient"], 2)).alias("sufficiency_distinct"),
        F.count_if(a["needs_human_review"] >= 0.5).alias("needs_review"),
        F.count_if(a["category"] == F.col("rule_category")).alias("agreed"),
    )
    joined = (counts.join(confidence, F.col("variant").eqNullSafe(F.col("_ofmedian_confidence")), "left")
              .join(owner, F.col("variant").eqNullSafe(F.col("_of_owner")), "left").drop("_ofmedian_confidence", "_of_owner"))
    return joined.withColumn("median_owner_confidence", F.coalesce("_owner", F.lit(0.0))).drop("_owner").withColumn(
        "bars_cleared",
        sum((F.coalesce(bar, F.lit(False)).cast("int") for bar in (
            F.col("median_confidence") >= 0.60, F.col("categories_used") >= 3, F.col("sufficiency_distinct") > 1,
            (F.col("needs_review") > 0) & (F.col("needs_review") < F.col("findings")),
            F.col("median_owner_confidence") >= 0.60)), F.lit(0)))


def moved(first: DataFrame, second: DataFrame) -> DataFrame:
    """Findings both variants answered, and whether the category changed."""
    left = first.where(F.col("answer").isNotNull()).select(*KEYS, "evidence_id", F.col("answer.category").alias("first_category"))
    right = second.where(F.col("answer").isNotNull()).select(*KEYS, "evidence_id", F.col("answer.category").alias("second_category"))
    return left.join(right, [*KEYS, "evidence_id"]).withColumn("changed", F.col("first_category") != F.col("second_category"))


def replay(packed: DataFrame, calls: DataFrame) -> DataFrame:
    """Latest stored answer of each packet within its run, validated again; `changed` against what the
    finding recorded then.

    packed: tenant_id, run_id, evidence_id, packet_sha256, stored_category, stored_confidence.
    """
    key = ["tenant_id", "run_id", "packet_sha256"]
    latest = calls.where(F.col("status") == "succeeded").groupBy(*key).agg(
        # The text travels once, inside what orders the calls.
        F.max(F.struct("created_at", "answers"))["answers"].alias("answers"))
    checked = validate_answers(packed.join(latest, key, "left"))
    category = F.col("answer.category")
    return checked.select(
        "tenant_id", "run_id", "evidence_id", "stored_category", "stored_confidence",
        category.alias("replay_category"), F.col("answer.category_confidence").alias("replay_confidence"),
        F.when(F.col("answers").isNull(), "no stored answer").when(F.col("valid"), "stored answer valid")
        .otherwise(F.concat(F.lit("stored answer invalid: "), F.col("invalid_question"))).alias("note"),
        (~F.col("stored_category").eqNullSafe(category)).alias("changed"))
