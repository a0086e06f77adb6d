"""Stored classification answers: validation, latest lookup, rule-based stand-in, permission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.schema import CATEGORIES, MISSING_LABELS, OWNER_GROUPS, QUESTION_KEYS, RISK_LEVELS, URGENCY_LEVELS

ANSWER_TYPE = ("map<string,struct<type:string,choice:string,confidence:double,score:double,noul:double,"
               "probabilities:map<string,double>>>")


def _lits(values):
    return F.array(*map(F.lit, values))


def _probability(c: Column) -> Column:
    return F.coalesce((c >= 0) & (c <= 1), F.lit(False))


def _probabilities(p: Column) -> Column:
    return p.isNotNull() & F.coalesce(F.forall(F.map_values(p), lambda x: F.coalesce((x >= 0) & (x <= 1), F.lit(False))), F.lit(False))


def _choice(a: Column, allowed: list[str]) -> Column:
    return (
        F.coalesce((a["type"] == "choice") & a["choice"].isin(allowed), F.lit(False))
        & _probability(a["confidence"]) & _probabilities(a["probabilities"])
        & F.coalesce(F.size(F.array_except(F.map_keys(a["probabilities"]), _lits(allowed))) == 0, F.lit(False))
    )


def _score(a: Column, levels: list[str]) -> Column:
    index = [str(i) for i in range(len(levels))]
    return (
        F.coalesce((a["type"] == "score") & (a["score"] >= 0) & (a["score"] <= len(levels) - 1), F.lit(False))
        & _probability(a["confidence"]) & _probabilities(a["probabilities"])
        & F.coalesce(F.size(F.array_except(F.map_keys(a["probabilities"]), _lits(index))) == 0, F.lit(False))
    )


def _yes_no(a: Column) -> Column:
    return F.coalesce(a["type"] == "noul", F.lit(False)) & _probability(a["noul"])


def _level(a: Column, levels: list[str]) -> Column:
    # Nearest level, halves to the even one.
    return F.get(_lits(levels), F.least(F.lit(len(levels) - 1), F.bround(a["score"], 0).cast("int")))


def validate_answers(calls: DataFrame, column: str = "answers") -> DataFrame:
    """Adds `valid`, `invalid_question` and the typed `answer`; malformed answers are never repaired."""
    def judge(parsed: Column) -> Column:
        at = lambda key: F.try_element_at(parsed, F.lit(key))
        checks = {
            "decision_category": _choice(at("decision_category"), CATEGORIES),
            "owner_group": _choice(at("owner_group"), list(OWNER_GROUPS)),
            "primary_missing_evidence": _choice(at("primary_missing_evidence"), list(MISSING_LABELS)),
            "urgency": _score(at("urgency"), URGENCY_LEVELS),
            "risk_without_evidence": _score(at("risk_without_evidence"), RISK_LEVELS),
            "evidence_sufficient": _yes_no(at("evidence_sufficient")),
            "needs_human_review": _yes_no(at("needs_human_review")),
            "change_material": _yes_no(at("change_material")),
        }
        first_bad = F.coalesce(
            *[F.when(at(k).isNull(), F.lit(k)) for k in QUESTION_KEYS],
            *[F.when(~ok, F.lit(k)) for k, ok in checks.items()])
        typed = F.struct(
            at("decision_category")["choice"].alias("category"),
            at("decision_category")["confidence"].alias("category_confidence"),
            at("decision_category")["probabilities"].alias("category_probabilities"),
            at("owner_group")["choice"].alias("owner"),
            at("owner_group")["confidence"].alias("owner_confidence"),
            _level(at("urgency"), URGENCY_LEVELS).alias("urgency"),
            _level(at("risk_without_evidence"), RISK_LEVELS).alias("risk"),
            at("primary_missing_evidence")["choice"].alias("primary_missing"),
            at("evidence_sufficient")["noul"].alias("evidence_sufficient"),
            at("needs_human_review")["noul"].alias("needs_human_review"),
            at("change_material")["noul"].alias("change_material"),
        )
        return F.struct(first_bad.alias("bad"), typed.alias("typed"))

    # Parsed in a step that filters on the result cannot pass, so none repeats the parse; judging is compiled, column by column.
    return (
        calls.select("*", F.explode_outer(F.array(F.from_json(column, ANSWER_TYPE))).alias("_p"))
        .withColumn("_j", judge(F.col("_p")))
        .withColumn("invalid_question", F.col("_j.bad"))
        .withColumn("valid", F.col("invalid_question").isNull())
        .withColumn("answer", F.when(F.col("_j.bad").isNull(), F.col("_j.typed"))).drop("_j", "_p")
    )


def latest_answers(calls: DataFrame) -> DataFrame:
    """Latest succeeded answer per tenant, packet, question set, provider and model."""
    # max_by folds each key map-side; a packet that was asked about very often is never sorted whole.
    key = ["tenant_id", "packet_sha256", "question_set_version", "provider", "model_requested"]
    return (
        calls.where((F.col("status") == "succeeded"))
        .groupBy(*key).agg(F.max_by("answers", F.struct("created_at", "answers")).alias("answers"),
                           F.max("created_at").alias("created_at"))
        .where(F.col("answers").isNotNull())
    )


def one_per_packet(valid: DataFrame, question_set: str | None = None, provider: str | None = None, model: str | None = None) -> DataFrame:
    """The answer a packet may use: of the wanted question set, provider and model (None: any), the latest. A packet
    asked of several models has one answer here, so a join with it cannot multiply findings."""
    wanted = {"question_set_version": question_set, "provider": provider, "model_requested": model}
    for name, value in wanted.items():
        if value is not None:
            valid = valid.where(F.col(name) == value)
    newest = F.struct("created_at", *wanted)  # ties go to the largest names
    return valid.groupBy("tenant_id", "packet_sha256").agg(F.max_by("answer", newest).alias("answer"))


# ---- fixed values: keywords that hint at an owner, first match wins --------------------------------
OWNER_HINTS = [
    ("sagemaker|bedrock|gpu", "ml_ai"),
    ("redshift|athena|glue|emr|kinesis", "data"),
    ("guardduty|waf|kms|security", "security"),
    ("tax|support|marketplace", "finance"),
    ("lambda|api gateway|sqs|sns", "application_engineering"),
    ("compute|container|rds|relational|storage|cloudwatch|vpc", "platform_infrastructure"),
]


def rule_answers(findings: DataFrame, label: str = "safe_label") -> DataFrame:
    """Deterministic stand-in answers from keywords, kind and share of the month."""
    text = F.lower(label)
    owner = F.lit("unknown")
    for words, group in reversed(OWNER_HINTS):
        owner = F.when(text.rlike(words), group).otherwise(owner)
    kind, part = F.col("kind"), F.col("share_of_current")
    return findings.select(
        "*",
        F.struct(
            F.when(kind.isin("new_service", "unallocated_spend"), "REQUEST_EVIDENCE").otherwise("INVESTIGATE").alias("category"),
            F.lit(0.9).alias("category_confidence"),
            owner.alias("owner"),
            F.when(owner != "unknown", F.lit(0.8)).otherwise(F.lit(0.6)).alias("owner_confidence"),
            F.when(part >= F.lit("0.1").cast("decimal(3,1)"), "high").otherwise("medium").alias("urgency"),
            F.lit("medium").alias("risk"),
            F.when(kind == "unallocated_spend", "allocation_tags").when(kind == "new_service", "owner_confirmation")
            .otherwise("utilization_metrics").alias("primary_missing"),
            F.lit(0.2).alias("evidence_sufficient"), F.lit(0.3).alias("needs_human_review"),
            F.when(part >= F.lit("0.05").cast("decimal(4,2)"), F.lit(0.9)).otherwise(F.lit(0.3)).alias("change_material"),
        ).alias("answer"))


def answer_json(answer: Column) -> Column:
    """The typed answer in its stored form."""
    def choice(value: Column, confidence: Column) -> Column:
        return F.struct(F.lit("choice").alias("type"), value.alias("choice"), confidence.alias("confidence"),
                        F.create_map(value, confidence).alias("probabilities"))

    def score(level: Column, levels: list[str]) -> Column:
        n = (F.array_position(_lits(levels), level) - 1).cast("int")
        return F.struct(F.lit("score").alias("type"), n.cast("double").alias("score"), F.lit(0.8).alias("confidence"),
                        F.create_map(n.cast("string"), F.lit(0.8)).alias("probabilities"))

    def yes(p: Column) -> Column:
        return F.struct(F.lit("noul").alias("type"), p.alias("noul"))

    return F.to_json(F.struct(
        choice(answer["category"], answer["category_confidence"]).alias("decision_category"),
        choice(answer["owner"], answer["owner_confidence"]).alias("owner_group"),
        score(answer["urgency"], URGENCY_LEVELS).alias("urgency"),
        score(answer["risk"], RISK_LEVELS).alias("risk_without_evidence"),
        choice(answer["primary_missing"], F.lit(0.85)).alias("primary_missing_evidence"),
        yes(answer["evidence_sufficient"]).alias("evidence_sufficient"),
        yes(answer["needs_human_review"]).alias("needs_human_review"),
        yes(answer["change_material"]).alias("change_material")))


def answer_availability(consent_basis: Column, enabled: Column, configured: Column,
                        pending: str = "pending", granted: str = "granted") -> Column:
    """Why no answer may be used for a run, or NULL when one may. Permission is checked first."""
    return (
        F.when(F.coalesce(consent_basis == pending, F.lit(False)), "awaiting_unlock")
        .when(~F.coalesce(consent_basis == granted, F.lit(False)), "no_consent")
        .when(~enabled, "disabled")
        .when(~configured, "not_configured")
    )
