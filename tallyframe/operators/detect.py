"""Materiality thresholds, period-over-period changes and ranked findings.

Inputs are the small aggregated tables (series, coverage, focus, profile); no step reads records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import cents, ratio, share
from tallyframe.operators.monthly import covered_spend
from tallyframe.schema import (
    ESCALATE_SHARE, HIGH_SEVERITY_MULTIPLE, KEYS, LARGEST_CHANGES, MATERIAL_ABS_FLOOR, MATERIAL_ABS_SHARE,
    MATERIAL_RELATIVE, MAX_FINDINGS, NEW_SERVICE_SHARE, RELATIVE_MIN_SHARE_OF_ABS, UNALLOCATED_SHARE,
)

ZERO = "cast(0 as decimal(38,15))"


def thresholds(focus: DataFrame) -> DataFrame:
    """One row per export: the amounts a movement is tested against."""
    spend = covered_spend(focus).join(focus.select(*KEYS, "current_total"), KEYS)
    absolute = F.greatest(F.lit(MATERIAL_ABS_FLOOR).cast("decimal(28,2)"),
                          cents(F.col("covered_monthly_spend") * F.lit(MATERIAL_ABS_SHARE)))
    return spend.withColumn("material_absolute", absolute).select(
        *KEYS, "covered_monthly_spend", "material_absolute",
        F.lit(MATERIAL_RELATIVE).alias("material_relative"),
        cents(F.col("material_absolute") * F.lit(RELATIVE_MIN_SHARE_OF_ABS)).alias("relative_min_delta"),
        cents(F.col("current_total").cast("decimal(28,6)") * F.lit(NEW_SERVICE_SHARE)).alias("new_service_min"),
        F.lit(UNALLOCATED_SHARE).alias("unallocated_share"),
    )


def movements(series: DataFrame, focus: DataFrame) -> DataFrame:
    """Every (dimension, label) of every export in one aggregate: both sides of the comparison, whether
    it was ever charged before the current month, and whether any flagged record carried it."""
    months = focus.select(*KEYS, "has_pair", "baseline_month", "current_month")
    month, cost = F.col("month"), F.col("cost")
    sums = series.join(months, KEYS).groupBy(*KEYS, "dimension", "label").agg(
        F.coalesce(F.sum(F.when(month == F.col("baseline_month"), cost)), F.expr(ZERO)).alias("baseline"),
        F.coalesce(F.sum(F.when(month == F.col("current_month"), cost)), F.expr(ZERO)).alias("current"),
        F.bool_or((month < F.col("current_month")) & (cost != 0)).alias("had_history"),
        F.bool_or("unallocated").alias("unallocated"),
        F.first("has_pair").alias("has_pair"),
        F.first("baseline_month").alias("baseline_month"),
        F.first("current_month").alias("current_month"),
    )
    delta = F.col("current") - F.col("baseline")
    return sums.withColumn("delta", delta).withColumn("delta_pct", ratio(F.col("delta"), F.col("baseline")))


def changes(moves: DataFrame) -> DataFrame:
    """Period-over-period change per key; a month without the key counts as zero."""
    return moves.where("has_pair").select(
        *KEYS, "dimension", "label", "baseline_month", "current_month", "baseline", "current", "delta", "delta_pct")


def largest_changes(moves: DataFrame, n: int = LARGEST_CHANGES) -> DataFrame:
    """Top `n` increases per dimension."""
    order = Window.partitionBy(*KEYS, "dimension").orderBy(F.desc("delta"), "label")
    return (
        changes(moves).where(F.col("delta") > 0)
        .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    )


def severity(amount: Column, absolute: Column) -> Column:
    return (F.when(amount >= absolute * HIGH_SEVERITY_MULTIPLE, "high")
            .when(amount >= absolute, "medium").otherwise("low"))


def finding_key(kind: Column, dimension: Column, label: Column) -> Column:
    """What a finding is about, independent of file and month; carries no label text."""
    return F.concat_ws("_", kind, dimension, F.substring(F.sha2(label, 256), 1, 8))


def evidence_id(export_id: Column, key: Column, month: Column) -> Column:
    return F.concat_ws("_", F.lit("ev"), F.substring(export_id, 1, 12), key, F.date_format(month, "yyyyMM"))


FINDING_COLUMNS = [
    *KEYS, "kind", "dimension", "label", "current_month", "baseline_month", "current", "baseline", "delta",
    "delta_pct", "share_of_current", "current_total", "material_absolute", "material_relative", "severity",
    "default_category",
]


def increases(moves: DataFrame, limits: DataFrame, focus: DataFrame, profile: DataFrame) -> DataFrame:
    """Material increases and new services of the primary dimension."""
    t = limits.select(*KEYS, F.col("material_absolute").alias("_abs"), F.col("material_relative").alias("_rel"),
                      "relative_min_delta", "new_service_min")
    primary = profile.select(*KEYS, F.col("primary_dimension").alias("dimension"))
    rows = (
        moves.where(F.col("has_pair") & (F.col("delta") > 0) & ~F.col("unallocated"))
        .join(primary, [*KEYS, "dimension"]).join(t, KEYS).join(focus.select(*KEYS, "current_total"), KEYS)
    )
    delta = F.col("delta")
    absolute = delta >= F.col("_abs")
    relative = F.coalesce((F.col("delta_pct") >= F.col("_rel")) & (delta >= F.col("relative_min_delta")), F.lit(False))
    is_new = (F.col("dimension") == "service") & ~F.col("had_history")
    big = (delta >= F.col("_abs") * HIGH_SEVERITY_MULTIPLE) & (share(delta, F.col("current_total")) >= F.lit(ESCALATE_SHARE))
    return (
        rows.withColumn("material_absolute", absolute).withColumn("material_relative", relative)
        .withColumn("_new", is_new)
        .where(F.when(F.col("_new"), F.col("material_absolute") | (F.col("current") >= F.col("new_service_min")))
               .otherwise(F.col("material_absolute") | F.col("material_relative")))
        .withColumn("kind", F.when(F.col("_new"), "new_service").otherwise("material_increase"))
        .withColumn("default_category", F.when(F.col("_new"), "REQUEST_EVIDENCE").when(big, "ESCALATE")
                    .when(F.col("material_absolute"), "INVESTIGATE").otherwise("MONITOR"))
        .withColumn("severity", severity(delta, F.col("_abs")))
        .withColumn("share_of_current", share(F.col("current"), F.col("current_total")))
        .select(*FINDING_COLUMNS)
    )


def unallocated_state(moves: DataFrame, coverage: DataFrame, focus: DataFrame) -> DataFrame:
    """One row per export that has any unallocated key: amount and share of the current month."""
    keys = moves.where("unallocated").groupBy(*KEYS).agg(
        F.when(F.min("dimension") == F.max("dimension"), F.min("dimension")).otherwise("mixed").alias("dimension"))
    months = focus.select(*KEYS, "has_pair", "baseline_month", "current_month", "current_total")
    month = F.col("month")
    amounts = coverage.join(months, KEYS).groupBy(*KEYS).agg(
        F.coalesce(F.sum(F.when(month == F.col("current_month"), F.col("unallocated_total"))), F.expr(ZERO)).alias("current"),
        F.when(F.first("has_pair"),
               F.coalesce(F.sum(F.when(month == F.col("baseline_month"), F.col("unallocated_total"))), F.expr(ZERO)))
        .alias("baseline"),
        F.first("baseline_month").alias("baseline_month"), F.first("current_month").alias("current_month"),
        F.first("current_total").alias("current_total"),
    )
    return keys.join(amounts, KEYS).withColumn("share", share(F.col("current"), F.col("current_total")))


def unallocated_finding(state: DataFrame, limits: DataFrame) -> DataFrame:
    """At most one finding per export, also where nothing can be compared."""
    t = limits.select(*KEYS, F.col("material_absolute").alias("_abs"), F.col("unallocated_share").alias("_min"))
    delta = F.coalesce(F.col("current") - F.col("baseline"), F.expr(ZERO))
    return (
        state.join(t, KEYS).where(F.col("share") >= F.col("_min"))
        .withColumn("kind", F.lit("unallocated_spend")).withColumn("label", F.lit("unallocated"))
        .withColumn("delta", delta).withColumn("delta_pct", ratio(F.col("delta"), F.col("baseline")))
        .withColumn("share_of_current", F.col("share"))
        .withColumn("material_absolute", F.col("current") >= F.col("_abs"))
        .withColumn("material_relative", F.lit(False))
        .withColumn("severity", severity(F.col("current"), F.col("_abs")))
        .withColumn("default_category", F.lit("REQUEST_EVIDENCE"))
        .select(*FINDING_COLUMNS)
    )


def rank_findings(candidates: DataFrame, n: int = MAX_FINDINGS) -> DataFrame:
    """Identify, order (absolute-material first, then size) and keep the first `n` per export."""
    named = candidates.withColumn("finding_key", finding_key(F.col("kind"), F.col("dimension"), F.col("label")))
    named = named.withColumn("evidence_id", evidence_id(F.col("export_id"), F.col("finding_key"), F.col("current_month")))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("material_absolute"), F.desc("delta"), "evidence_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)


def detect(moves: DataFrame, coverage: DataFrame, focus: DataFrame, profile: DataFrame) -> DataFrame:
    """Ranked findings of every export."""
    limits = thresholds(focus)
    found = increases(moves, limits, focus, profile).unionByName(
        unallocated_finding(unallocated_state(moves, coverage, focus), limits))
    return rank_findings(found)
