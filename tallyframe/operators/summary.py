"""One nested summary row per export, the investigation impact and the abstention status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.numeric import month_text, plain, ratio, share_text
from tallyframe.operators.readiness import COMPONENTS
from tallyframe.schema import KEYS, OWNERSHIP_DIMENSIONS

# ---- fixed values: data-gap and abstention messages ------------------------------------------------
NO_BREAKDOWN = ("No account or region breakdown in this export; changes are shown by ", " only.")
BILLING_ONLY = "Billing data only: utilization, ownership and environment are not visible."
NO_OWNERSHIP = "No team tag or account grouping, so owners cannot be inferred from billing data."
NO_COMPARISON = "At least two consecutive complete months are needed to compare periods."
ABSTAIN = ("At least two consecutive complete months are needed to compare periods. Export a longer range "
           "(for example, the last three full months) and upload it again.")


def investigation_impact(findings: DataFrame, focus: DataFrame, profile: DataFrame) -> DataFrame:
    """Increase explained by material findings of the primary dimension, never above the bill's own rise."""
    counted = (
        findings.join(profile.select(*KEYS, "primary_dimension"), KEYS)
        .where((F.col("material_absolute") | F.col("material_relative")) & (F.col("delta") > 0)
               & (F.col("dimension") == F.col("primary_dimension")))
        .groupBy(*KEYS).agg(F.sum("delta").alias("_rise"))
    )
    bill = F.when(F.col("has_pair"), F.col("current_total") - F.col("baseline_total"))
    rise = F.coalesce("_rise", F.lit(0).cast("decimal(38,15)"))
    return focus.join(counted, KEYS, "left").select(
        *KEYS, F.when(F.coalesce(bill > 0, F.lit(False)), F.least(rise, bill)).otherwise(rise).alias("investigation_impact"))


def run_status(focus: DataFrame) -> DataFrame:
    """completed, or insufficient_data with its issue where nothing can be compared."""
    abstained = ~F.col("has_pair")
    return focus.select(
        *KEYS, F.when(abstained, "insufficient_data").otherwise("completed").alias("status"),
        F.when(abstained, F.struct(
            F.lit("no_comparison").alias("code"), F.lit("error").alias("severity"), F.lit("analyze").alias("stage"),
            F.lit(ABSTAIN).alias("message"))).alias("issue"))


def run_summary(profile: DataFrame, period: DataFrame, coverage: DataFrame, focus: DataFrame, thresholds: DataFrame,
                top: DataFrame, largest: DataFrame, unallocated: DataFrame, readiness: DataFrame,
                impact: DataFrame) -> DataFrame:
    """Joins per-export aggregates into `summary` (nested). Every list in it is bounded per export."""
    months = coverage.groupBy(*KEYS).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("month", "total", "complete"))),
        lambda m: F.struct(month_text(m["month"]).alias("month"), plain(m["total"]).alias("total"),
                           m["complete"].alias("complete"))).alias("months_list"))
    items = top.join(focus.select(*KEYS, "covered_total"), KEYS).groupBy(*KEYS).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", "label", plain(F.col("cost")).alias("cost"),
                                             share_text(F.col("share"), F.col("covered_total")).alias("share")))),
        lambda t: F.struct(t["label"].alias("label"), t["cost"].alias("cost"), t["share"].alias("share"))).alias("top_items"))
    rows = F.transform(
        F.array_sort(F.collect_list(F.struct(
            "rank", "label", plain(F.col("baseline")).alias("baseline"), plain(F.col("current")).alias("current"),
            plain(F.col("delta")).alias("delta"), F.col("delta_pct").cast("string").alias("delta_pct")))),
        lambda r: F.struct(r["label"].alias("label"), r["baseline"].alias("baseline"), r["current"].alias("current"),
                           r["delta"].alias("delta"), r["delta_pct"].alias("delta_pct")))
    per_dimension = largest.groupBy(*KEYS, "dimension").agg(rows.alias("rows"))
    # A compared export lists every dimension it has, also those without an increase.
    listed = (
        profile.join(focus.where("has_pair").select(*KEYS), KEYS)
        .select(*KEYS, F.explode("dimensions_available").alias("dimension"))
        .join(per_dimension, [*KEYS, "dimension"], "left")
    )
    empty_rows = F.array().cast("array<struct<label:string,baseline:string,current:string,delta:string,delta_pct:string>>")
    changes = listed.groupBy(*KEYS).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "dimension", F.coalesce("rows", empty_rows).alias("rows"))))).alias("largest_changes"))
    gap = lambda code, message, when: F.when(when, F.struct(F.lit(code).alias("code"), message.alias("message")))
    has = lambda values: F.arrays_overlap("dimensions_available", F.array(*map(F.lit, values)))
    gaps = F.array_compact(F.array(
        gap("billing_only", F.lit(BILLING_ONLY), F.lit(True)),
        gap("no_account_region", F.concat(
            F.lit(NO_BREAKDOWN[0]), F.lower("dimension_label"), F.lit(NO_BREAKDOWN[1])), ~has(["account", "region"])),
        gap("no_ownership_dimension", F.lit(NO_OWNERSHIP), ~has(OWNERSHIP_DIMENSIONS)),
        gap("no_comparison", F.lit(NO_COMPARISON), ~F.col("has_pair"))))
    delta = F.col("current_total") - F.col("baseline_total")
    comparison = F.when(F.col("has_pair"), F.struct(
        month_text(F.col("baseline_month")).alias("baseline_month"), month_text(F.col("current_month")).alias("current_month"),
        plain(F.col("baseline_total")).alias("baseline_total"), plain(F.col("current_total")).alias("current_total"),
        plain(delta).alias("delta"), ratio(delta, F.col("baseline_total")).cast("string").alias("delta_pct")))
    joined = (
        profile.select(*KEYS, "currency", "primary_dimension", "dimension_label", "dimensions_available", "total_cost")
        .join(period, KEYS).join(focus, KEYS).join(thresholds, KEYS)
        .join(readiness.withColumnRenamed("currency", "_currency_points"), KEYS)
        .join(impact, KEYS).join(months, KEYS)
        .join(items, KEYS, "left").join(changes, KEYS, "left")
        .join(unallocated.select(*KEYS, F.col("current").alias("_amount"), F.col("share").alias("_share")), KEYS, "left")
    )
    summary = F.struct(
        F.lit(1).alias("version"),
        plain(F.col("investigation_impact")).alias("investigation_impact"),
        F.struct(F.col("period_start").cast("string").alias("start"), F.col("period_end").cast("string").alias("end")).alias("period"),
        F.col("granularity"), F.col("currency"), F.col("primary_dimension").alias("dimension"), F.col("dimension_label"),
        F.col("dimensions_available"), plain(F.col("total_cost")).alias("total"), F.col("months_list").alias("months"),
        comparison.alias("comparison"), F.col("top_items"), F.col("largest_changes"),
        F.when(F.col("_amount").isNotNull(), F.struct(
            plain(F.col("_amount")).alias("amount"), share_text(F.col("_share"), F.col("current_total")).alias("share"))).alias("unallocated"),
        gaps.alias("data_gaps"),
        F.struct(F.col("score"), F.struct(*[F.col("_currency_points").alias(c) if c == "currency" else F.col(c) for c in COMPONENTS]).alias("components"), F.lit(True).alias("provisional")).alias("readiness"),
        F.struct(F.lit(True).alias("provisional"), plain(F.col("covered_monthly_spend")).alias("covered_monthly_spend"),
                 plain(F.col("material_absolute")).alias("material_absolute"),
                 F.col("material_relative").cast("decimal(4,2)").cast("string").alias("material_relative"),
                 plain(F.col("new_service_min")).alias("new_service_min"),
                 F.col("unallocated_share").cast("decimal(4,2)").cast("string").alias("unallocated_share")).alias("thresholds"))
    return joined.select(*KEYS, summary.alias("summary"))
