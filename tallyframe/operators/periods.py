"""Granularity, month coverage, the comparison pair and the covered period.

Everything here works from `day_totals`, one row per (export, date). It is the only step that reads
records; its partial aggregation runs before the shuffle, so a dominant export costs no more than
its number of distinct dates.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.schema import KEYS


def day_totals(records: DataFrame) -> DataFrame:
    """One row per (export, date): sums, counts and how far the date's rows say they reach."""
    reach = (F.max(F.when(F.col("period_end") >= F.col("period_start"), F.col("period_end")))
             if "period_end" in records.columns else F.lit(None).cast("date"))
    partial = (F.bool_or(F.coalesce("partial", F.lit(False)))
               if "partial" in records.columns else F.lit(False))
    return records.groupBy(*KEYS, "month", "period_start").agg(
        F.sum("cost").alias("cost"),
        F.sum(F.when(F.col("unallocated"), F.col("cost"))).alias("unallocated_cost"),
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("cost") < 0).alias("credits"),
        reach.alias("reach"),
        partial.alias("partial"),
    )


def _day(value: date | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(value).cast("date")


def month_coverage(days: DataFrame, today: date | Column) -> DataFrame:
    """One row per (export, month): totals, the file's granularity, and whether the month is complete.

    monthly: one date in every month; daily: consecutive dates; irregular otherwise. All three steps
    (gap to the previous date, fold to months, spread per export) share the partitioning by export
    of an already tiny table. `today` may be a column of `days`, one report date per export.
    """
    dates = Window.partitionBy(*KEYS).orderBy("period_start")
    whole = Window.partitionBy(*KEYS)
    months = (
        days.withColumn("_now", _day(today))
        .withColumn("_gap", F.datediff("period_start", F.lag("period_start").over(dates)))
        .groupBy(*KEYS, "month").agg(
            F.sum("cost").alias("total"),
            F.sum("unallocated_cost").alias("unallocated_total"),
            F.sum("records").alias("records"),
            F.sum("credits").alias("credits"),
            F.count(F.lit(1)).alias("days"),
            F.min("period_start").alias("first_day"),
            F.max("period_start").alias("last_day_seen"),
            F.max("reach").alias("reach"),
            F.bool_or("partial").alias("partial"),
            F.bool_and(F.coalesce(F.col("_gap") == 1, F.lit(True))).alias("_consecutive"),
            F.max("_now").alias("_now"),
        )
    )
    graded = months.withColumn(
        "granularity",
        F.when(F.max("days").over(whole) == 1, "monthly")
        .when(F.bool_and("_consecutive").over(whole), "daily").otherwise("irregular"),
    )
    reason = (
        F.when(F.col("month") >= F.trunc("_now", "month"), "month_to_date")
        .when((F.col("granularity") == "monthly") & (F.dayofmonth("first_day") != 1), "starts_mid_month")
        .when((F.col("granularity") != "monthly") & (F.col("days") < F.dayofmonth(F.last_day("month"))), "missing_days")
        .when(F.col("partial") | F.coalesce(F.col("reach") < F.last_day("month"), F.lit(False)), "ends_mid_month")
    )
    return (
        graded.withColumn("reason", reason).withColumn("complete", F.col("reason").isNull())
        .drop("_now", "_consecutive")
    )


def granularity(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy(*KEYS).agg(F.first("granularity").alias("granularity"))


def focus(coverage: DataFrame) -> DataFrame:
    """One row per export: the compared pair if any, and the month the report is about.

    Adjacent calendar months that are both complete are adjacent among the complete ones too, so one
    `lag` over the months (a bounded list per export) finds every candidate pair.
    """
    ordered = Window.partitionBy(*KEYS).orderBy("month")
    seen = coverage.select(
        *KEYS, "month", "complete", "total",
        F.lag("month").over(ordered).alias("_prev"),
        F.lag("complete").over(ordered).alias("_prev_complete"),
        F.lag("total").over(ordered).alias("_prev_total"),
    )
    pairs = F.col("complete") & F.col("_prev_complete") & (F.add_months("_prev", 1) == F.col("month"))
    complete = F.col("complete")
    agg = seen.groupBy(*KEYS).agg(
        F.max(F.when(pairs, F.struct("month", F.col("_prev").alias("baseline"), "total",
                                     F.col("_prev_total").alias("baseline_total")))).alias("_pair"),
        F.max(F.when(complete, F.struct("month", "total"))).alias("_last_complete"),
        F.max(F.struct("month", "total")).alias("_last"),
        F.count_if(complete).alias("complete_months"),
        F.count(F.lit(1)).alias("months"),
        F.sum(F.when(complete, F.col("total"))).alias("_complete_total"),
        F.sum("total").alias("_all_total"),
    )
    current = F.coalesce("_pair.month", "_last_complete.month", "_last.month")
    return agg.select(
        *KEYS,
        F.col("_pair").isNotNull().alias("has_pair"),
        F.col("_pair.baseline").alias("baseline_month"),
        current.alias("current_month"),
        F.col("_pair.baseline_total").alias("baseline_total"),
        F.coalesce("_pair.total", "_last_complete.total", "_last.total").alias("current_total"),
        "complete_months", "months",
        # Spend the averages and shares refer to: complete months, or all when none is complete.
        F.when(F.col("complete_months") > 0, F.col("_complete_total")).otherwise(F.col("_all_total"))
        .alias("covered_total"),
        F.when(F.col("complete_months") > 0, F.col("complete_months")).otherwise(F.col("months"))
        .alias("covered_months"),
    )


def comparison_pair(coverage: DataFrame) -> DataFrame:
    """Latest two consecutive complete months; exports without one are absent (they abstain)."""
    return focus(coverage).where("has_pair").select(
        *KEYS, "baseline_month", "current_month", "baseline_total", "current_total")


def covered_period(coverage: DataFrame) -> DataFrame:
    """First and last day covered: the last date, or its month end for monthly data."""
    last = F.max("last_day_seen")
    return coverage.groupBy(*KEYS).agg(
        F.first("granularity").alias("granularity"),
        F.min("first_day").alias("period_start"),
        F.when(F.first("granularity") == "monthly", F.last_day(last)).otherwise(last).alias("period_end"),
    )


# ---- fixed values: issue messages ---------------------------------------------------------------
PARTIAL_MESSAGE = ("Some months are incomplete, so month-over-month changes involving them are not like-for-like.")
INSUFFICIENT_MESSAGE = (
    "Fewer than two complete months are covered, so period-over-period changes cannot be calculated. "
    "Export at least two full months.")
IRREGULAR_MESSAGE = "Dates are neither monthly nor consecutive days; periods were grouped by month."


def period_issues(coverage: DataFrame) -> DataFrame:
    """partial_period, insufficient_periods and irregular_dates, one row per export and code."""
    incomplete = ~F.col("complete")
    per_export = coverage.groupBy(*KEYS).agg(
        F.count_if(incomplete).alias("_partial"),
        F.count_if("complete").alias("_complete"),
        F.first("granularity").alias("granularity"),
        F.array_sort(F.collect_list(F.when(
            incomplete, F.concat_ws(":", F.date_format("month", "yyyy-MM"), "reason")))).alias("_months"),
    )

    def issue(code: str, message: str, when: Column, count: Column, detail: Column) -> Column:
        return F.when(when, F.struct(
            F.lit(code).alias("code"), F.lit("warning").alias("severity"), F.lit(message).alias("message"),
            count.cast("bigint").alias("count"), detail.cast("string").alias("detail")))

    nothing = F.lit(None)
    issues = F.array_compact(F.array(
        issue("partial_period", PARTIAL_MESSAGE, F.col("_partial") > 0, F.col("_partial"),
              F.to_json(F.struct(F.col("_months").alias("months")))),
        issue("insufficient_periods", INSUFFICIENT_MESSAGE, F.col("_complete") < 2, nothing, nothing),
        issue("irregular_dates", IRREGULAR_MESSAGE, F.col("granularity") == "irregular", nothing, nothing),
    ))
    return per_export.select(*KEYS, F.inline(issues))
