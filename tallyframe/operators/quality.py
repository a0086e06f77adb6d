"""File-level facts after judging: currency consensus, profile, data-quality issues, fatal files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.operators.records import WIDE, wide_cells
from tallyframe.schema import KEYS
from tallyframe.sources.exports import FATAL_MESSAGES

# ---- fixed values: issue messages -----------------------------------------------------------------------
MESSAGES = {
    "date_format_assumed": "Dates like 07/08/2026 were read as month/day/year (the AWS default). Check the detected period.",
    "totals_do_not_reconcile": ("The file's own total row or column does not match the sum of its values. "
                                "Rows may have been edited or removed."),
    "conflicting_duplicate_periods": "The same period appears more than once with different values; both were kept.",
    "conflicting_duplicate_keys": ("Some date and dimension combinations appear more than once with different costs; "
                                   "all were kept and summed."),
    "mixed_currencies": ("The file mixes currencies. Totals across currencies are not meaningful; export one currency."),
    "rows_rejected": "Some rows or values could not be read and were excluded (never counted as zero).",
    "duplicate_rows": "Exact duplicate rows were found and counted once.",
    "decimal_comma": "Semicolon-separated file: commas were read as decimal separators.",
    "credits_present": "Credits or refunds (negative amounts) are included in the totals.",
}
CURRENCY_UNKNOWN_WIDE = "No currency marker such as ($) was found in the headers; amounts are unlabeled."
CURRENCY_UNKNOWN_LONG = "No currency column or marker was found; amounts are unlabeled."


def file_facts(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("kind") == "file").select(
        *KEYS, "path", "had_bom", "delimiter", "layout", "primary_dimension", "dimension_label", "dimensions_available",
        "date_assumed", "fatal_code", "fatal_message", "header_currencies")


def currency_consensus(records: DataFrame, facts: DataFrame) -> DataFrame:
    """One currency, several (an error, analysis goes on) or none."""
    # Distinct currencies are few; collect_set keeps the set, not the rows.
    used = records.where(F.col("col").isNull() & (F.coalesce("currency", F.lit("")) != "")).groupBy(*KEYS).agg(
        F.collect_set("currency").alias("_used"))
    none = F.array().cast("array<string>")
    found = F.array_sort(F.array_distinct(F.when(F.col("layout") == WIDE, F.coalesce("header_currencies", none))
                                          .otherwise(F.coalesce("_used", none))))
    return facts.where(F.col("fatal_code").isNull()).join(used, KEYS, "left").select(
        *KEYS, found.alias("currencies"), F.when(F.size(found) == 1, F.get(found, F.lit(0))).alias("currency"))


def line_counts(rows: DataFrame, rejected: DataFrame) -> DataFrame:
    """Seen, accepted, rejected and duplicate lines, rejected and empty cells."""
    lines = rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("lines_seen"), F.count_if(F.col("reject_reason").isNull()).alias("lines_accepted"),
        F.count_if(F.col("reject_reason").isNotNull()).alias("lines_rejected"),
        F.count_if(F.col("reject_reason") == "duplicate_row").alias("duplicate_lines"))
    cells = rejected.groupBy(*KEYS).agg(F.sum("cells").alias("cells_rejected"))
    empty = wide_cells(rows).groupBy(*KEYS).agg(F.count_if(F.col("status") == "empty").alias("empty_cells"))
    zero = F.lit(0).cast("bigint")
    return lines.join(cells, KEYS, "left").join(empty, KEYS, "left").withColumn(
        "cells_rejected", F.coalesce("cells_rejected", zero)).withColumn("empty_cells", F.coalesce("empty_cells", zero))


def export_profile(facts: DataFrame, counts: DataFrame, records: DataFrame, currency: DataFrame) -> DataFrame:
    """One row per export with at least one record."""
    totals = records.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("records"), F.sum("cost").alias("total_cost"),
        F.count_if(F.col("cost") < 0).alias("credits"),
        F.bool_or(F.col("cost") != F.floor("cost")).alias("fractional"))
    return (
        facts.where(F.col("fatal_code").isNull()).drop("fatal_code", "fatal_message", "header_currencies")
        .join(totals, KEYS).join(counts, KEYS).join(currency, KEYS)
    )


def _issue(code: str, severity: str, when: Column, count: Column | None = None, detail: Column | None = None,
           message: Column | None = None) -> Column:
    return F.when(F.coalesce(when, F.lit(False)), F.struct(
        F.lit(code).alias("code"), F.lit(severity).alias("severity"),
        (F.lit(MESSAGES[code]) if message is None else message).alias("message"),
        (F.lit(None) if count is None else count).cast("bigint").alias("count"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail")))


def quality_issues(profile: DataFrame, rejected: DataFrame, conflicts_long: DataFrame, conflicts_wide: DataFrame,
                   unreconciled: DataFrame) -> DataFrame:
    """Data-quality issues, one row per export and code."""
    reasons = rejected.groupBy(*KEYS, "reason").agg(F.count(F.lit(1)).alias("n")).groupBy(*KEYS).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("_reasons"))
    named = lambda df, name: df.select(*KEYS, F.col("count").alias(name))
    state = (
        profile.join(reasons, KEYS, "left").join(named(conflicts_long, "_keys"), KEYS, "left")
        .join(named(conflicts_wide, "_periods"), KEYS, "left").join(named(unreconciled, "_totals"), KEYS, "left")
    )
    bad = F.col("lines_rejected") + F.col("cells_rejected")
    unknown = F.when(F.col("layout") == WIDE, CURRENCY_UNKNOWN_WIDE).otherwise(CURRENCY_UNKNOWN_LONG)
    issues = F.array_compact(F.array(
        _issue("date_format_assumed", "warning", F.col("date_assumed")),
        _issue("totals_do_not_reconcile", "warning", F.col("_totals") > 0, F.col("_totals")),
        _issue("conflicting_duplicate_periods", "warning", F.col("_periods") > 0, F.col("_periods")),
        _issue("conflicting_duplicate_keys", "warning", F.col("_keys") > 0, F.col("_keys")),
        _issue("currency_unknown", "warning", F.size("currencies") == 0, message=unknown),
        _issue("mixed_currencies", "error", F.size("currencies") > 1,
               detail=F.to_json(F.struct(F.col("currencies").alias("currencies")))),
        _issue("rows_rejected", "warning", bad > 0, bad, F.to_json(F.struct(F.col("_reasons").alias("by_reason")))),
        _issue("duplicate_rows", "warning", F.col("duplicate_lines") > 0, F.col("duplicate_lines")),
        _issue("decimal_comma", "info", (F.col("delimiter") == ";") & F.col("fractional")),
        _issue("credits_present", "info", F.col("credits") > 0, F.col("credits")),
    ))
    return state.select(*KEYS, F.inline(issues))


def fatal_issues(facts: DataFrame, profile: DataFrame) -> DataFrame:
    """One error per export that cannot be analysed; such a file never fails the batch."""
    unusable = facts.where(F.col("fatal_code").isNotNull()).select(
        *KEYS, F.col("fatal_code").alias("code"), F.col("fatal_message").alias("message"))
    empty = facts.where(F.col("fatal_code").isNull()).join(profile, KEYS, "left_anti").select(
        *KEYS, F.lit("no_valid_rows").alias("code"), F.lit(FATAL_MESSAGES["no_valid_rows"]).alias("message"))
    return unusable.unionByName(empty).select(
        *KEYS, "code", F.lit("error").alias("severity"), "message", F.lit(None).cast("bigint").alias("count"),
        F.lit(None).cast("string").alias("detail"))
