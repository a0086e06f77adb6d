"""Monthly totals and series, unallocated keys, source references, top items, history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import cents, share
from tallyframe.schema import DIMENSIONS, HISTORY_MONTHS, KEYS, MAX_REFS, TOP_ITEMS


def dimensions_of(records: DataFrame) -> list[str]:
    return [d for d in DIMENSIONS if d in records.columns]


def long_form(records: DataFrame, keep: list[str], dims: list[str] | None = None) -> DataFrame:
    """One row per (record, dimension it carries). `unpivot` plans as a code-generated Expand."""
    chosen = dims or dimensions_of(records)
    return (
        records.select(*keep, *chosen)
        .unpivot(keep, chosen, "dimension", "label")
        .where(F.col("label").isNotNull())
    )


def monthly_total(coverage: DataFrame) -> DataFrame:
    """Sum of cost per month, with the unallocated part (zero where nothing is flagged)."""
    return coverage.select(
        *KEYS, "month", "total",
        F.coalesce("unallocated_total", F.lit(0).cast("decimal(38,15)")).alias("unallocated_total"))


def monthly_series(records: DataFrame) -> DataFrame:
    """Cost per (dimension, label, month) in one pass; a record counts once in each dimension it has.

    Grouping keys are low-cardinality, so map-side partial aggregation absorbs the Expand and only
    the partial sums are shuffled.
    """
    return (
        long_form(records, [*KEYS, "month", "cost", "unallocated"])
        .groupBy(*KEYS, "dimension", "label", "month")
        .agg(F.sum("cost").alias("cost"), F.bool_or("unallocated").alias("unallocated"))
    )


def unallocated_keys(series: DataFrame) -> DataFrame:
    """Every (dimension, label) that any flagged record carries, in any month."""
    return (
        series.groupBy(*KEYS, "dimension", "label").agg(F.bool_or("unallocated").alias("_any"))
        .where("_any").drop("_any")
    )


def source_refs(records: DataFrame, keys: DataFrame, group: list[str], n: int = MAX_REFS) -> DataFrame:
    """First `n` distinct source positions, in file order, of the records behind each key.

    `keys` holds (tenant, export, dimension, label, month) plus the `group` columns that name the
    result rows; the month is an equi-join key, so other months never leave the map side of a
    broadcast join. The dense-rank limit is applied inside each map task before the shuffle
    (WindowGroupLimit), so a label that owns most rows never lands in one task whole.
    """
    cells = long_form(records, [*KEYS, "month", "line", "col"])
    hit = cells.join(keys, [*KEYS, "dimension", "label", "month"])
    position = Window.partitionBy(*group).orderBy("line", F.coalesce("col", F.lit(0)))
    return (
        hit.select(*group, "line", "col", F.dense_rank().over(position).alias("_n"))
        .where(F.col("_n") <= n)
        .groupBy(*group)
        .agg(F.array_sort(F.collect_set(F.struct("line", F.coalesce("col", F.lit(0)).alias("col")))).alias("refs"))
    )


def ref_text(ref):
    """L5:C7, or L5 where the whole line is the source."""
    return F.when(ref["col"] == 0, F.concat(F.lit("L"), ref["line"])).otherwise(
        F.concat(F.lit("L"), ref["line"], F.lit(":C"), ref["col"]))


def covered_spend(focus: DataFrame) -> DataFrame:
    """Mean monthly total over complete months (all months when none is), half-even cents."""
    mean = F.col("covered_total").try_cast("decimal(24,6)") / F.col("covered_months").cast("decimal(10,0)")
    return focus.select(*KEYS, cents(mean).alias("covered_monthly_spend"))


def top_items(series: DataFrame, coverage: DataFrame, focus: DataFrame, profile: DataFrame,
              n: int = TOP_ITEMS) -> DataFrame:
    """Largest labels of the primary dimension over the covered months, with their share."""
    counted = coverage.join(focus.select(*KEYS, "complete_months", "covered_total"), KEYS).where(
        F.col("complete") | (F.col("complete_months") == 0)).select(*KEYS, "month", "covered_total")
    primary = profile.select(*KEYS, F.col("primary_dimension").alias("dimension"))
    # A label without a charge in the covered months still ranks, at zero.
    costs = (
        series.join(primary, [*KEYS, "dimension"])
        .join(counted.withColumn("_in", F.lit(True)), [*KEYS, "month"], "left")
        .groupBy(*KEYS, "dimension", "label")
        .agg(F.coalesce(F.sum(F.when(F.col("_in"), F.col("cost"))), F.lit(0).cast("decimal(38,15)")).alias("cost"))
    )
    rank = Window.partitionBy(*KEYS).orderBy(F.desc("cost"), "label")
    return (
        costs.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= n)
        .join(focus.select(*KEYS, "covered_total"), KEYS)
        .select(*KEYS, "rank", "dimension", "label", "cost", share(F.col("cost"), F.col("covered_total")).alias("share"))
    )


def history(series: DataFrame, coverage: DataFrame, findings: DataFrame, n: int = HISTORY_MONTHS) -> DataFrame:
    """Up to `n` months of each finding ending at its current month, oldest first, zero where absent."""
    subjects = findings.select(*KEYS, "evidence_id", "kind", "dimension", "label", "current_month")
    latest = Window.partitionBy(*KEYS).orderBy(F.desc("month"))
    per_export = findings.groupBy(*KEYS).agg(F.max("current_month").alias("_until"))
    months = (
        monthly_total(coverage).join(per_export, KEYS).where(F.col("month") <= F.col("_until"))
        .withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n)
        .select(*KEYS, "month", "unallocated_total")
    )
    wanted = subjects.join(months, KEYS)
    costs = series.select(*KEYS, "dimension", "label", "month", F.col("cost").alias("_cost"))
    filled = wanted.join(costs, [*KEYS, "dimension", "label", "month"], "left").select(
        *KEYS, "evidence_id", "month",
        F.when(F.col("kind") == "unallocated_spend", F.col("unallocated_total"))
        .otherwise(F.coalesce("_cost", F.lit(0).cast("decimal(38,15)"))).alias("cost"))
    return filled.groupBy(*KEYS, "evidence_id").agg(
        F.array_sort(F.collect_list(F.struct("month", "cost"))).alias("history"))
