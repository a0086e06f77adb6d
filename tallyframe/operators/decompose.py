"""What a movement is made of: other groupings, and volume against price."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.numeric import ratio
from tallyframe.operators.monthly import dimensions_of, long_form
from tallyframe.schema import (
    COMPONENT_MIN_SHARE, KEYS, MAX_COMPONENTS, MAX_MISSING, NAMES_AN_OWNER, OWNER_KNOWN_SHARE, PRIMARY_ORDER, SHOWS_CAPACITY,
)

#: Pseudo-dimension under which the units of the same rows travel through the one aggregate.
UNIT = "~unit"


def primary_label(dims: list[str]) -> Column:
    """Label under the primary dimension. A dimension is NULL in all rows of an export or in none, so
    the first non-NULL one in priority order is it; no join with the export's profile is needed."""
    return F.coalesce(*[F.col(d) for d in PRIMARY_ORDER if d in dims])


def movement_cells(findings: DataFrame, records: DataFrame, profile: DataFrame,
                   stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """One pass over the rows behind each increase, by every grouping and by unit at once.

    Only findings that moved up on the primary dimension are decomposed. They are at most ten per export and `stored`
    before they meet the records, so that the planner broadcasts them when they are small; otherwise AQE shuffles and
    splits skew. Rows leave this step as partial sums per (finding, grouping, label).
    """
    sides = F.array(F.struct(F.col("baseline_month").alias("month"), F.lit(False).alias("is_current")),
                    F.struct(F.col("current_month").alias("month"), F.lit(True).alias("is_current")))
    subject = (
        findings.where(F.col("delta") > 0).join(profile.select(*KEYS, "primary_dimension"), KEYS)
        .where((F.col("dimension") == F.col("primary_dimension")) & F.col("baseline_month").isNotNull())
        .select(*KEYS, "evidence_id", F.col("dimension").alias("_dim"), F.col("label").alias("_label"),
                F.col("delta").alias("finding_delta"), F.inline(sides))
    )
    dims = dimensions_of(records)
    rows = (
        records.withColumn("_label", primary_label(dims)).join(stored(subject), [*KEYS, "_label", "month"])
        .withColumn(UNIT, F.coalesce("unit", F.lit("")))
        .withColumn("quantified", F.col("quantity").isNotNull() & (F.coalesce("unit", F.lit("")) != ""))
    )
    keep = [*KEYS, "evidence_id", "_dim", "finding_delta", "is_current", "cost", "quantity", "quantified"]
    now, cost, qty = F.col("is_current"), F.col("cost"), F.coalesce("quantity", F.lit(0).cast("decimal(38,15)"))
    zero = F.lit(0).cast("decimal(38,15)")
    return (
        long_form(rows, keep, [*dims, UNIT]).where(F.col("dimension") != F.col("_dim"))
        .groupBy(*KEYS, "evidence_id", "finding_delta", "dimension", "label")
        .agg(F.coalesce(F.sum(F.when(~now, cost)), zero).alias("cost_b"),
             F.coalesce(F.sum(F.when(now, cost)), zero).alias("cost_c"),
             # Without rows the sum is zero; a sum too large for its type is unknown.
             F.when(F.max(~now), F.try_sum(F.when(~now, qty))).otherwise(zero).alias("qty_b"),
             F.when(F.max(now), F.try_sum(F.when(now, qty))).otherwise(zero).alias("qty_c"),
             F.bool_and("quantified").alias("quantified"))
    )


def informative_dimensions(moves: DataFrame, profile: DataFrame) -> DataFrame:
    """Groupings, other than the primary one, with more than one label in the whole file."""
    return (
        moves.groupBy(*KEYS, "dimension").agg((F.min("label") < F.max("label")).alias("_many"))
        .where("_many").join(profile.select(*KEYS, "primary_dimension"), KEYS)
        .where(F.col("dimension") != F.col("primary_dimension")).select(*KEYS, "dimension")
    )


def components(cells: DataFrame, informative: DataFrame, n: int = MAX_COMPONENTS) -> DataFrame:
    """Best slice of each informative grouping, largest first, at most `n` per finding."""
    delta = F.col("cost_c") - F.col("cost_b")
    slices = (
        cells.where(F.col("dimension") != UNIT).join(informative, [*KEYS, "dimension"])
        .withColumn("delta", delta).where(F.col("delta") > 0)
        .withColumn("share", ratio(F.col("delta"), F.col("finding_delta")))
        .where(F.col("share") >= F.lit(COMPONENT_MIN_SHARE))
    )
    best = Window.partitionBy(*KEYS, "evidence_id", "dimension").orderBy(F.desc("delta"), "label")
    order = Window.partitionBy(*KEYS, "evidence_id").orderBy(F.desc("delta"), "dimension")
    top = (
        slices.withColumn("_n", F.row_number().over(best)).where(F.col("_n") == 1)
        .withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
    )
    return top.groupBy(*KEYS, "evidence_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("position", "dimension", "label", "delta", "share"))),
        lambda c: F.struct(c["dimension"].alias("dimension"), c["label"].alias("label"),
                           c["delta"].alias("delta"), c["share"].alias("share"))).alias("components"))


def dominant(volume: Column, rate: Column) -> Column:
    """volume / rate / mixed by the volume effect's part of both magnitudes."""
    v, r = F.abs(volume), F.abs(rate)
    total = v + r
    # Comparing products keeps the test exact: share >= .70 is v * 10 >= total * 7.
    return (F.when(total == 0, "mixed").when(v * 10 >= total * 7, "volume")
            .when(v * 10 <= total * 3, "rate").otherwise("mixed"))


def usage_split(cells: DataFrame) -> DataFrame:
    """Volume and price effect per finding; no row for findings with a cell that lacks quantity or unit.

    Each unit is split by itself, then the effects are summed. Where a unit has no positive quantity in one of the
    months there is no rate to compare, and its whole change counts as volume.
    """
    cost_b, cost_c = F.col("cost_b").try_cast("decimal(20,6)"), F.col("cost_c").try_cast("decimal(20,6)")
    # Only quotients of quantities matter, so very large ones are counted in millions to fit a narrow type.
    million = F.lit(1_000_000).cast("decimal(7,0)")
    unit_size = F.when(F.greatest("qty_b", "qty_c") >= F.lit(10 ** 17).cast("decimal(38,15)"), million).otherwise(F.lit(1).cast("decimal(7,0)"))
    qty_b, qty_c = ((F.col(c) / unit_size).try_cast("decimal(24,6)") for c in ("qty_b", "qty_c"))
    both = (F.col("qty_b") > 0) & (F.col("qty_c") > 0)
    money_delta = (F.col("cost_c") - F.col("cost_b")).cast("decimal(38,6)")
    volume = F.when(both, ((qty_c - qty_b) * cost_b / qty_b).cast("decimal(38,6)")).otherwise(money_delta)
    per_unit = (
        cells.where(F.col("dimension") == UNIT)
        .withColumn("volume", volume).withColumn("rate", F.when(both, money_delta - F.col("volume")).otherwise(F.lit(0)))
        .withColumn("rate_b", F.when(both, F.bround(cost_b / qty_b / unit_size, 6)).cast("decimal(28,6)"))
        .withColumn("rate_c", F.when(both, F.bround(cost_c / qty_c / unit_size, 6)).cast("decimal(28,6)"))
    )
    single = (F.count(F.lit(1)) == 1) & F.bool_and(both)

    def only(value: Column) -> Column:
        return F.when(single, F.first(value))

    split = per_unit.groupBy(*KEYS, "evidence_id").agg(
        F.bool_and(F.col("quantified") & F.col("qty_b").isNotNull() & F.col("qty_c").isNotNull()).alias("_all"),
        F.bround(F.sum("volume"), 2).cast("decimal(28,2)").alias("volume_effect"),
        F.bround(F.sum("rate"), 2).cast("decimal(28,2)").alias("rate_effect"),
        only(F.col("label")).alias("unit"),
        only(F.bround("qty_b", 2).cast("decimal(28,2)")).alias("quantity_baseline"),
        only(F.bround("qty_c", 2).cast("decimal(28,2)")).alias("quantity_current"),
        only(F.col("rate_b")).alias("rate_baseline"), only(F.col("rate_c")).alias("rate_current"),
    ).where(F.col("_all") & F.col("volume_effect").isNotNull()).drop("_all")
    quantity_b = F.nullif(F.col("quantity_baseline"), F.lit(0).cast("decimal(28,2)"))
    moved = F.bround(F.col("quantity_current") / quantity_b - 1, 4)
    return split.select(
        *KEYS, "evidence_id",
        F.struct(
            "volume_effect", "rate_effect", dominant(F.col("volume_effect"), F.col("rate_effect")).alias("dominant"),
            "unit", "quantity_baseline", "quantity_current", moved.cast("decimal(20,4)").alias("quantity_change"),
            "rate_baseline", "rate_current").alias("usage_split"))


def missing_evidence(kind: Column, decomposed: Column, parts: Column, split: Column, available: Column) -> Column:
    """Up to three gaps: from what the export contains where the finding was decomposed, else by kind."""
    default = (
        F.when(kind == "new_service", F.array(*map(F.lit, (
            "owner_confirmation", "environment_classification", "change_context"))))
        .otherwise(F.array(*map(F.lit, ("utilization_metrics", "owner_confirmation", "change_context"))))
    )
    owner = F.get(F.filter(parts, lambda c: c["dimension"].isin(NAMES_AN_OWNER)), F.lit(0))
    has_tags = F.arrays_overlap(available, F.array(*map(F.lit, NAMES_AN_OWNER)))
    first = F.when(~has_tags, "allocation_tags").when(
        F.coalesce(owner["share"] < F.lit(OWNER_KNOWN_SHARE), F.lit(True)), "owner_confirmation")
    second = (
        F.when(kind == "new_service", "environment_classification")
        .when(F.coalesce(split["dominant"] == "rate", F.lit(False)), "commitment_coverage")
        .when(F.arrays_overlap(available, F.array(*map(F.lit, SHOWS_CAPACITY))), "utilization_metrics")
        .otherwise("finer_grained_billing")
    )
    derived = F.slice(F.array_compact(F.array(first, second, F.lit("change_context"))), 1, MAX_MISSING)
    return (F.when(kind == "unallocated_spend", F.array(F.lit("allocation_tags"), F.lit("owner_confirmation")))
            .when(decomposed, derived).otherwise(default))


def decompose(findings: DataFrame, records: DataFrame, moves: DataFrame, profile: DataFrame,
              stored: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """Findings with components, usage split and the evidence they lack. The cells are read twice, so they are `stored`."""
    cells = stored(movement_cells(findings, records, profile, stored))
    parts = components(cells, informative_dimensions(moves, profile))
    splits = usage_split(cells)
    about = profile.select(*KEYS, "primary_dimension", "dimensions_available")
    joined = (
        findings.join(about, KEYS)
        .join(parts, [*KEYS, "evidence_id"], "left").join(splits, [*KEYS, "evidence_id"], "left")
    )
    empty = F.expr("array()").cast("array<struct<dimension:string,label:string,delta:decimal(38,15),share:decimal(20,4)>>")
    was = ((F.col("delta") > 0) & (F.col("dimension") == F.col("primary_dimension"))
           & F.col("baseline_month").isNotNull() & (F.col("kind") != "unallocated_spend"))
    return (
        joined.withColumn("components", F.coalesce("components", empty))
        .withColumn("missing_evidence", missing_evidence(
            F.col("kind"), was, F.col("components"), F.col("usage_split"), F.col("dimensions_available")))
        .drop("primary_dimension", "dimensions_available")
    )
