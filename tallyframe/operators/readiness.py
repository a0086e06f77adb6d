"""How far each export can support a decision: seven components adding up to 0-100."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.schema import KEYS, OWNERSHIP_DIMENSIONS, UNALLOCATED_SHARE

COMPONENTS = ["periods", "row_quality", "reconciliation", "currency", "duplicates", "dimension_coverage", "allocation"]
#: Issues that mean the file disagrees with itself.
UNRECONCILED = ["totals_do_not_reconcile", "conflicting_duplicate_periods", "conflicting_duplicate_keys"]


def _lits(values):
    return F.array(*map(F.lit, values))


def issue_codes(issues: DataFrame) -> DataFrame:
    """Sorted distinct issue codes per export."""
    return issues.groupBy(*KEYS).agg(F.array_sort(F.collect_set("code")).alias("codes"))


def readiness(profile: DataFrame, codes: DataFrame, focus: DataFrame, unallocated: DataFrame) -> DataFrame:
    """One row per export with every component and the score."""
    state = (
        profile.join(focus.select(*KEYS, "has_pair", "complete_months"), KEYS)
        .join(codes, KEYS, "left")
        .join(unallocated.select(*KEYS, F.col("share").alias("_share")), KEYS, "left")
        .withColumn("codes", F.coalesce("codes", F.array().cast("array<string>")))
    )
    has = lambda values: F.arrays_overlap("dimensions_available", _lits(values))
    bad = (F.col("lines_rejected") + F.col("cells_rejected")).cast("decimal(20,0)")
    seen = F.greatest(F.lit(1).cast("decimal(20,0)"), F.col("records").cast("decimal(20,0)") + bad)
    lost = F.least(F.lit(1).cast("decimal(38,12)"), (bad * 5).cast("decimal(20,0)") / seen)
    parts = {
        "periods": F.when(F.col("has_pair"), 30).when(F.col("complete_months") >= 2, 20)
        .when(F.col("complete_months") == 1, 10).otherwise(0),
        "row_quality": F.bround(F.lit(20) * (F.lit(1) - lost), 0).cast("int"),
        "reconciliation": F.when(F.arrays_overlap("codes", _lits(UNRECONCILED)), 0).otherwise(10),
        "currency": F.when(F.array_contains("codes", "mixed_currencies"), 0)
        .when(F.coalesce("currency", F.lit("")) != "", 10).otherwise(5),
        "duplicates": F.when(F.col("duplicate_lines") > 0, 0).otherwise(5),
        "dimension_coverage": F.when(has(["service"]), 5).otherwise(0) + F.when(has(["account", "region"]), 5).otherwise(0),
        "allocation": F.when(has(OWNERSHIP_DIMENSIONS) & (F.coalesce("_share", F.lit(0)) < F.lit(UNALLOCATED_SHARE)), 15)
        .otherwise(5),
    }
    scored = state.select(*KEYS, *[v.cast("int").alias(k) for k, v in parts.items()])
    return scored.withColumn("score", sum((F.col(c) for c in COMPONENTS), F.lit(0)))
