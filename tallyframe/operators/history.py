"""What became of last report's findings: previous run, carried and resolved findings, new subjects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUN = ["tenant_id", "run_id"]


def completed(runs: DataFrame) -> DataFrame:
    return runs.where((F.col("status") == "completed") & F.col("completed_at").isNotNull())


def previous_run(runs: DataFrame, owners: DataFrame) -> DataFrame:
    """For each completed run, the owner's latest completed run about an earlier report month.

    runs: tenant_id, run_id, status, month, created_at, completed_at. owners: tenant_id, owner.
    Each (owner, month) is first reduced to its latest run by a map-side fold, so the as-of lookup is
    a lag over an owner's months and no pairs of runs are formed. A run without a month looks at
    every dated run.
    """
    done = completed(runs).join(owners.select("tenant_id", "owner").distinct(), "tenant_id").select(
        "owner", *RUN, "month", "created_at")
    latest = done.where(F.col("month").isNotNull()).groupBy("owner", "month").agg(
        F.max_by(F.struct("tenant_id", "run_id", "month"), F.struct("created_at", "tenant_id", "run_id")).alias("rep"))
    by_month = Window.partitionBy("owner").orderBy("month")
    steps = latest.select("owner", "month", F.lag("rep").over(by_month).alias("prev"))
    last = latest.groupBy("owner").agg(F.max_by("rep", "month").alias("prev")).select(
        "owner", F.lit(None).cast(latest.schema["month"].dataType).alias("month"), "prev")
    lookup = steps.unionByName(last).where(F.col("prev").isNotNull())
    return (
        done.alias("r").join(lookup.alias("p"), (F.col("r.owner") == F.col("p.owner"))
                             & F.col("r.month").eqNullSafe(F.col("p.month")))
        .select("r.owner", "r.tenant_id", "r.run_id", F.col("r.month").alias("month"),
                F.col("prev.tenant_id").alias("previous_tenant_id"), F.col("prev.run_id").alias("previous_run_id"),
                F.col("prev.month").alias("previous_month"))
    )


def outcome(then: Column, now: Column) -> Column:
    """By what was observed, not by the size of the change."""
    before, after = F.coalesce(then, F.lit(0)).cast("double"), F.coalesce(now, F.lit(0)).cast("double")
    return (F.when(after > before * 1.02, "grew").when(after < before * 0.98, "shrank").otherwise("unchanged"))


def _keyed(findings: DataFrame) -> DataFrame:
    return findings.where(F.col("finding_key").isNotNull() & (F.col("finding_key") != ""))


def carry_over(previous: DataFrame, findings: DataFrame) -> DataFrame:
    """Every finding of the previous report with its outcome in this one; resolved where it is gone."""
    keyed = _keyed(findings)
    before = keyed.select(
        F.col("tenant_id").alias("previous_tenant_id"), F.col("run_id").alias("previous_run_id"), "finding_key",
        F.col("title").alias("_title"), F.col("final_category").alias("previous_category"),
        F.col("delta_value").alias("previous_delta"), F.col("observed_value").alias("previous_current"))
    after = keyed.select(
        *RUN, "finding_key", F.col("title").alias("_now_title"), F.col("delta_value").alias("current_delta"),
        F.col("observed_value").alias("current_current"), F.lit(True).alias("_here"))
    return (
        previous.join(before, ["previous_tenant_id", "previous_run_id"])
        .join(after, [*RUN, "finding_key"], "left")
        .select("owner", *RUN, "previous_run_id", "previous_month", "finding_key",
                F.coalesce("_now_title", "_title").alias("title"), "previous_category", "previous_delta",
                "previous_current", "current_delta", "current_current",
                F.when(F.col("_here"), outcome(F.col("previous_current"), F.col("current_current")))
                .otherwise("resolved").alias("outcome"))
    )


def new_subjects(previous: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of a run whose subject its previous report did not have, counted per run.

    Runs whose previous report recorded nothing are absent: there is nothing to compare against.
    """
    keyed = _keyed(findings).select("tenant_id", "run_id", "finding_key")
    then = keyed.select(F.col("tenant_id").alias("previous_tenant_id"), F.col("run_id").alias("previous_run_id"), "finding_key")
    comparable = previous.join(then.drop("finding_key").distinct(), ["previous_tenant_id", "previous_run_id"], "left_semi")
    now = comparable.join(keyed, RUN)
    fresh = now.join(then, ["previous_tenant_id", "previous_run_id", "finding_key"], "left_anti")
    counts = fresh.groupBy(*RUN).agg(F.count(F.lit(1)).alias("new_count"))
    return comparable.join(counts, RUN, "left").select(
        "owner", *RUN, "previous_run_id", F.coalesce("new_count", F.lit(0)).cast("bigint").alias("new_count"))
