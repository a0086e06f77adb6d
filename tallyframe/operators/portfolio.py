"""Queries over the persisted tables: owners, run lists and status, leads, retention, erasure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RETENTION_DAYS, ANONYMOUS_DAYS = 30, 7


def tenants_for(leads: DataFrame, emails: DataFrame) -> DataFrame:
    """Tenants an e-mail address may see, matched without regard to case."""
    wanted = emails.select(F.lower("email").alias("owner")).distinct()
    return leads.select(F.lower("email").alias("owner"), "tenant_id").join(wanted, "owner", "left_semi").distinct()


def owners(leads: DataFrame) -> DataFrame:
    return leads.select(F.lower("email").alias("owner"), "tenant_id").distinct()


def scoped(df: DataFrame, tenants: DataFrame) -> DataFrame:
    """Rows of the given tenants; on tables partitioned by tenant this prunes files at run time."""
    return df.join(tenants.select("tenant_id").distinct(), "tenant_id", "left_semi")


def teasers(summaries: DataFrame, counts: DataFrame) -> DataFrame:
    """A few fields of each summary for readers who may not see findings yet. Both inputs are one row per export."""
    s = F.col("summary")
    rows = F.coalesce(F.try_element_at(s["largest_changes"], s["dimension"]), F.flatten(F.map_values(s["largest_changes"])))
    up = F.filter(rows, lambda r: r["delta"].cast("decimal(28,2)") > 0)
    top = F.get(F.array_sort(up, lambda a, b: F.when(a["delta"].cast("decimal(28,2)") > b["delta"].cast("decimal(28,2)"), -1)
                             .when(a["delta"].cast("decimal(28,2)") < b["delta"].cast("decimal(28,2)"), 1)
                             .when(a["label"] < b["label"], -1).when(a["label"] > b["label"], 1).otherwise(0)), F.lit(0))
    return summaries.join(counts, ["tenant_id", "export_id"], "left").select(
        "tenant_id", "export_id", s["currency"].alias("currency"),
        s["period"]["start"].alias("period_start"), s["period"]["end"].alias("period_end"),
        F.coalesce(s["total"], F.lit("0")).alias("total_covered"),
        s["comparison"]["baseline_month"].alias("baseline_month"), s["comparison"]["current_month"].alias("current_month"),
        s["comparison"]["delta"].alias("change"), s["comparison"]["delta_pct"].alias("change_pct"),
        top["label"].alias("top_driver"), top["delta"].alias("top_driver_change"),
        F.coalesce(s["investigation_impact"], F.lit("0")).alias("investigation_impact"),
        F.coalesce("finding_count", F.lit(0)).cast("bigint").alias("finding_count"),
        s["readiness"]["score"].alias("readiness_score"))


def finding_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("tenant_id", "run_id").agg(
        F.count(F.lit(1)).alias("findings"), F.count_if("review_required").alias("review_required"))


def run_status(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Progress of every run with its finding count and, for a failed one, the first error message.

    runs.warnings: array<struct<code,severity,message>>.
    """
    error = F.get(F.filter("warnings", lambda w: w["severity"] == "error"), F.lit(0))["message"]
    counts = finding_counts(findings).select("tenant_id", "run_id", "findings")
    return runs.join(counts, ["tenant_id", "run_id"], "left").select(
        "tenant_id", "run_id", "status", "rows_seen", "rows_accepted", "rows_rejected",
        F.size("warnings").cast("bigint").alias("warning_count"), F.col("completed_at").isNotNull().alias("completed"),
        F.col("unlocked_at").isNotNull().alias("unlocked"),
        F.when(F.col("status").isin("failed", "insufficient_data"), error).alias("message"),
        F.coalesce("findings", F.lit(0)).cast("bigint").alias("finding_count"))


def run_list(runs: DataFrame, files: DataFrame) -> DataFrame:
    """Runs with their file name, newest first."""
    names = files.select("tenant_id", "file_id", "filename")
    return runs.join(names, ["tenant_id", "file_id"]).select(
        "tenant_id", "run_id", "status", "created_at", "filename").orderBy(F.desc("created_at"), "run_id")


def run_detail(runs: DataFrame, files: DataFrame, findings: DataFrame) -> DataFrame:
    """One row per finding of each run, with the run's header, in rank order."""
    head = runs.join(files.select("tenant_id", "file_id", "filename"), ["tenant_id", "file_id"]).select(
        "tenant_id", "run_id", F.col("status").alias("run_status"), "filename", "rows_seen", "rows_accepted", "rows_rejected")
    return head.join(findings, ["tenant_id", "run_id"]).orderBy("run_id", "rank")


def lead_portfolio(leads: DataFrame, files: DataFrame, runs: DataFrame, pilots: DataFrame, n: int | None = None) -> DataFrame:
    """All leads, or the newest `n` in order, with uploads, latest run and pilot interest.

    With `n` only those leads pass a distributed top-n, and the other tables are reduced to them before they are grouped.
    """
    newest = leads if n is None else leads.orderBy(F.desc("created_at"), "lead_id").limit(n)
    ids = newest.select("lead_id")
    mine = files.join(ids, "lead_id", "left_semi")
    uploads = mine.groupBy("lead_id").agg(F.count(F.lit(1)).alias("uploads"))
    latest = runs.join(mine.select("tenant_id", "file_id", "lead_id"), ["tenant_id", "file_id"]).groupBy("lead_id").agg(
        F.max_by(F.struct("run_id", "status"), F.struct("created_at", "run_id")).alias("latest_run"))
    wanted = pilots.join(ids, "lead_id", "left_semi").groupBy("lead_id").agg(
        F.count_if(~F.col("manual_review_only")).alias("pilot_requests"), F.bool_or("manual_review_only").alias("manual_review"))
    found = (
        newest.join(uploads, "lead_id", "left").join(latest, "lead_id", "left").join(wanted, "lead_id", "left")
        .select("lead_id", "tenant_id", "email", F.col("status").alias("lead_status"), "created_at",
                F.coalesce("uploads", F.lit(0)).cast("bigint").alias("uploads"),
                F.col("latest_run.run_id").alias("latest_run_id"), F.col("latest_run.status").alias("latest_run_status"),
                F.coalesce("pilot_requests", F.lit(0)).cast("bigint").alias("pilot_requests"),
                F.coalesce("manual_review", F.lit(False)).alias("manual_review"))
    )
    return found if n is None else found.orderBy(F.desc("created_at"), "lead_id")


def lead_rollup(leads: DataFrame, files: DataFrame, runs: DataFrame, findings: DataFrame, consents: DataFrame,
                provider: str) -> DataFrame:
    """One row per (lead, file, run): finding counts and whether the file's use was permitted."""
    granted = consents.where(F.col("provider") == provider).groupBy("tenant_id", "file_id").agg(
        F.max_by("granted", "created_at").alias("consent"))
    keys = ["tenant_id", "run_id"]
    return (
        leads.select("tenant_id", "lead_id").join(files.select("tenant_id", "lead_id", "file_id", "filename"), ["tenant_id", "lead_id"])
        .join(granted, ["tenant_id", "file_id"], "left")
        .join(runs.select("tenant_id", "file_id", "run_id", F.col("status").alias("run_status"), "created_at"), ["tenant_id", "file_id"], "left")
        .join(finding_counts(findings), keys, "left")
        .select("lead_id", "tenant_id", "file_id", "filename", "consent", "run_id", "run_status", "created_at",
                F.coalesce("findings", F.lit(0)).cast("bigint").alias("findings"),
                F.coalesce("review_required", F.lit(0)).cast("bigint").alias("review_required"))
    )


def lead_detail(rollup: DataFrame) -> DataFrame:
    """Files of each lead with their runs nested, newest run first. A lead's own uploads bound the lists."""
    runs = F.filter(F.collect_list(F.when(F.col("run_id").isNotNull(), F.struct(
        "created_at", "run_id", "run_status", "findings", "review_required"))), lambda r: r.isNotNull())
    return rollup.groupBy("lead_id", "tenant_id", "file_id", "filename", "consent").agg(
        F.sort_array(runs, asc=False).alias("runs"))


def retention_due(files: DataFrame, now: Column, days: int = RETENTION_DAYS, anonymous_days: int = ANONYMOUS_DAYS,
                  n: int | None = None) -> DataFrame:
    """All raw files past their window (shorter where nobody claimed the upload), or the oldest `n` in order."""
    keep = F.when(F.col("lead_id").isNull(), anonymous_days).otherwise(days)
    due = files.where(F.col("raw_deleted_at").isNull() & (F.col("created_at") < now.cast("timestamp_ntz") - F.make_dt_interval(keep)))
    return (due if n is None else due.orderBy("created_at", "file_id").limit(n)).select(
        "tenant_id", "file_id", "created_at", F.col("lead_id").isNotNull().alias("claimed"))


def retention_events(due: DataFrame, days: int = RETENTION_DAYS, anonymous_days: int = ANONYMOUS_DAYS) -> DataFrame:
    """Content-free audit rows for the files a sweep removed."""
    kept = F.when(F.col("claimed"), days).otherwise(anonymous_days)
    return due.select(
        "tenant_id", F.lit("system").alias("actor_type"), F.lit("raw_file.deleted_by_retention").alias("action"),
        F.lit("source_file").alias("object_type"), F.col("file_id").cast("string").alias("object_id"),
        F.to_json(F.struct(kept.alias("retention_days"), "claimed")).alias("metadata"))


def erase(tables: dict[str, DataFrame], erase_list: DataFrame) -> dict[str, DataFrame]:
    """Every table without the listed files and all that derives from them, plus the audit rows.

    tables: source_file, snapshot_run, and any of snapshot_finding, evidence_packet, model_call,
    consent. erase_list: tenant_id, file_id. Audit rows have no parent and survive.
    """
    gone = erase_list.select("tenant_id", "file_id").distinct()
    runs = tables["snapshot_run"]
    gone_runs = runs.join(gone, ["tenant_id", "file_id"], "left_semi").select("tenant_id", "run_id")
    out = {}
    for name, table in tables.items():
        if "run_id" in table.columns and name != "snapshot_run":
            out[name] = table.join(gone_runs, ["tenant_id", "run_id"], "left_anti")
        else:
            out[name] = table.join(gone, ["tenant_id", "file_id"], "left_anti")
    removed = runs.join(gone, ["tenant_id", "file_id"]).groupBy("tenant_id", "file_id").agg(F.count(F.lit(1)).alias("_n"))
    existing = tables["source_file"].join(gone, ["tenant_id", "file_id"], "left_semi").select("tenant_id", "file_id")
    out["audit_event"] = existing.join(removed, ["tenant_id", "file_id"], "left").select(
        "tenant_id", F.lit("source_file.deleted").alias("action"), F.lit("source_file").alias("object_type"),
        F.col("file_id").cast("string").alias("object_id"),
        F.to_json(F.struct(F.coalesce("_n", F.lit(0)).cast("bigint").alias("runs_deleted"))).alias("metadata"))
    return out
