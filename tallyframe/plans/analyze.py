"""The whole analysis of all exports at once, as a small graph of tables.

Records are read three times at most: once for dates, once for the monthly series, once for the rows
behind the findings. Everything after that is aggregated and small; those tables are cut from their
lineage because several results use each of them.
"""

from __future__ import annotations

from datetime import date
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators import answers, cards, decompose, detect, gate, monthly, packets, periods, readiness, summary
from tallyframe.schema import KEYS, OWNERSHIP_DIMENSIONS, PACKET_V1


class Analysis:
    """Lazily derived tables of one batch of exports; each property is one table."""

    def __init__(self, records: DataFrame, profile: DataFrame, today: date | Column,
                 issues: DataFrame | None = None, cut: bool = True, coverage: DataFrame | None = None) -> None:
        self.records, self._profile, self.today, self._issues = records, profile, today, issues
        self._cut = session.cut if cut else (lambda df: df)
        self._coverage = coverage

    @cached_property
    def profile(self) -> DataFrame:
        return self._cut(self._profile)

    @cached_property
    def coverage(self) -> DataFrame:
        return self._coverage if self._coverage is not None else self._cut(periods.month_coverage(periods.day_totals(self.records), self.today))

    @cached_property
    def focus(self) -> DataFrame:
        return periods.focus(self.coverage)

    @cached_property
    def series(self) -> DataFrame:
        return self._cut(monthly.monthly_series(self.records))

    @cached_property
    def moves(self) -> DataFrame:
        return self._cut(detect.movements(self.series, self.focus))

    @cached_property
    def thresholds(self) -> DataFrame:
        return detect.thresholds(self.focus)

    @cached_property
    def unallocated(self) -> DataFrame:
        return detect.unallocated_state(self.moves, self.coverage, self.focus)

    @cached_property
    def ranked(self) -> DataFrame:
        """Ranked findings before decomposition; at most ten rows per export."""
        return self._cut(detect.detect(self.moves, self.coverage, self.focus, self.profile))

    @cached_property
    def refs(self) -> DataFrame:
        """Source positions per finding. An unallocated finding points at every record of the current
        month that carries any unallocated key."""
        months = F.explode(F.array_compact(F.array("baseline_month", "current_month"))).alias("month")
        rises = self.ranked.where(F.col("kind") != "unallocated_spend").select(
            *KEYS, "evidence_id", "dimension", "label", months)
        gaps = self.ranked.where(F.col("kind") == "unallocated_spend").select(
            *KEYS, "evidence_id", F.col("current_month").alias("month"))
        keys = self.moves.where("unallocated").select(*KEYS, "dimension", "label")
        # Stored, so that its true size is known: a product of estimates would shuffle all records by every dimension.
        wanted = self._cut(rises.unionByName(gaps.join(keys, KEYS)))
        # Records of other months drop out before they are unpivoted, also where many labels are wanted.
        asked = self.ranked.select(*KEYS, months).distinct()
        return monthly.source_refs(self.records.join(asked, [*KEYS, "month"], "left_semi"), wanted, [*KEYS, "evidence_id"])

    @cached_property
    def history(self) -> DataFrame:
        return monthly.history(self.series, self.coverage, self.ranked)

    @cached_property
    def findings(self) -> DataFrame:
        """Ranked findings with components, usage split, missing evidence, history and references."""
        full = decompose.decompose(self.ranked, self.records, self.moves, self.profile, self._cut)
        return self._cut(
            full.join(self.history, [*KEYS, "evidence_id"], "left")
            .join(self.refs, [*KEYS, "evidence_id"], "left")
        )

    # ---- scoring, packets, decisions ---------------------------------------------------------------

    @cached_property
    def period(self) -> DataFrame:
        return periods.covered_period(self.coverage)

    @cached_property
    def issues(self) -> DataFrame:
        """Issues found while parsing (if given) and those the months raise."""
        raised = periods.period_issues(self.coverage)
        return raised if self._issues is None else raised.unionByName(self._issues, allowMissingColumns=True)

    @cached_property
    def codes(self) -> DataFrame:
        return readiness.issue_codes(self.issues)

    @cached_property
    def readiness(self) -> DataFrame:
        return readiness.readiness(self.profile, self.codes, self.focus, self.unallocated)

    @cached_property
    def context(self) -> DataFrame:
        """What every packet of an export says about the whole export; one row per export."""
        return (
            self.profile.select(*KEYS, "currency", "total_cost", "dimensions_available")
            .join(self.focus.select(*KEYS, F.col("baseline_month").alias("focus_baseline"),
                                    F.col("current_month").alias("focus_month"), "baseline_total",
                                    F.col("current_total").alias("focus_total")), KEYS)
            .join(self.period.select(*KEYS, "period_start", "period_end"), KEYS)
            .join(monthly.covered_spend(self.focus), KEYS)
            .join(self.readiness.select(*KEYS, F.col("score").alias("readiness_score")), KEYS)
            .join(self.codes, KEYS, "left")
        )

    def packets(self, version: str = PACKET_V1) -> DataFrame:
        return packets.packets(self.findings, self.moves, self.context, version)

    def safe_labels(self) -> DataFrame:
        return packets.safe_labels(self.findings, self.moves, with_components=True)

    def with_answers(self, calls: DataFrame | None = None, permission: DataFrame | None = None,
                     version: str = PACKET_V1, question_set: str | None = None, provider: str | None = None,
                     model: str | None = None) -> DataFrame:
        """Findings with packet hash, the valid stored answer they may use, or why there is none.

        `permission` has one row per export with `unavailable_reason` (NULL = answers may be used).
        """
        packed = self.packets(version).select(*KEYS, "evidence_id", "packet_sha256", "packet_version")
        base = self.findings.join(packed, [*KEYS, "evidence_id"])
        allowed = (permission.select(*KEYS, F.col("unavailable_reason").alias("_blocked"))
                   if permission is not None else
                   self.profile.select(*KEYS, F.lit("disabled" if calls is None else None).cast("string").alias("_blocked")))
        base = base.join(allowed, KEYS, "left")
        if calls is None:
            none = F.lit(None).cast(_ANSWER_STRUCT)
            return base.withColumn("answer", none).withColumnRenamed("_blocked", "unavailable_reason")
        valid = answers.validate_answers(answers.latest_answers(calls)).where("valid")
        latest = answers.one_per_packet(valid, question_set, provider, model).select(
            "tenant_id", "packet_sha256", F.col("answer").alias("_answer"))
        return (
            base.join(latest, ["tenant_id", "packet_sha256"], "left")
            .withColumn("answer", F.when(F.col("_blocked").isNull(), F.col("_answer")))
            .withColumn("unavailable_reason", F.coalesce(
                F.col("_blocked"), F.when(F.col("_answer").isNull(), "retries_exhausted")))
            .drop("_answer", "_blocked")
        )

    def decide(self, answered: DataFrame, low: float = 0.5, margin: float = 0.3) -> DataFrame:
        """Decisions and cards for findings that carry `answer` and `unavailable_reason`."""
        about = self.profile.select(*KEYS, "currency", F.arrays_overlap(
            "dimensions_available", F.array(*map(F.lit, OWNERSHIP_DIMENSIONS))).alias("ownership_visible"))
        bill = self.focus.select(*KEYS, F.when(
            F.col("has_pair"), F.col("current_total") - F.col("baseline_total")).alias("total_change"))
        decided = gate.gate(answered, self.readiness, low, margin).join(about, KEYS).join(bill, KEYS)
        merged = decided.withColumn("missing", gate.merge_missing(F.col("missing_evidence"), F.col("answer.primary_missing")))
        return cards.cards(merged)

    @cached_property
    def top_items(self) -> DataFrame:
        return monthly.top_items(self.series, self.coverage, self.focus, self.profile)

    @cached_property
    def largest_changes(self) -> DataFrame:
        return detect.largest_changes(self.moves)

    @cached_property
    def impact(self) -> DataFrame:
        return summary.investigation_impact(self.ranked, self.focus, self.profile)

    @cached_property
    def summary(self) -> DataFrame:
        return summary.run_summary(
            self.profile, self.period, self.coverage, self.focus, self.thresholds, self.top_items,
            self.largest_changes, self.unallocated, self.readiness, self.impact)


_ANSWER_STRUCT = ("struct<category:string,category_confidence:double,category_probabilities:map<string,double>,"
                  "owner:string,owner_confidence:double,urgency:string,risk:string,primary_missing:string,"
                  "evidence_sufficient:double,needs_human_review:double,change_material:double>")
