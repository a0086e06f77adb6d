"""Files to judged records: the tables of one batch of exports."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe import session
from tallyframe.operators import quality, records
from tallyframe.plans.analyze import Analysis
from tallyframe.schema import KEYS
from tallyframe.sources.exports import parse_large, parse_lines, parse_plain
from tallyframe.sources.plain import LABELS


class ParsedExports:
    """Lazily derived tables. The `line` table is written once, because every other table reads it."""

    def __init__(self, files: DataFrame, cut: bool = True, spread: int | None = None, large: DataFrame | None = None) -> None:
        """files: one row each, with contents; large: lines of files that are too large for that (`ranges.physical_lines`)."""
        self.files, self.spread, self.large = files, spread, large
        self._cut = session.cut if cut else (lambda df: df)

    def _parse(self, without: list[str]) -> tuple[DataFrame | None, DataFrame | None]:
        """(rows of plain files, settled where they were read; rows of the others): each stored, or none if there are none."""
        if self.spread:
            told, rest = None, [parse_lines(self.files, self.spread)]
        else:
            stored = self._cut(parse_plain(self.files, without))
            arrived = stored.where("kind IN ('file', 'other')")
            seen = arrived.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "file").alias("plain")).agg(
                F.max("n").alias("most"), F.sum("n").alias("n"), F.sum("plain").alias("plain")).first()
            other, told = stored.where("kind = 'other'").select(*KEYS, "path", "content"), stored.where("kind <> 'other'").drop("content")
            rest = []
            if (seen["most"] or 0) > 1:
                # Rows of an export of several files meet each other: all files of such an export are parsed the general way.
                several = arrived.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "file").alias("plain"))
                again = self._cut(several.where("n > 1 AND plain > 0").select(*KEYS))
                told, other = told.join(again, KEYS, "left_anti"), other.join(again, KEYS, "left_anti")
                rest.append(parse_lines(self.files.join(again, KEYS, "left_semi")))
            if (seen["plain"] or 0) < (seen["n"] or 0):
                rest.append(parse_lines(other))
            told = told if seen["plain"] else None
        if self.large is not None:
            rest.append(parse_large(self.large))
        if not rest and told is None:
            rest = [parse_lines(self.files.limit(0))]
        return told, self._cut(reduce(DataFrame.unionByName, rest)) if rest else None

    @staticmethod
    def _union(told: DataFrame | None, rest: DataFrame | None) -> DataFrame:
        return rest if told is None else told if rest is None else told.unionByName(rest, allowMissingColumns=True)

    @cached_property
    def _whole(self) -> tuple[DataFrame | None, DataFrame | None]:
        return self._parse([])

    @cached_property
    def _judging(self) -> tuple[DataFrame | None, DataFrame | None]:
        """What judging reads: plain rows without their labels, unless they are stored with them."""
        return self._whole if "_whole" in vars(self) else self._parse([*LABELS, "signature"])

    @cached_property
    def lines(self) -> DataFrame:
        return self._union(*self._whole)

    @property
    def _lines(self) -> DataFrame:
        return self.lines if "_whole" in vars(self) else self._union(*self._judging)

    @cached_property
    def facts(self) -> DataFrame:
        return quality.file_facts(self._lines)

    def _classified(self, parts: tuple[DataFrame | None, DataFrame | None], then: Callable[[DataFrame], DataFrame], store: bool = True) -> DataFrame:
        """Settled rows are judged as they are read; only the others, which meet in shuffles, are stored."""
        told, rest = parts
        general = None if rest is None else then(records.classify_rows(rest))
        return self._union(None if told is None else then(records.classify_settled(told)), self._cut(general) if store and rest is not None else general)

    @cached_property
    def rows(self) -> DataFrame:
        return self._classified(self._whole, lambda df: df)

    @cached_property
    def judged(self) -> DataFrame:
        """Rows without their labels: all that counts, sums and rejections read. Stored rows are not classified again."""
        if "rows" in vars(self):
            return records.judged(self.rows)
        return self._classified(self._judging, records.judged)

    @cached_property
    def records(self) -> DataFrame:
        return records.cost_records(self.rows, self.facts)

    @property
    def records_once(self) -> DataFrame:
        """Records for a single pass: rows that are not stored yet are not stored for it, and only what is read of them
        meets their first copies."""
        if "rows" in vars(self):
            return self.records
        return records.cost_records(self._classified(self._whole, lambda df: df, store=False), self.facts)

    @cached_property
    def rejections(self) -> DataFrame:
        return records.rejections(self.judged)

    @cached_property
    def rejection_sample(self) -> DataFrame:
        return records.sample_rejections(self.rejections)

    @cached_property
    def amounts(self) -> DataFrame:
        return records.amounts(self.judged, self.facts)

    @cached_property
    def currency(self) -> DataFrame:
        return quality.currency_consensus(self.amounts, self.facts)

    @cached_property
    def profile(self) -> DataFrame:
        counts = quality.line_counts(self.judged, self.rejections)
        return self._cut(quality.export_profile(self.facts, counts, self.amounts, self.currency))

    @cached_property
    def reconciliation(self) -> DataFrame:
        return records.reconcile(self._lines, self.judged)

    @cached_property
    def issues(self) -> DataFrame:
        told, rest = self._judging
        conflicts = None if told is None else records.differing(records.judged(records.classify_settled(told)))
        if rest is not None:
            conflicts = self._union(conflicts, records.conflicting_costs(self._cut(records.keyed_costs(rest))))
        return quality.quality_issues(
            self.profile, self.rejections, conflicts, records.conflicting_periods(self.judged), self.reconciliation)

    @cached_property
    def fatal(self) -> DataFrame:
        return quality.fatal_issues(self.facts, self.profile)

    def analysis(self, today: date) -> Analysis:
        return Analysis(self.records, self.profile, today, self.issues)


def one_per_export(files: DataFrame) -> DataFrame:
    """(tenant_id, export_id, path): one landing file per (tenant, content). Only keys and paths are shuffled, never contents."""
    return files.groupBy(*KEYS).agg(F.min("path").alias("path"))
