"""Findings of the third review, second part: rows of parsed exports travel without their labels where only counts are asked."""
from __future__ import annotations

from tallyframe.operators import records
from tallyframe.plans.ingest import ParsedExports
from tallyframe.schema import KEYS

LONG = ("Date,Service,Cost,Currency,Usage Quantity,Team\n2026-06-01,EC2,4,usd,1,a\n2026-06-01,EC2,5,USD,oops,a\n2026-06-01,EC2,4,usd,1,a\n"
        "2026-06-02,S3,,usd,1,\n2026-06-02,S3,n/a,eur,1,\n2026-06-03,S3,-2,EUR,1,b\nbad,S3,1,usd,1,b\n")
WIDE = "Service,EC2($),RDS(€),Total($)\n2026-06-01,4,x,4\n2026-06-01,5,,6\n2026-06-01,5,,6\n2026-07-01,1,2,3\n"
FILES = {"long": LONG, "wide": WIDE, "none": "Date,Service,Cost\nbad,EC2,1\n", "fatal": "  \n"}


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def _rows(df) -> list:
    return sorted(map(str, df.collect()))


def test_rejections_and_profiles_do_not_move_labels(export_files):
    parsed = ParsedExports(export_files(FILES))
    for found in (records.judged(records.classify_rows(parsed.lines)), records.keyed_costs(parsed.lines).drop("_key")):
        joins = _plan(found).split("Join", 1)[1]
        assert "availability_zone" not in joins.split("Relation")[0] and "period_end" not in joins.split("Relation")[0]
    got = {(r.export_id, r.line, r.col, r.reason) for r in parsed.rejection_sample.collect()}
    assert got == {("long", 3, 5, "invalid_number"), ("long", 4, None, "duplicate_row"), ("long", 5, 3, "missing_cost"), ("long", 6, 3, "invalid_number"),
                   ("long", 8, 1, "invalid_date"), ("none", 2, 1, "invalid_date"), ("wide", 2, 3, "invalid_number"), ("wide", 4, None, "duplicate_row")}
    assert parsed.profile.count() == 2 and "rows" not in vars(parsed)  # nothing above stored the rows with their labels


def test_amounts_and_keys_are_those_of_the_records(export_files):
    parsed, stored = ParsedExports(export_files(FILES)), ParsedExports(export_files(FILES))
    cols = [*KEYS, "col", "cost", "currency"]
    assert _rows(parsed.amounts.select(cols)) == _rows(parsed.records.select(cols)) != []
    by_key = records.conflicting_costs(records.keyed_costs(parsed.lines))
    assert _rows(by_key) == _rows(records.conflicting_keys(parsed.records)) == ["Row(tenant_id='t', export_id='long', count=1)"]
    parsed = ParsedExports(export_files(FILES))
    codes = {(r.export_id, r.code, r["count"]) for r in parsed.issues.collect()}
    assert "rows" not in vars(parsed) and stored.rows.count() == 12 and _rows(stored.issues) == _rows(parsed.issues)
    assert {("long", "conflicting_duplicate_keys", 1), ("long", "mixed_currencies", None), ("wide", "conflicting_duplicate_periods", 1),
            ("wide", "mixed_currencies", None), ("long", "credits_present", 1), ("long", "duplicate_rows", 1)} <= codes
