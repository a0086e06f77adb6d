from __future__ import annotations

from datetime import date
from decimal import Decimal

import pytest

from tallyframe.plans.ingest import ParsedExports
from tallyframe.sources.landing import screen

WIDE = ("Service,EC2($),RDS($),Total costs($)\nService total,330.00,110.00,440.00\n2026-05-01,100.00,50.00,150.00\n"
        "2026-06-01,110.00,,110.00\n2026-07-01,120.00,60.00,180.00\n")
FILES = {
    "wide": WIDE,
    "bom": b"\xef\xbb\xbf" + WIDE.encode(),
    "semicolon": "Service;EC2(€);Total costs(€)\n2026-06-01;1234,56;1234,56\n2026-07-01;1300,10;1300,10\n",
    "invalid": "Service,EC2($),RDS($),S3($)\n2026-06-01,43.40,N/A,3.10\n2026-07-01,abc,17.25,1.2.3\n",
    "duplicate": "Service,EC2($)\n2026-06-01,4\n2026-06-01,4\n2026-06-01,5\n2026-06-01,4\n",
    "mismatch": "Service,EC2($),Total($)\nService total,9,9\n2026-06-01,4,4\n2026-07-01,4,8\n",
    "long": ("TimePeriodStart,TimePeriodEnd,LinkedAccountId,LinkedAccountName,Service,UsageQuantity,UsageUnit,UnblendedCost,Currency,Team\n"
             "2026-05-01,2026-05-31,1,prod,EC2,10,Hrs,100,usd,Core\n2026-06-01,2026-06-18,1,prod,EC2,20,Hrs,200,USD,\n"
             "2026-06-01,2026-06-18,1,prod,EC2,oops,Hrs,7,USD,\n2026-06-01,2026-06-18,1,prod,EC2,20,Hrs,200,USD,\n"
             "bad,x,1,prod,EC2,1,Hrs,1,USD,\n2026-06-01,,1,prod,EC2,1,Hrs,,USD,\nshort,row\n"),
    "quoted": 'Date,Service,Cost\n"2026-06-01","multi\nline ""x""",1\n\n2026-07-01,plain "quote,2\n2026-07-02,"a"b,3\n',
    "mixed": "Date,Service,Cost,Currency\n2026-06-01,L,10,USD\n2026-07-01,L,-9,EUR\n",
    "slashes": "Date,Service,Cost\n13/06/2026,L,1\n01/07/2026,L,2\n",
    "assumed": "Date,Service,Cost\n06/01/2026,L,1\n07/01/2026,L,2\n",
    "empty": "  \n", "header": "Service,EC2($)\n", "prose": "just one column of prose\nand another line\n",
    "nocost": "Date,Service,Region\n2026-06-01,L,us\n", "layout": "name,age,city\nAlex,34,Leeds\n", "rows": "Date,Service,Cost\n2026-06-01,EC2,abc\n",
    "binary": b"\xff\xfeS\x00e\x00", "latin": b"Service,Cost\n2026-06-01,\xe9\n",
    "huge": "Date,Service,Cost\n2026-06-01," + "x" * 10_001 + ",1\n", "many": ",".join(["c"] * 1_001) + "\n" + ",".join(["1"] * 1_001) + "\n",
}


@pytest.fixture(scope="module")
def parsed(export_files):
    return ParsedExports(export_files(FILES))


@pytest.fixture(scope="module")
def profile(parsed):
    return {r.export_id: r for r in parsed.profile.collect()}


def _codes(df):
    out: dict[str, set[str]] = {}
    for r in df.collect():
        out.setdefault(r.export_id, set()).add(r.code)
    return out


def test_totals_and_counts(profile):
    assert profile["wide"].total_cost == profile["bom"].total_cost == Decimal("440")
    assert (profile["wide"].lines_seen, profile["wide"].empty_cells, profile["wide"].currency) == (3, 1, "USD")
    assert (profile["semicolon"].delimiter, profile["semicolon"].currency, profile["semicolon"].total_cost) == (";", "EUR", Decimal("2534.66"))
    assert profile["bom"].had_bom and not profile["wide"].had_bom
    assert (profile["invalid"].cells_rejected, profile["invalid"].total_cost) == (3, Decimal("63.75"))
    # A, A, B, A: only the repeat of the previous row goes.
    assert (profile["duplicate"].duplicate_lines, profile["duplicate"].total_cost) == (1, Decimal("13"))
    assert profile["mixed"].currency is None


def test_accepted_plus_rejected_is_seen(profile):
    assert all(r.lines_accepted + r.lines_rejected == r.lines_seen for r in profile.values())


def test_rejections_point_at_line_and_column(parsed):
    got = {(r.export_id, r.line, r.col, r.reason) for r in parsed.rejections.collect()}
    assert {x[1:] for x in got if x[0] == "invalid"} == {(2, 3, "invalid_number"), (3, 2, "invalid_number"), (3, 4, "invalid_number")}
    assert {x[1:] for x in got if x[0] == "long"} == {
        (4, 6, "invalid_number"), (5, None, "duplicate_row"), (6, 1, "invalid_date"), (7, 8, "missing_cost"), (8, None, "field_count_mismatch")}


def test_quoted_fields_and_line_numbers(parsed):
    rows = {r.line: r.service for r in parsed.records.where("export_id = 'quoted'").collect()}
    assert rows == {3: 'multi line "x"', 5: 'plain "quote', 6: "ab"}


def test_long_records(parsed):
    rows = {r.line: r for r in parsed.records.where("export_id = 'long'").collect()}
    assert (rows[2].account, rows[2].tag, rows[2].currency, rows[2].quantity, rows[2].unit) == ("prod", "Core", "USD", Decimal(10), "Hrs")
    assert rows[3].tag == "(blank)" and rows[3].unallocated and not rows[2].unallocated
    assert rows[4].quantity is None and rows[4].cost == 7


def test_issues(parsed):
    codes = _codes(parsed.issues)
    assert codes["mismatch"] == {"totals_do_not_reconcile"}
    assert {"duplicate_rows", "conflicting_duplicate_periods", "rows_rejected"} == codes["duplicate"]
    assert {"mixed_currencies", "credits_present"} == codes["mixed"]
    assert "conflicting_duplicate_keys" in codes["long"] and "decimal_comma" in codes["semicolon"]
    assert codes["assumed"] == {"date_format_assumed", "currency_unknown"} and "date_format_assumed" not in codes["slashes"]
    assert "wide" not in codes


def test_fatal_files_never_fail_the_batch(parsed):
    codes = {k: v for k, v in _codes(parsed.fatal).items()}
    assert codes == {k: {v} for k, v in {
        "empty": "empty_file", "header": "no_data_rows", "prose": "not_delimited", "nocost": "missing_required_columns",
        "layout": "unsupported_layout", "rows": "no_valid_rows", "binary": "binary_content", "latin": "not_utf8",
        "huge": "malformed_csv", "many": "too_many_columns"}.items()}


def test_slash_order_comes_from_the_whole_column(parsed):
    days = sorted(r.period_start for r in parsed.records.where("export_id = 'slashes'").collect())
    assert days == [date(2026, 6, 13), date(2026, 7, 1)]


def test_spread_gives_the_same_lines(export_files, parsed):
    spread = ParsedExports(export_files(FILES), spread=5).lines
    cols = ["export_id", "kind", "line", "signature", "period_start"]
    assert spread.select(cols).exceptAll(parsed.lines.select(cols)).isEmpty()
    assert parsed.lines.select(cols).exceptAll(spread.select(cols)).isEmpty()


def test_line_numbers_across_blocks(export_files):
    body = "".join(f'2026-06-{1 + n % 30:02d},"s{n}\nx",{n}\n' if n % 700 == 3 else f"2026-06-{1 + n % 30:02d},s{n},{n}\n" for n in range(3000))
    got = ParsedExports(export_files({"big": "Date,Service,Cost\n" + body})).records.select("line", "cost").collect()
    expected, line = {}, 1
    for n in range(3000):
        line += 2 if n % 700 == 3 else 1
        expected[n] = line
    assert {int(r.cost): r.line for r in got} == expected


def test_screening(export_files):
    files = {"ok": "a,b\n", "zip": b"PK\x03\x04x", "nul": b"a,\x00b", "bad": b"a,\xc3(", "prose": "no delimiter\na,b", "none": b""}
    got = {r.export_id: r.reject_code for r in screen(export_files(files)).collect()}
    assert got == {"ok": None, "zip": "binary_signature", "nul": "nul_bytes", "bad": "not_utf8", "prose": "not_delimited_text", "none": "empty"}
