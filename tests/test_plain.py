"""Plain long exports parsed column by column: the same rows as the general way gives, and rows that met within their file."""
from __future__ import annotations

import random

from tallyframe.operators import records
from tallyframe.plans.ingest import ParsedExports
from tallyframe.schema import KEYS
from tallyframe.sources import plain
from tallyframe.sources.exports import parse_lines, parse_plain

HEADER = "Date,Service,Linked Account Name,Unblended Cost,Currency,Usage Quantity,Usage Unit,Team,End Date,Is Partial Period"
DATES = ["2026-06-01", " 2026-06-02 ", "2026-06-03T10:00:00Z", "2026-06", "2026-02-30", "0000-01-01", "bad", "", "2026-06-04 junk", "2026-06 11:00", "2026-6-1"]
COSTS = ["1", "1.0", "$4.50", '"$1,234.50"', '"-$1,000"', "(3.5)", "($2)", "(-2)", "(-0.0)", "-$ 3", "$ -3", "- 3", "1e3", "1E-20", "1e12", "1000000000001", "1e15",
         '"12,34"', '"1,234,567.891"', "", " ", "N/A", "()", "( 7 )", "+.5", "5.", ".", "1.0000000000000005", "0.12345678901234567", "$", "$$1", "1 2", '"1,000.5e2"', "--1", "(((1)))"]
QUANTITIES = ["1", "1e22", "1e21", "", "oops", "-4", '"1,000"', "$1", "(1)", "1e25", "0.5"]
LABELS = ["EC2", " EC2", '"EC2, x"', '"say ""hi"""', "", "No tag key: team", "others", "OTHER", "n/a", "none given", "(none)", '"two words"tail', 'in"side', "not tagged", "Untagged ", "(blank)"]


def _text(seed: int, n: int, ends: str = "\n") -> str:
    r = random.Random(seed)
    few = lambda xs: r.choice(xs) if r.random() < 0.3 else xs[0]
    rows = []
    for _ in range(n):
        row = [few(DATES), few(LABELS), few(LABELS), r.choice(COSTS), few(["usd", "USD ", "", "eur"]), r.choice(QUANTITIES), few(["Hrs", " GB", ""]), r.choice(LABELS), few(["2026-06-30", "x", ""]),
               few(["false", " TRUE", "y", ""])]
        rows.append(",".join(row[:r.choice([3, 9, 10, 10, 10, 10, 10, 10])] + ["more"] * (r.random() < 0.05)))
        if r.random() < 0.1:
            rows.append(r.choice(["", "   ", ",,,,,,,,,", rows[-1], rows[-1].replace(",", ", "), '2026-06-05,"a\nb",x,3,usd,1,Hrs,t,,']))
    return HEADER + "\n" + ends.join(rows) + ends


FILES = {**{f"plain{i}": _text(i, 400) for i in range(3)}, "no end": _text(9, 60).rstrip("\n"), "windows": _text(5, 60, "\r\n"), "accents": _text(6, 60) + "2026-06-01,Büro,,1,usd,1,Hrs,,,\n",
         "semicolon": "Date;Service;Cost\n2026-06-01;EC2;1,50\n2026-06-01;EC2;1.234,5\n2026-06-01;\"a;b\";-12,5\n2026-06-01;EC2;1,50\n", "marked": "Date,Service,Cost ($)\n2026-06-01,EC2,4\n",
         "slashes": "Date,Service,Cost\n13/06/2026,EC2,4\n01/06/2026,EC2,5\n", "open": 'Date,Service,Cost\n2026-06-01,EC2,4\n2026-06-01,"EC2,4\n', "quotes": 'Date,Service,Cost\n"",""," "\n2026-06-01,EC2,4\n',
         "wide": "Service,EC2($)\n2026-06-01,4\n2026-06-01,4\n", "late": "\n" * 260 + "Date,Service,Cost\n2026-06-01,EC2,4\n", "long": "Date,Service,Cost\n2026-06-01," + "x" * 10_001 + ",4\n",
         "fatal": "  \n", "binary": b"a,\x00b", "head": "Date,Service,Cost\n", "parts": "Date,Service,Cost\n" + "".join(f"2026-06-{1 + k % 28:02d},s{k % 900},{k % 7}\n" for k in range(40_000)),
         "cut": '\n"Date",Service,Cost\n' + '2026-06-01,"x\n\ny",1\n' * 300}


def _rows(df, *columns: str) -> list:
    return sorted(map(str, df.select(*columns).collect() if columns else df.collect()))


def test_rows_are_those_of_the_general_way(export_files):
    files = export_files(FILES)
    general, got = parse_lines(files), parse_plain(files)
    columns = [c for c in got.columns if c not in ("earlier", "differs", "content")]
    assert general.columns == columns and [f.dataType.simpleString() for f in general.schema] == [got.schema[c].dataType.simpleString() for c in columns]
    other = {r.export_id: bytes(r.content) for r in got.where("kind = 'other'").collect()}
    assert set(other) == {"windows", "accents", "slashes", "open", "quotes", "wide", "late", "long", "fatal", "binary", "head"}
    assert all(other[k] == (FILES[k] if isinstance(FILES[k], bytes) else FILES[k].encode()) for k in other)
    assert _rows(got.where("kind <> 'other'"), *columns) == _rows(general.where(~general["export_id"].isin(list(other))), *columns)


def test_exports_are_judged_as_the_general_way_does(export_files):
    plain_way, general = ParsedExports(export_files(FILES)), ParsedExports(export_files(FILES), spread=3)
    for table in ("rejections", "issues"):
        assert _rows(getattr(plain_way, table), *getattr(general, table).columns) == _rows(getattr(general, table)) != [], table
    assert "_whole" not in vars(plain_way) and "service" not in plain_way._judging[0].columns
    conflicts = records.differing(records.judged(records.classify_settled(plain_way._judging[0])))
    assert _rows(conflicts) == [r for r in _rows(records.conflicting_costs(records.keyed_costs(general.lines))) if "plain" in r or "no end" in r or "parts" in r or "semicolon" in r]
    assert _rows(plain_way.records_once) == _rows(general.records_once)


def test_judging_plain_rows_moves_none_of_them(export_files):
    parsed = ParsedExports(export_files({k: FILES[k] for k in ("plain0", "plain1", "marked")}))
    plan = parsed.rejections._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan and parsed._judging[1] is None


def test_an_export_of_several_files(spark, export_files):
    one = "Date,Service,Cost\n2026-06-01,EC2,4\n2026-06-01,EC2,5\n"
    two = "Date,Service,Cost\n2026-06-02,EC2,4\n2026-06-01,EC2,4\n2026-06-01,EC2,5\n"
    rows = [("t", "a", "a1", one), ("t", "a", "a2", two), ("t", "b", "b1", one), ("t", "b", "b2", one + "2026-06-01,Büro,1\n"), (None, "c", "c", one + "2026-06-01,EC2,4\n"), ("t", "d", "d", one + "2026-06-01,EC2,4\n"),
            ("t", None, "e", one), ("t", "f", "f", one), ("u", "f", "f", two), ("t", "g", "g", one), ("t", "g", "g", one)]
    files = spark.createDataFrame([(*r[:3], bytearray(r[3].encode())) for r in rows], "tenant_id string, export_id string, path string, content binary")
    parsed, general = ParsedExports(files), ParsedExports(files, spread=2)
    columns = [*KEYS, "line", "reject_reason"]
    assert _rows(parsed.judged, *columns) == _rows(general.judged, *columns)
    assert _rows(parsed.issues) == _rows(general.issues)
    assert {r.export_id for r in parsed._judging[0].collect()} == {"d", "f"}


def test_no_plain_file_and_no_file(export_files):
    assert ParsedExports(export_files({"wide": FILES["wide"]})).records.count() == 1
    assert ParsedExports(export_files({"wide": FILES["wide"]}).limit(0)).rejections.count() == 0


def test_codes_of_many_columns_stay_apart():
    import numpy as np
    n = 5000
    r = np.random.default_rng(1)
    columns = [plain.texts(tuple(map(str, r.integers(0, 3 if k % 2 else 4000, n)))) for k in range(9)]
    rows = list(zip(*(c.tolist() for c, _ in columns), strict=True))
    assert len(set(plain.together(columns, n).tolist())) == len(set(rows))
