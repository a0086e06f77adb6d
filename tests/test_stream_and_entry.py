from __future__ import annotations

import tempfile
from datetime import date
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tallyframe.plans.queries import QUERIES
from tallyframe.schema import MAX_FILE_BYTES
from tallyframe.sources.landing import read_landing, verify_hash
from tallyframe.sources.sinks import read_table
from tallyframe.streaming.ingest import ingest_stream

SMALL = "/root/testdata/sf0.001"


def test_stream_ingests_once_and_reruns_cleanly(spark):
    base = Path(tempfile.mkdtemp(prefix="run-"))
    landing, out, ck = base / "landing" / "tenant_id=acme", str(base / "out"), str(base / "ck")
    landing.mkdir(parents=True)
    text = "Date,Service,Cost\n2026-06-01,EC2,5000\n2026-07-01,EC2,9000\n"
    (landing / "a.csv").write_text(text)
    (landing / "copy.csv").write_text(text)
    (landing / "bad.csv").write_text("prose without columns\nmore\n")
    (landing / "odd [1]{2}.csv").write_text(text + "".join(f"2026-07-0{d % 9 + 1},EC2,no{d}\n" for d in range(70)))
    with (landing / "large.csv").open("w") as f:
        f.truncate(MAX_FILE_BYTES + 1)

    def run():
        query = ingest_stream(spark, str(base / "landing"), out, ck, date(2026, 9, 18))
        query.awaitTermination(300)
        assert query.exception() is None
        return {n: read_table(spark, out, n) for n in ("run", "finding", "record", "issue", "rejection", "rejection_sample")}

    tables = run()
    assert {(r.tenant_id, r.status) for r in tables["run"].collect()} == {("acme", "completed"), ("acme", "failed")}
    assert tables["run"].count() == 4 and tables["finding"].count() == 2 and tables["record"].count() == 4
    large = tables["issue"].where("code = 'file_too_large'").collect()
    assert len(large) == 1 and "large.csv" in large[0].detail
    assert tables["run"].where(f"export_id = '{large[0].export_id}'").first().status == "failed"
    assert tables["rejection"].count() == 70 and tables["rejection_sample"].count() == 50
    (landing / "b.csv").write_text(text.replace("9000", "9500"))
    tables = run()
    assert tables["run"].count() == 5 and tables["finding"].count() == 3
    files = read_landing(spark, str(base / "landing"))
    recorded = files.selectExpr("tenant_id", "path", "if(path like '%bad%', 'x', export_id) as sha256", "cast(null as timestamp) as raw_deleted_at")
    ok, issues = verify_hash(files, recorded)
    assert ok.count() == 4 and [r.code for r in issues.collect()] == ["integrity_mismatch"]


def test_entry_has_findings(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_every_query_has_stable_columns(spark, name):
    assert entry.queries()[name](spark, SMALL).columns
    assert name in entry.oracle_sql() or name == "parse_documents"
