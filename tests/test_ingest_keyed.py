"""Arriving exports kept in buckets: large files, replays, a changed parser, erasing and coming back."""

from __future__ import annotations

from datetime import date

from tallyframe.schema import MAX_FILE_BYTES
from tallyframe.sources.keyed import KeyedStore
from tallyframe.streaming import ingest

TEXT = "Date,Service,Cost\n2026-06-01,EC2,5000\n2026-07-01,EC2,9000\n"
TODAY = date(2026, 9, 18)


def test_large_files_replays_and_erasing(spark, tmp_path, monkeypatch):
    landing, out, ck = tmp_path / "landing" / "tenant_id=acme", str(tmp_path / "out"), str(tmp_path / "ck")
    landing.mkdir(parents=True)
    (landing / "a.csv").write_text(TEXT)
    (landing / "bad.csv").write_text("prose without columns\nmore\n")
    row = '2026-07-01,"EC2\nlarge",1,' + "x" * 9000 + "\n"
    n = MAX_FILE_BYTES // len(row) + 50
    (landing / "large.csv").write_text("Date,Service,Cost,Note\n" + "2026-06-01,EC2,1,\n" + row * n)
    assert (landing / "large.csv").stat().st_size > MAX_FILE_BYTES
    store = KeyedStore(spark, out)

    def run():
        query = ingest.ingest_stream(spark, str(tmp_path / "landing"), out, ck, TODAY, keyed=True, split_large=True)
        query.awaitTermination(600)
        assert query.exception() is None

    run()
    runs = {r.export_id: r.status for r in store.table("run").read().collect()}
    assert sorted(runs.values()) == ["completed", "completed", "failed"]
    counts = {r.export_id: r["count"] for r in store.table("record").read().groupBy("export_id").count().collect()}
    assert sorted(counts.values()) == [2, 2]  # equal rows of the large file are duplicates
    rejected = store.table("rejection").read().where("reason = 'duplicate_row'")
    assert rejected.count() == n - 1 and rejected.agg({"line": "max"}).first()[0] == 2 + 2 * n
    # The batch again, as after a failure between its tables and the checkpoint: nothing changes.
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "landing")).select("path", "length", "modificationTime")
    ingest.ingest_batch(files, out, TODAY, "ingest-0", split_large=True)
    assert {r.export_id: r.status for r in store.table("run").read().collect()} == runs
    # Known exports are left alone, until the parser changes.
    seen = []
    monkeypatch.setattr(ingest, "analyse_files", lambda new, *a, **k: seen.append(new.count()) or {"run": store.table("run").read().limit(0)})
    ingest.ingest_batch(files.where("path like '%a.csv'"), out, TODAY, "ingest-1", split_large=True)
    monkeypatch.setattr(ingest, "PARSER_VERSION", "another")
    ingest.ingest_batch(files.where("path like '%a.csv'"), out, TODAY, "ingest-2", split_large=True)
    assert seen == [0, 1]


def test_files_are_checked_against_their_uploads(spark, tmp_path):
    landing, out = tmp_path / "landing" / "tenant_id=acme", str(tmp_path / "out")
    landing.mkdir(parents=True)
    for name, k in (("good", 1), ("changed", 2), ("deleted", 3), ("stray", 4)):
        (landing / f"{name}.csv").write_text(TEXT.replace("9000", f"900{k}"))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path / "landing"))
    source = files.where("path NOT LIKE '%stray%'").selectExpr("'acme' AS tenant_id", "path", "if(path LIKE '%changed%', 'x', sha2(content, 256)) AS sha256",
                                                               "if(path LIKE '%deleted%', timestamp'2026-01-01', null) AS raw_deleted_at")
    ingest.ingest_batch(files.select("path", "length", "modificationTime"), out, TODAY, "b0", source_file=source)
    store = KeyedStore(spark, out)
    codes = {r.code for r in store.table("issue").read().where("severity = 'error'").collect()}
    assert codes == {"integrity_mismatch", "raw_file_deleted"}
    assert sorted(r.status for r in store.table("run").read().collect()) == ["completed", "failed", "failed"]
    assert store.table("record").read().count() == 2
