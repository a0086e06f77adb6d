"""Keys that look like numbers, packets with several answers, and windows that end within a day."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import answers, portfolio
from tallyframe.sources.landing import NO_TENANT, with_identity
from tallyframe.sources.sinks import read_table, write_table


def test_keys_stay_text(spark, tmp_path):
    rows = [("007", "1e3", 1), ("2026-01-01", "x", 2), (NO_TENANT, "y", 3)]
    write_table(spark.createDataFrame(rows, "tenant_id string, export_id string, n int"), str(tmp_path), "run")
    assert sorted((r.tenant_id, r.export_id, r.n) for r in read_table(spark, str(tmp_path), "run").collect()) == sorted(rows)
    assert read_table(spark, str(tmp_path), "other") is None


def test_unreadable_table_is_an_error(spark, tmp_path):
    (tmp_path / "run").mkdir()
    (tmp_path / "run" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="parquet|Parquet|CANNOT_READ"):
        read_table(spark, str(tmp_path), "run")


def test_files_without_a_tenant_are_nobodys(spark):
    raw = spark.createDataFrame([("/in/a.csv", bytearray(b"x")), ("/in/tenant_id=007/a.csv", bytearray(b"x"))], "path string, content binary")
    raw = raw.withColumns({"length": F.length("content"), "modificationTime": F.current_timestamp()})
    assert sorted(r.tenant_id for r in with_identity(raw).collect()) == ["007", NO_TENANT]


def test_one_answer_for_a_packet(spark):
    rows = [("t", "p", "q1", "a", "m1", 1, "first"), ("t", "p", "q1", "b", "m2", 3, "last"), ("t", "p", "q2", "a", "m1", 2, "other"), ("t", "r", "q1", "a", "m1", 1, "r")]
    valid = spark.createDataFrame(rows, "tenant_id string, packet_sha256 string, question_set_version string, provider string, model_requested string, created_at int, answer string")
    def pick(**wanted):
        return {r.packet_sha256: r.answer for r in answers.one_per_packet(valid, **wanted).collect()}
    assert pick() == {"p": "last", "r": "r"}
    assert pick(provider="a", question_set="q1") == {"p": "first", "r": "r"}
    assert pick(question_set="q2") == {"p": "other"}
    assert answers.one_per_packet(valid).count() == 2


def test_retention_ends_at_the_hour(spark):
    files = spark.createDataFrame(
        [("t", 1, datetime(2026, 5, 2, 1), 9), ("t", 2, datetime(2026, 5, 2, 13), 9), ("t", 3, datetime(2026, 5, 25, 1), None), ("t", 4, datetime(2026, 5, 25, 13), None)],
        "tenant_id string, file_id int, created_at timestamp_ntz, lead_id int").withColumn("raw_deleted_at", F.lit(None).cast("timestamp_ntz"))
    due = portfolio.retention_due(files, F.lit(datetime(2026, 6, 1, 12)), days=30, anonymous_days=7)
    assert sorted(r.file_id for r in due.collect()) == [1, 3]
