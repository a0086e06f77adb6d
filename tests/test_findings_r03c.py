"""Findings of the third review, third part: files that cost much to judge are dealt over the cores."""
from __future__ import annotations

from pyspark.sql import functions as F

from tallyframe.plans import queries
from tallyframe.plans.ingest import ParsedExports
from tallyframe.sources import delimited

SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", None]


def test_fatal_files_of_one_split_go_to_all_cores(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, SEGMENTS[k % 6]) for k in range(240)], "c_custkey bigint, c_mktsegment string").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    seen = []
    monkeypatch.setattr(queries, "ParsedExports", lambda files: seen.append(files) or ParsedExports(files))
    got = {r.c_custkey: r.code for r in queries.fatal_files(spark, str(tmp_path)).collect()}
    per_task = [n for n in seen[0].select("export_id").rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert len(per_task) >= spark.sparkContext.defaultParallelism and max(per_task) < 60
    assert sorted(k for k in got if k % 6 != 5) == [k for k in range(240) if k % 6 != 5] and {got[k] for k in range(0, 240, 6)} == {"missing_required_columns"}
    assert {got[2], got[3], got[4]} == {"unsupported_layout", "no_valid_rows", "no_data_rows"}


def _line(k: int, text: str = "EC2, x") -> str:
    return f'2026-06-01,"{text}","${k}.50"'


def test_records_of_one_pass_store_no_rows(export_files):
    lines = "Date,Service,Cost\n" + "\n".join([_line(1), _line(2), _line(1), "bad,EC2,1", "2026-06-02,S3,n/a"])
    files = {"long": lines + "\n", "wide": "Service,EC2($)\n2026-06-01,4\n2026-06-01,4\n2026-07-01,5\n"}
    once, stored = ParsedExports(export_files(files)), ParsedExports(export_files(files))
    got = once.records_once
    assert "rows" not in vars(once)
    plan = got.select("service", "cost")._jdf.queryExecution().optimizedPlan().toString()
    assert "availability_zone" not in plan.split("Relation")[0] and "period_end" not in plan.split("Relation")[0]
    assert stored.rows.count() == 8 and sorted(map(str, got.collect())) == sorted(map(str, stored.records_once.collect()))
    assert {(r.export_id, r.line, float(r.cost)) for r in got.collect()} == {("long", 2, 1.5), ("long", 3, 2.5), ("wide", 2, 4.0), ("wide", 4, 5.0)}


def test_blocks_of_plain_lines_are_cut_at_line_ends(spark, export_files):
    """A full block with as many line ends as records is plain; the last block never is taken for one."""
    header = "Date,Service,Cost\n"
    files = {
        "plain": header + "".join(_line(k) + "\n" for k in range(2500)),
        "crlf": (header + "".join(_line(k) + "\n" for k in range(2500))).replace("\n", "\r\n"),
        "blank": header + "".join(_line(k) + ("\n\n" if k == 700 else "\n") for k in range(2500)),
        # The second block holds a line end in quotes, the last one as many line ends as a full block.
        "inner": header + "".join(_line(k, "a\nb" if k == 1500 or 2060 <= k < 2260 else "a,b") + "\n" for k in range(2871)),
    }
    got = {(r.export_id, r.cost): (r.line, r.service) for r in ParsedExports(export_files(files)).records.collect()}
    want = {}
    for name in files:
        before = 1
        for k in range(2871 if name == "inner" else 2500):
            inside = name == "inner" and (k == 1500 or 2060 <= k < 2260)
            before += 2 if inside else 1
            want[name, k] = (before, "EC2, x" if name != "inner" else "a b" if inside else "a,b")
            before += 1 if name == "blank" and k == 700 else 0
    assert {(n, int(c)): v for (n, c), v in got.items()} == want
    blocks = spark.createDataFrame([("a\n" * 3000,)], "t string").select(delimited.blocks_of(F.col("t"), F.lit(",")).alias("b"))
    assert [b.plain for b in blocks.select(delimited.numbered_blocks(F.col("b")).alias("n")).head().n] == [True, True, False]


def test_marks_of_a_file_found_anywhere_in_it(export_files):
    files = {"space": " \t\r\n\x0b\x0c\n", "long": "Date,Service,Cost\n" + "2026-06-01,EC2,1\n" * 40 + "2026-06-01," + "x" * 10_001 + ",1\n",
             "edge": "Date,Service,Cost\n2026-06-01," + "x" * 985 + ",1\n" + "2026-06-01,y,2\n",
             "slash": "Date,Service,Cost\n" + "2026-06-01,a/b,n/a\n" * 30 + "13/06/2026,EC2,3\n", "many": "Date,Service,Cost\n2026-06-01,EC2,1\n" + "," * 1000 + "\n"}
    facts = {r.export_id: (r.fatal_code, r.slash_order) for r in ParsedExports(export_files(files)).lines.where("kind = 'file'").collect()}
    assert facts == {"space": ("empty_file", "mdy"), "long": ("malformed_csv", "mdy"), "edge": (None, "mdy"), "slash": (None, "dmy"), "many": ("too_many_columns", "mdy")}
