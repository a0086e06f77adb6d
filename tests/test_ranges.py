"""Files read in ranges of lines against the same files parsed in one piece."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tallyframe.plans.ingest import ParsedExports
from tallyframe.schema import MAX_FIELD_CHARS
from tallyframe.sources import delimited, ranges
from tallyframe.sources.exports import parse_large, parse_lines
from tallyframe.sources.landing import read_landing

LONG = "Date,Service,Linked Account Name,Unblended Cost,Usage Quantity,Usage Unit,Team\n"


def long_text(rng: random.Random, n: int, end: str = "\n") -> str:
    rows = []
    for k in range(n):
        service = rng.choice(['EC2', '"Amazon, S3"', '"two\nlines"', '"cr\r\nlf ""q"""', 'stray"quote', '""', '"a\n\n\nb"', '"x"tail'])
        rows.append(f"2026-{rng.randint(1, 8):02d}-{rng.randint(1, 28):02d},{service},acct {k % 3},{rng.choice(['1.5', '', 'N/A', '12'])},{k},Hrs,t{k % 4}")
    return LONG + end.join(rows) + rng.choice(["", end])


@pytest.fixture(scope="module")
def landing(tmp_path_factory):
    rng = random.Random(4)
    base = tmp_path_factory.mktemp("land")
    (base / "tenant_id=a b").mkdir()
    files = {f"long {i}+[x]%.csv": long_text(rng, 60, rng.choice(["\n", "\r\n", "\n", "\r"])).encode() for i in range(6)}
    wide = "Service,EC2($),S3($),Total costs($)\r\nService total,3,4,7\r\n" + "".join(f"{d:02d}/0{m}/2026,1,{m},{m + 1}\r\n" for m in range(1, 8) for d in (1, 15))
    files |= {
        "wide.csv": b"\xef\xbb\xbf" + wide.encode(), "wide;.csv": wide.replace(",", ";").encode(), "tabs.tsv": LONG.replace(",", "\t").encode() + b'2026-01-01\t"a\tb\n"\tc\t1\t2\tHrs\tx\n',
        "unclosed.csv": LONG.encode() + b'2026-01-01,EC2,a,1,1,Hrs,x\n2026-01-02,"EC2,a\nmore,lines\n', "empty.csv": b"", "blank.csv": b" \n\t\n", "header.csv": LONG.encode(),
        "nul.csv": LONG.encode() + b"2026-01-01,E\x00C2,a,1,1,Hrs,x\n", "latin.csv": LONG.encode() + "2026-01-01,é,a,1,1,Hrs,x\n".encode("latin-1"), "prose.txt": b"prose without columns\nmore\n",
        "field.csv": LONG.encode() + b"2026-01-01," + b"y" * (MAX_FIELD_CHARS + 1) + b",a,1,1,Hrs,x\n", "columns.csv": LONG.encode() + b"1," * 1200 + b"\n",
        "order.csv": b"Date,Service,Cost\n" + b"".join(f"{d}/3/2026,EC2,{d}\n".encode() for d in range(1, 28)), "gap.csv": b"\n\n  \n" + LONG.encode() + b"\n2026-01-01,EC2,a,1,1,Hrs,x\n\n",
    }
    for name, body in files.items():
        (base / "tenant_id=a b" / name).write_bytes(body)
    return base


@pytest.fixture()
def small_ranges(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def in_ranges(spark, landing):
    found = read_landing(spark, str(landing))
    paths = [r.path for r in found.select("path").collect()]
    return found, ranges.physical_lines(spark, paths)


def rows_of(df):
    names = sorted(c for c in df.columns if c != "export_id")
    return sorted(str([r[n] for n in names]) for r in df.collect())


def test_ranges_give_the_rows_of_files_in_one_piece(spark, landing, small_ranges):
    files, lines = in_ranges(spark, landing)
    assert lines.select("path", "block").distinct().count() > 60
    one, many = rows_of(parse_lines(files)), rows_of(parse_large(lines))
    assert len(one) > 400 and one == many


def test_states_of_lines(spark, small_ranges, tmp_path):
    """Every line's state, number and record start against a walk over the characters."""
    rng = random.Random(9)
    text = "".join(rng.choice(['a', 'b', ',', '"', '""', '\n', '\n', '","', '"\n']) for _ in range(3000))
    (tmp_path / "x.csv").write_text(text)
    want, inside, start, field_start = [], False, 1, True
    for n, line in enumerate(text.split("\n")[:-1] if text.endswith("\n") else text.split("\n"), 1):
        if not inside:
            start, field_start = n, True
        want.append((n, inside, start))
        k = 0
        while k < len(line):
            if inside and line[k] == '"':
                if line[k + 1:k + 2] == '"':
                    k += 1
                else:
                    inside = False
            elif not inside and line[k] == '"' and field_start:
                inside = True
            field_start = not inside and line[k] == ","
            k += 1
    got = ranges.with_states(ranges.physical_lines(spark, [f"{tmp_path}/x.csv"]), F.lit(","))
    assert [tuple(r) for r in got.select("line", "inside", "start").orderBy("line").collect()] == want
    assert got.select("block").distinct().count() > 10


def test_profile_from_all_lines(spark, small_ranges, tmp_path):
    """Where the first lines mislead, all lines decide; on others both agree."""
    misleading = "a;b;c,d\n" * 60 + 'x,"y\n,",z,w\n' * 500
    (tmp_path / "m.csv").write_text(misleading)
    (tmp_path / "p.csv").write_text("a|b|c\n1|2|3\n")
    (tmp_path / "n.csv").write_text("nothing\nhere\n")
    lines = ranges.physical_lines(spark, [f"{tmp_path}/{f}.csv" for f in "mpn"])
    name = lambda df: {r.path[-5]: (r.lines, r.delimiter) for r in df.collect()}
    assert name(ranges.sampled_delimiter(lines))["m"] == (50, ";")
    whole = name(ranges.profiled_delimiter(lines))
    assert whole["m"] == (500, ",") and whole["p"] == (2, "|") and whole["n"][0] == 0
    widths = {(r["rank"], r.width): (r.n, r.seen) for r in ranges.width_histogram(lines).where("path like '%m.csv'").collect()}
    assert widths == {(0, 2): (60, 1), (0, 4): (500, 62), (1, 3): (60, 1), (1, 1): (1000, 61), (2, 1): (1060, 1), (3, 1): (1060, 1)}


def test_large_files_are_analysed_like_small_ones(spark, landing, small_ranges):
    files, lines = in_ranges(spark, landing)
    one, many = ParsedExports(files), ParsedExports(files.limit(0), large=lines)
    for table in ("records", "issues", "profile"):
        assert rows_of(getattr(one, table)) == rows_of(getattr(many, table)), table


def test_no_files(spark):
    assert parse_large(ranges.physical_lines(spark, [])).count() == 0


def test_a_record_too_long_is_not_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ranges, "MAX_RECORD", 1000)
    (tmp_path / "u.csv").write_text(LONG + '2026-01-01,"open,a,1,1,Hrs,x\n' + "2026-01-02,EC2,a,1,1,Hrs,x\n" * 200)
    rows = parse_large(ranges.physical_lines(spark, [f"{tmp_path}/u.csv"])).collect()
    assert [(r.kind, r.fatal_code) for r in rows] == [("file", "malformed_csv")]
    assert delimited.SAMPLE_LINES == 50
