"""Keyed tables: merges, replays, erasing, and which files a batch touches."""

from __future__ import annotations

import hashlib
from pathlib import Path

import pytest

from tallyframe.sources.keyed import KeyedStore, KeyedTable

ROWS = "tenant_id string, export_id string, evidence_id string, v int"


def files(path):
    return {str(p.relative_to(path)): hashlib.sha256(p.read_bytes()).hexdigest() for p in Path(path).rglob("*.parquet")}


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture()
def make(spark):
    return lambda data: spark.createDataFrame(data, ROWS)


def test_merge_replaces_scopes_and_touches_their_buckets_only(spark, make, tmp_path):
    table = KeyedTable(spark, str(tmp_path), buckets=16)
    assert table.read() is None
    first = [(f"t{i % 5}", f"x{i}", f"e{j}", i) for i in range(60) for j in range(2)] + [(None, "x", "e", 1)]
    table.merge(make(first), "b0")
    assert rows(table.read()) == sorted(first, key=str)
    before = files(tmp_path)
    table.merge(make([("t1", "x1", "e9", 100), ("t9", "new", "e", 5)]), "b1")
    want = sorted([r for r in first if r[1] != "x1"] + [("t1", "x1", "e9", 100), ("t9", "new", "e", 5)], key=str)
    assert rows(table.read()) == want
    after = files(tmp_path)
    assert len(set(after) - set(before)) <= 2 and all(after[f] == before[f] for f in set(after) & set(before))
    # The last batch again: the same table. An empty batch: the same table.
    table.merge(make([("t1", "x1", "e9", 100), ("t9", "new", "e", 5)]), "b1")
    assert rows(table.read()) == want
    table.merge(make([]), "b2")
    assert rows(KeyedTable(spark, str(tmp_path), buckets=999).read()) == want and KeyedTable(spark, str(tmp_path), buckets=999).buckets == 16
    for i in range(6):
        table.merge(make([("t1", "x1", "e9", i)]), f"c{i}")
    assert len(files(tmp_path)) <= 2 * 16 + 4 and len(list((tmp_path / "_manifest").glob("*.json"))) == 2


def test_a_merge_that_was_not_published_is_not_seen(spark, make, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path), buckets=4)
    table.merge(make([("t", "x", "e", 1)]), "b0")
    with monkeypatch.context() as m:
        m.setattr(table, "_publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.merge(make([("t", "x", "e", 2)]), "b1")
    assert rows(table.read()) == [("t", "x", "e", 1)]
    table.merge(make([("t", "x", "e", 2)]), "b1")
    assert rows(table.read()) == [("t", "x", "e", 2)]


def test_newest_wins_and_replaced_scopes_go(spark, make, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "n"), buckets=4)
    scope = ["tenant_id", "export_id", "evidence_id"]
    table.merge(make([("t", "x", "a", 5), ("t", "x", "a", 3), ("t", "x", "b", 1)]), "b0", scope, ["v"])
    table.merge(make([("t", "x", "a", 4), ("t", "x", "b", 2), ("t", "y", "c", 0)]), "b1", scope, ["v"])
    assert rows(table.read()) == [("t", "x", "a", 5), ("t", "x", "b", 2), ("t", "y", "c", 0)]
    plain = KeyedTable(spark, str(tmp_path / "p"), buckets=4)
    plain.merge(make([("t", "x", "a", 1), ("t", "y", "b", 1)]), "b0")
    plain.merge(make([]), "b1", replaced=make([("t", "y", "", 0)]))
    assert rows(plain.read()) == [("t", "x", "a", 1)]
    assert rows(plain.missing(make([("t", "x", "", 0), ("t", "z", "", 0)]))) == [("t", "z", "", 0)] or rows(plain.missing(make([("t", "z", "", 0)]))) == [("t", "z", "", 0)]
    with pytest.raises(ValueError):
        plain.merge(make([]), "b2", ["tenant_id"])


def test_clashing_column_names(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path), buckets=4)
    df = spark.createDataFrame([("t", "x", 7, 8)], "tenant_id string, export_id string, _bucket int, _row int")
    table.merge(df, "b0", newest=["_row"])
    table.merge(df, "b1", newest=["_row"])
    assert rows(table.read()) == [("t", "x", 7, 8)] and table.read().columns == df.columns


def test_erasing_leaves_other_files_and_the_audit(spark, make, tmp_path):
    store = KeyedStore(spark, str(tmp_path), buckets=32)
    data = make([(f"t{i % 3}", f"x{i}", "e", i) for i in range(40)])
    store.write({"run": data, "finding": data.where("v < 20"), "record": data}, "b0")
    assert rows(store.unknown(make([("t1", "x1", "", 0), ("t1", "x2", "", 0)]).select("tenant_id", "export_id"))) == [("t1", "x2")]
    before = files(tmp_path)
    gone = spark.createDataFrame([("t1", "x1"), ("t2", "x29"), ("t0", "unknown")], "tenant_id string, export_id string")
    store.erase(gone, "erase-1", "2026-09-18")
    for name, n in (("run", 38), ("finding", 19), ("record", 38)):
        assert store.table(name).read().count() == n
    after = files(tmp_path)
    kept = [f for f in before if f in after]
    assert all(before[f] == after[f] for f in kept) and len(kept) >= len(before) - 5
    want = [("t1", "x1", "erased", "2026-09-18"), ("t2", "x29", "erased", "2026-09-18")]
    assert rows(store.table("audit").read()) == want
    store.erase(gone, "erase-2", "2026-09-19")
    assert rows(store.table("audit").read()) == want and store.table("run").read().count() == 38
