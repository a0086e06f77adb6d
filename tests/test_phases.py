"""The second phase as a stream: one result however the events come, against a walk over all of them."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tallyframe.operators.answers import answer_json, validate_answers
from tallyframe.streaming import phases

START = datetime(2026, 9, 1)


def hours(h: float) -> datetime:
    return START + timedelta(hours=h)


@pytest.fixture(scope="module")
def good(spark):
    """Three valid answers as they are stored."""
    rows = spark.createDataFrame([(c,) for c in ("INVESTIGATE", "MONITOR", "ESCALATE")], "c string").selectExpr(
        "named_struct('category', c, 'category_confidence', 0.9D, 'owner', 'data', 'owner_confidence', 0.8D, 'urgency', 'low', 'risk', 'low',"
        " 'primary_missing', 'none', 'evidence_sufficient', 0.5D, 'needs_human_review', 0.1D, 'change_material', 0.9D) AS answer")
    texts = [r.answers for r in rows.select(answer_json(rows.answer).alias("answers")).collect()]
    assert validate_answers(spark.createDataFrame([(t,) for t in texts], "answers string")).where("valid").count() == 3
    return texts


@pytest.fixture(scope="module")
def events(good):
    rng = random.Random(7)
    packets, permissions, calls = [], [], []
    for e in range(12):
        export = f"x{e}"
        for k in range(3):
            packets.append(("t", export, f"ev{k}", f"sha{(e * 3 + k) % 20}", hours(rng.uniform(0, 5))))
        if e % 4 != 3:
            permissions.append(("t", export, rng.choice([None, None, "no_consent"]), hours(rng.uniform(0, 6))))
        if e % 5 == 0:
            permissions.append(("t", export, rng.choice([None, "disabled"]), hours(rng.uniform(6, 9))))
    for s in range(20):
        for _ in range(rng.choice([0, 0, 1, 2, 4])):
            valid = rng.random() < 0.7
            calls.append(("t", f"sha{s}", rng.choice(["qs/1", "qs/1", "qs/2"]), "p", rng.choice(["m1", "m2"]), rng.choice(["succeeded", "succeeded", "failed"]),
                          rng.choice(good) if valid else '{"decision_category":{"type":"choice","choice":"NO"}}', hours(rng.uniform(0, 60))))
    tail = ("t", "later", "ev", "none", hours(900))  # time goes on
    return packets, permissions, calls, tail


def by_hand(packets, permissions, calls, question_set=None, patience=24):
    out = {}
    for tenant, export, evidence, sha, at in packets:
        of = [(p[3], p[2] or "") for p in permissions if p[:2] == (tenant, export)]
        if not of:
            continue
        reason = max(of)[1]
        if reason:
            out[export, evidence] = (None, reason)
            continue
        latest = {}
        for t, s, q, p, m, status, answers, when in calls:
            if (t, s, status) == (tenant, sha, "succeeded") and when <= at + timedelta(hours=patience) and question_set in (None, q):
                latest[q, p, m] = max(latest.get((q, p, m), (datetime.min, "")), (when, answers))
        best = max(((when, asked, a) for asked, (when, a) in latest.items() if '"NO"' not in a), default=None)
        out[export, evidence] = (best[2], None) if best else (None, "retries_exhausted")
    return out


def run(spark, base, rounds, **options):
    """rounds: lists of (kind, rows) written and processed one after another."""
    schema = {"packets": phases.PACKET, "permissions": phases.PERMISSION, "calls": phases.CALL}
    for name, kind in schema.items():
        spark.createDataFrame([], kind).write.mode("append").parquet(f"{base}/{name}")
    for k, some in enumerate(rounds):
        for name, rows in some:
            if rows:
                spark.createDataFrame(rows, schema[name]).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
        phases.second_phase(spark, f"{base}/packets", f"{base}/permissions", f"{base}/calls", f"{base}/out", f"{base}/ck", **options)
    return {(r.export_id, r.evidence_id): (r.answers, r.unavailable_reason) for r in phases.read_outcomes(spark, f"{base}/out").collect()}


def timely(name, rows, until, since=None):
    at = -1
    return name, [r for r in rows if r[at] <= until and (since is None or r[at] > since)]


def test_one_result_however_events_come(spark, events, tmp_path):
    packets, permissions, calls, tail = events
    want = by_hand(packets, permissions, calls)
    assert {w[1] for w in want.values()} >= {None, "no_consent", "retries_exhausted"} and len(want) > 20
    ends = [("packets", [tail]), ("permissions", [("t", "later", None, hours(900))]), ("calls", [("t", "none", "qs/1", "p", "m1", "succeeded", "x", hours(900))])]
    closing = [ends, [("packets", [(*tail[:4], hours(901))]), ("permissions", [("t", "later", None, hours(901))]), ("calls", [("t", "none", "qs/1", "p", "m1", "succeeded", "x", hours(901))])]]
    at_once = run(spark, tmp_path / "a", [[("packets", packets), ("permissions", permissions), ("calls", calls)], *closing], late="100 hours")
    assert {k: v for k, v in at_once.items() if k[0] != "later"} == want
    # In pieces, shuffled, with every event twice: the same outcomes.
    rng = random.Random(1)
    pieces = [[timely("packets", packets, hours(3)), timely("calls", calls, hours(20))],
              [timely("permissions", permissions, hours(99)), timely("packets", packets, hours(99)), timely("calls", calls, hours(99), hours(20))], *closing]
    for piece in pieces:
        for _, rows in piece:
            rows += rows
            rng.shuffle(rows)
    assert run(spark, tmp_path / "b", pieces, late="100 hours") == at_once


def test_findings_take_their_outcomes(spark, good):
    findings = spark.createDataFrame([("t", "x", e) for e in "abc"], "tenant_id string, export_id string, evidence_id string")
    outcome = spark.createDataFrame([("t", "x", "a", "s", good[1], START, None, START), ("t", "x", "b", "s", None, None, "retries_exhausted", START)], phases.OUTCOME)
    got = {r.evidence_id: (r.answer.category if r.answer else None, r.unavailable_reason) for r in phases.answered_findings(findings, outcome).collect()}
    assert got == {"a": ("MONITOR", None), "b": (None, "retries_exhausted"), "c": (None, "awaiting_unlock")}
