"""Funnels over slices against a walk over each subject's events."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from tallyframe.operators.funnel import compose, funnel, slice_states

STEPS = ["a", "b", "a", "c"]
SCHEMA = "user_id long, event_type string, ts timestamp, slice int"


@pytest.fixture(scope="module")
def events():
    rng, start = random.Random(3), datetime(2026, 1, 1)
    rows = [(rng.randrange(30), rng.choice("abcd"), start + timedelta(minutes=rng.randrange(600)), 0) for _ in range(900)]
    return rows + rows[:50] + [(None, "a", start, 0), (1, None, start, 0), (1, "a", None, 0), (99, "b", start, 0)]


def by_hand(events):
    out = {}
    for user in {e[0] for e in events if e[0] is not None}:
        times = []
        for at, kind in sorted({(t, k) for u, k, t, _ in events if u == user and k in STEPS and t is not None}):
            if len(times) < len(STEPS) and kind == STEPS[len(times)] and (not times or at > times[-1]):
                times.append(at)
        if any(u == user and k in STEPS and t is not None for u, k, t, _ in events):
            out[user] = times
    return out


@pytest.mark.parametrize("seconds", [60, 3600, 10 ** 9])
def test_slices_of_any_length_give_one_result(spark, events, seconds):
    df = spark.createDataFrame(events, SCHEMA)
    want = by_hand(events)
    assert {r.subject: list(r.times) for r in compose(slice_states(df, STEPS, seconds=seconds)).collect()} == want
    got = [tuple(r) for r in funnel(slice_states(df, STEPS, seconds=seconds), STEPS).orderBy("position").collect()]
    reach = [sum(len(t) > k for t in want.values()) for k in range(4)]
    assert [g[2] for g in got] == reach and [g[3] for g in got] == [reach[0], *reach[:3]] and 0 < reach[3] < reach[0]


def test_slices_of_separate_runs_merge(spark, events):
    df = spark.createDataFrame(events, SCHEMA)
    noon = datetime(2026, 1, 1, 5)
    apart = slice_states(df.where(df.ts < noon), STEPS).unionByName(slice_states(df.where(df.ts >= noon), STEPS))
    assert {r.subject: list(r.times) for r in compose(apart).collect()} == by_hand(events)


def test_no_events(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert [tuple(r) for r in funnel(slice_states(none, STEPS), STEPS).orderBy("position").collect()] == [(k + 1, s, 0, 0, 0) for k, s in enumerate(STEPS)]
