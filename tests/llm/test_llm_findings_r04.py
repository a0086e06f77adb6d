"""Findings of the fourth review: op1 sorts only texts with windows that could be repeated."""
from __future__ import annotations

import random

import numpy as np
import pytest

from tallyframe.llm import suffix_dedup


def _texts(seed: int) -> list[bytes]:
    r = random.Random(seed)
    some = lambda n: bytes(r.choice(b"ab \xc3\x00") for _ in range(n))
    passages = [some(160) for _ in range(3)]
    return [some(r.randrange(0, 40)) + r.choice(passages)[r.randrange(30):] + some(r.randrange(30)) for _ in range(20)] + [some(150) for _ in range(40)]


def _brute(texts: list[bytes], place: list[int]) -> set[tuple[int, int]]:
    seen: dict[bytes, list] = {}
    for i, t in enumerate(texts):
        for w in range(len(t) - 99):
            seen.setdefault(t[w:w + 100], []).append((place[i] + w, i, w))
    return {(i, w) for found in seen.values() for p, i, w in found if p > min(found)[0]}


@pytest.mark.parametrize("collide", [False, True])
def test_only_windows_that_could_be_repeated_are_sorted(monkeypatch, collide):
    if collide:  # a hash that tells nothing must change no result
        monkeypatch.setattr(suffix_dedup, "_hashes", lambda data, length: np.zeros(len(data) - length + 1, np.uint64))
    sorted_bytes = []
    inner = suffix_dedup._transformed
    monkeypatch.setattr(suffix_dedup, "_transformed", lambda texts, *rest: sorted_bytes.append(sum(map(len, texts))) or inner(texts, *rest))
    for seed in range(4):
        texts = [t for t in _texts(seed) if len(t) >= 100]
        place = random.Random(seed).sample(range(0, 100_000, 1000), len(texts))
        text, window = suffix_dedup.repeated(texts, np.array([len(t) - 99 for t in texts]), np.array(place))
        assert set(zip(text.tolist(), window.tolist(), strict=True)) == _brute(texts, place) != set()
        assert len(text) == len(set(zip(text.tolist(), window.tolist(), strict=True))) and (np.diff(text) >= 0).all()
        assert (sorted_bytes.pop() == sum(map(len, texts))) is collide
    none = [bytes(random.Random(k).randbytes(200)) for k in range(5)]
    assert len(suffix_dedup.repeated(none, np.full(5, 101), np.arange(5) * 1000)[0]) == 0


def test_hashes_are_equal_where_bytes_are():
    data = np.frombuffer(random.Random(3).randbytes(50) * 6 + b"x" * 130, np.uint8)
    body = data.tobytes()
    for length in (1, 4, 99, 100, 101, 128):
        found = suffix_dedup._hashes(data, length).tolist()
        by_bytes = {}
        for i, h in enumerate(found):
            by_bytes.setdefault(body[i:i + length], set()).add(h)
        assert len(found) == len(data) - length + 1 and all(len(h) == 1 for h in by_bytes.values()) and len(set(found)) == len(by_bytes)
