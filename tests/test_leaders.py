"""Leader clusters against the plain rule, and how their time grows."""

from __future__ import annotations

import time

import numpy as np
import pytest

from papyra.operators import analytics


def plain(hashes, distance):
    found, out = [], []
    for i, h in enumerate(hashes.tolist()):
        out.append(next((j for j in found if (h ^ int(hashes[j])).bit_count() <= distance), i))
        if out[-1] == i:
            found.append(i)
    return out


def some(rng, kind, n):
    if kind == "random":
        return rng.integers(0, 1 << 64, n, np.uint64)
    if kind == "low bits":  # all agree on most segments
        return rng.integers(0, 1 << 20, n, np.uint64)
    centres = rng.integers(0, 1 << 64, 9, np.uint64)
    flips = np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, 5), np.uint64), 1)
    return rng.choice(centres, n) ^ flips


@pytest.mark.parametrize("kind", ["random", "low bits", "balls"])
@pytest.mark.parametrize("distance", [0, 2, 5])
def test_leaders_are_the_first(monkeypatch, kind, distance):
    hashes = some(np.random.default_rng(1), kind, 300)
    for rows, pairs in ((1024, 1 << 20), (64, 100), (1, 1)):
        monkeypatch.setattr(analytics._Leaders, "ROWS", rows)
        monkeypatch.setattr(analytics._Leaders, "PAIRS", pairs)
        assert analytics.leaders(hashes, distance).tolist() == plain(hashes, distance)
    assert analytics.leaders(hashes[:0], distance).tolist() == []


def test_repeated_hashes(spark):
    rows = [(1, 5, -1), (1, 1, 3), (1, 2, 3), (1, 3, -1), (1, 4, 0), (2, 1, 3)]
    got = {(r.group, r.id): (r.leader, r.distance) for r in analytics.leader_clusters(spark.createDataFrame(rows, "group long, id long, hash long")).collect()}
    assert got == {(1, 1): (1, 0), (1, 2): (1, 0), (1, 3): (3, 0), (1, 4): (1, 2), (1, 5): (3, 0), (2, 1): (1, 0)}


def test_time_does_not_follow_the_square():
    """60,000 hashes that all lead: one by one over all leaders, 1.8 billion comparisons."""
    hashes = some(np.random.default_rng(2), "random", 60_000)
    began = time.process_time()
    assert (analytics.leaders(hashes, 5) == np.arange(60_000)).mean() > 0.999
    assert time.process_time() - began < 60
