"""Tables that Spark sizes too low are not broadcast."""

from __future__ import annotations

import random

from papyra.llm import resemblance, simhash


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_keys_of_fingerprints(spark, tmp_path):
    """35 keys a fingerprint: a table that may be broadcast by its file need not fit the driver with its keys."""
    rng = random.Random(5)
    one = [rng.randrange(-(1 << 62), 1 << 62) for _ in range(500)]
    spark.createDataFrame([(f,) for f in {x for f in one for x in (f, f ^ 1)}], "fp long").write.parquet(f"{tmp_path}/fps")
    got = simhash.edges(spark.read.parquet(f"{tmp_path}/fps"))
    assert "BroadcastExchange" not in plan(got) and "SortMergeJoin" in plan(got)
    assert {(r.a, r.b) for r in got.collect()} >= {(min(f, f ^ 1), max(f, f ^ 1)) for f in one}


def test_maps_of_sets(spark, tmp_path):
    sets = [(i, 100, resemblance.parity(resemblance.members(f"some words {i // 2} " * 9))) for i in range(20)]
    spark.createDataFrame(sets, "node long, n long, map binary").write.parquet(f"{tmp_path}/maps")
    pairs = spark.createDataFrame([(i, i + 1) for i in range(0, 20, 2)], "a long, b long")
    got = resemblance.screened(pairs, spark.read.parquet(f"{tmp_path}/maps"))
    assert "BroadcastExchange" not in plan(got)
    assert got.count() == 10
