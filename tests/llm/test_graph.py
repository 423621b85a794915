"""Components against a plain version, and what they ask of the driver."""

from __future__ import annotations

import random

import pytest

from papyra.llm import graph


def plain(links, names):
    least = {fp: fp for fp, _ in names}

    def root(x):
        while least[x] != x:
            least[x] = x = least[least[x]]
        return x

    for a, b in links:
        x, y = sorted((root(a), root(b)))
        least[y] = x
    found = {}
    for fp, name in names:
        if name is not None:
            found[root(fp)] = min(name, found.get(root(fp), name))
    return {fp: found.get(root(fp)) for fp, _ in names}


def tables(spark, links, names):
    return spark.createDataFrame(links, "a long, b long"), spark.createDataFrame(names, "fp long, name long")


@pytest.mark.parametrize("local", [graph.LOCAL, 20, 0])
def test_components(spark, monkeypatch, local):
    """Chains, stars, cycles and random graphs, joined up by one worker at once, after some rounds, or by rounds alone."""
    monkeypatch.setattr(graph, "LOCAL", local)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(300)] + [(400, 401 + i) for i in range(50)] + [(501 + i, 500) for i in range(50)] + [(600 + i, 600 + (i + 1) % 40) for i in range(40)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(120)]
    order = rng.sample(range(-5000, 5000), 1000)
    links = [(order[a], order[b]) for a, b in links] + [(order[7], order[6])]
    names = [(fp, rng.randrange(10**6)) for fp in order]
    assert {r.fp: r.component for r in graph.components(*tables(spark, links, names)).collect()} == plain(links, names)


def test_names(spark):
    """Nodes without a name are linked like others; components that share a name stay apart."""
    links = [(1, 2), (3, 4), (5, 6), (6, 7), (8, 9)]
    names = [(1, 50), (2, 30), (3, 50), (4, 70), (5, 60), (6, None), (7, 20), (8, None), (9, None), (10, None), (11, 3)]
    got = {r.fp: r.component for r in graph.components(*tables(spark, links, names)).collect()}
    assert got == {1: 30, 2: 30, 3: 50, 4: 50, 5: 20, 6: 20, 7: 20, 8: None, 9: None, 10: None, 11: 3}


def test_jobs_do_not_follow_the_diameter(spark):
    """A chain of 3000 nodes: every job costs the driver plans and classes, so there are few of them."""
    links, names = [(i, i + 1) for i in range(2999)], [(i, i) for i in range(3000)]
    spark.sparkContext.setJobGroup("chain", "")
    try:
        got = graph.components(*tables(spark, links, names)).collect()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("chain")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert {r.component for r in got} == {0} and len(got) == 3000
    assert len(jobs) <= 25
