"""Groups that go by in batches: pages across batches, and tables and reading order without a Python call a page."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest

from papyra.operators import detect, groups, layout
from papyra.plans import catalogue, object_queries  # noqa: F401

from .conftest import DATA


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_are_whole(size):
    keys = [(None, 0)] * 3 + [(0, 0)] + [(1, 0)] * 9 + [(1, 1)] * 2 + [(2, 1)]
    batch = pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()), pa.array(range(len(keys)))], names=["d", "p", "v"])
    parts = [batch.slice(i, size) for i in range(0, len(keys), size)] + [batch.slice(0, 0)]
    seen = []
    for table, begin in groups.whole(iter(parts), 2):
        for a, b in zip(begin[:-1], begin[1:], strict=True):
            own = table.slice(a, b - a).to_pylist()
            assert len({(r["d"], r["p"]) for r in own}) == 1
            seen.append(((own[0]["d"], own[0]["p"]), len(own)))
    assert seen == [((None, 0), 3), ((0, 0), 1), ((1, 0), 9), ((1, 1), 2), ((2, 1), 1)]
    assert list(groups.whole(iter([]), 2)) == []


def test_blocks():
    batch = pa.record_batch([pa.array(["a" * n if n else None for n in (0, 5, groups.BLOCK + 1, 3, groups.BLOCK, 0, 1)])], names=["text"])
    got = list(groups.blocks(batch, "text"))
    assert [b.num_rows for b in got] == [2, 1, 1, 2, 1]
    assert pa.Table.from_batches(got).equals(pa.Table.from_batches([batch]))


def grid(rng, doc):
    """A page of columns of short words, of running text, or of both."""
    lines = [(" " * int(rng.integers(30, 70))).join(str(x) for x in rng.integers(0, 99, 3)) if rng.random() < doc % 3 / 2 else " ".join(["word"] * int(rng.integers(1, 9))) for _ in range(int(rng.integers(1, 90)))]
    return "\n".join(lines)


def test_tables_of_texts_are_those_of_words(spark):
    """Texts that become pages here give the tables that their words give; rows that repeat a doc_id share pages."""
    rng = np.random.default_rng(4)
    docs = spark.createDataFrame([(d if d else None, grid(rng, d)) for d in range(60)] + [(7, "  x   y\n  z   w"), (8, None), (9, "")], "doc_id long, text string").repartition(3)
    got = detect.page_tables(layout.pages(docs))
    said = detect.tables(layout.words(docs))
    assert sorted(map(str, got.collect())) == sorted(map(str, said.collect()))
    assert got.select("doc_id").distinct().count() > 5


@pytest.mark.parametrize("name", ["page_tables", "tables_csv", "tables_json", "reading_order"])
def test_no_call_a_page(spark, name):
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapGroupsIn" not in plan and "MapInArrow" in plan
