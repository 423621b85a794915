"""Words against a plain version, over texts that are hard to cut, and what the plans of word queries hold."""

from __future__ import annotations

import re

import pytest

from papyra.operators import detect, layout
from papyra.plans import catalogue, object_queries, reading_queries  # noqa: F401

from .conftest import DATA

TEXTS = [None, "", " ", "\n", "a", "no blank at the end", "next text", "\n\n b\tc\r\nd  é ü\n", " x   y\x0bz", "😀 a😀b\n😀😀 \U0001f468‍\U0001f469 é end", "x " * 3000, None, "\n".join(f"{i} line" for i in range(100)), "w" * (layout.WIDTH << 11), "last\n"]


def plain(doc, text):
    for i, line in enumerate((text or "").split("\n")):
        for k, m in enumerate(re.finditer("[^ \n\t\r]+", line)):
            yield (doc, i // 40, i, k, m[0], 72 + 6 * m.start(), 720 - 14 * (i % 40), 6 * len(m[0]), 12, 18 if i == 0 else 12)


@pytest.mark.parametrize("parts", [1, 3])
def test_words(spark, parts):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(parts)
    got = layout.words(docs)
    assert got.columns == ["doc_id", "page_index", "line_index", "word_index", "text", "x", "y", "width", "height", "font_size"]
    assert sorted(map(tuple, got.collect())) == [w for d, t in enumerate(TEXTS) for w in plain(d, t)]
    assert layout.words(docs.filter("false")).count() == 0


@pytest.mark.parametrize("name", ["text_words", "crop_bounds", "crop_uniform", "font_usage", "structure_tags", "object_summary", "image_filters"])
def test_no_lambda_for_each_word(spark, name):
    """Spark interprets lambdas; over each word they cost more than all the rest."""
    plan = catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan and "MapInArrow" in plan


def test_tags_by_the_upper_median(spark):
    """Of an even number of words, the later of the two in the middle; a line by its largest font; pages stand alone."""
    sizes = {(1, 0, 0): [24, 10], (1, 0, 1): [10, 12], (1, 0, 2): [16], (1, 0, 3): [20, 10], (1, 1, 40): [20], (2, 0, 0): [13, 10], (2, 0, 1): [10, 10]}
    words = [(*at, n) for at, every in sizes.items() for n in every] + [(None, 0, 0, 10)]
    got = detect.tags(spark.createDataFrame(words, "doc_id long, page_index int, line_index int, font_size int"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, "H1"), (1, 1, "P"), (1, 2, "H3"), (1, 3, "H2"), (1, 40, "P"), (2, 0, "H3"), (2, 1, "P")]
    assert "SortMergeJoin" not in (plan := got._jdf.queryExecution().executedPlan().toString()) and "BroadcastHashJoin" not in plan
