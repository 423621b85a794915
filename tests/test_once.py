"""Steps that are worked out once: a redaction's expressions, and the levels of a tree."""

from __future__ import annotations

from papyra.operators import objects, redact
from papyra.plans import catalogue, object_queries  # noqa: F401

from .conftest import DATA


def test_covering(spark):
    docs = spark.createDataFrame([(1, "aXbXX"), (2, ""), (3, None), (4, "none"), (5, "X😀é\nX")], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_redacted) for r in redact.redact(docs, "[X😀]+", "█").collect()}
    assert got[1] == ("a█b██", 2) and got[2] == ("", 0) and got[3][0] is None and got[4] == ("none", 0) and got[5] == ("██é\n█", 2)
    # a mask that an expression's replacement would read as a reference
    assert redact.redact(docs.filter("doc_id = 1"), "X", "$").first().text == "a$b$$"


def test_texts_without_offsets(spark):
    """What is covered is found by its text; sums of offsets were made and thrown away."""
    plan = catalogue.QUERIES["redact_pipeline"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "cbrt" not in plan.lower()


def test_tree(spark):
    """Two roots, a chain beyond the depth, a loop that no root leads to, and an orphan."""
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 3), (1, 9, None), (1, 20, 21), (1, 21, 20), (1, 30, 99), (2, 1, None)] + [(3, i, i - 1 if i else None) for i in range(8)] + [(None, 1, None)]
    got = objects.bookmark_tree(spark.createDataFrame(rows, "doc_id long, node_id long, parent_id long").repartition(4), 5)
    said = {(r.doc_id, r.node_id): (r.depth, list(r.path), r.n_below) for r in got.collect()}
    assert said == {(1, 1): (0, [1], 3), (1, 2): (1, [1, 2], 0), (1, 3): (1, [1, 3], 1), (1, 4): (2, [1, 3, 4], 0), (1, 9): (0, [9], 0), (2, 1): (0, [1], 0)} | {(3, i): (i, list(range(i + 1)), 5 - i) for i in range(6)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()
