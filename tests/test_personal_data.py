"""What a category's matches need, and counts that need no join."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from papyra.functions import patterns, scalars
from papyra.operators import redact
from papyra.plans import catalogue

from .conftest import DATA, duck_over, rows_of

PIECES = ["a@b.co", "Jan", "January", "May ", "\n", " ", " ", "12", "1", "345", "6789", "4111", "-", ".", "/", ":", "::", "f", "AB", "Z", "GB82", "WEST", "(", ")", "+", "é", "١", "10.0.0.1", "2001:db8:0:0:0:0:0:1", "1:2:3:4:5:6:7::", "AB 12 34 56 C", "AB123456C"]


def texts(n=3000):
    rng = random.Random(8)
    return ["".join(rng.choices(PIECES, k=rng.randrange(1, 14))) for _ in range(n)] + [None, "", "x" * 9]


def test_what_is_needed(spark):
    """Whole texts are passed over only where no match is."""
    assert patterns.NEEDED.keys() == patterns.PATTERNS.keys()
    docs = spark.createDataFrame(list(enumerate(texts())), "doc_id long, text string")
    got = redact.matches(docs)
    every = [docs.select("doc_id", F.lit(k).alias("category"), F.explode(scalars.match_spans(F.col("text"), p)).alias("m")).select("doc_id", "category", "m.*") for k, p in patterns.PATTERNS.items()]
    said = {(*r,) for one in every for r in one.collect() if r.category != "credit_card"}
    assert {(*r,) for r in got.collect() if r.category != "credit_card"} == said
    assert {c for _, c, *_ in said} == patterns.PATTERNS.keys() - {"credit_card"}
    passed = docs.filter(redact.possible("credit_card", patterns.PATTERNS["credit_card"], F.col("text")))
    assert passed.filter(F.col("text").rlike(patterns.PATTERNS["credit_card"])).count() == docs.filter(F.col("text").rlike(patterns.PATTERNS["credit_card"])).count() > 0


def test_own_expressions(spark):
    """An expression that is not the catalogue's is tried on every text."""
    docs = spark.createDataFrame([(1, "no digit"), (2, "none")], "doc_id long, text string")
    assert [(r.doc_id, r.text) for r in redact.matches(docs, {"phone": "dig", "mine": "no d"}).collect()] == [(1, "dig"), (1, "no d")]


@pytest.mark.parametrize("name", ["pii_counts", "pii_rollup"])
def test_rows_that_repeat_a_doc_id(spark, tmp_path, name):
    """Each row's matches are of its own language, as in SQL, and no table meets itself."""
    rows = [(1, "mail a@b.co", "en", "s", 11), (1, "or c@d.org and 10.0.0.1", "de", "s", 23), (2, "call 555-123-4567", None, "s", 17), (2, None, "fr", "s", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES[name](spark, str(tmp_path)).toArrow()
    duck = duck_over(DATA)
    duck.execute(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    said = duck.execute(catalogue.ORACLES[name]).to_arrow_table()
    assert rows_of(got, sorted(got.column_names)) == rows_of(said, sorted(got.column_names))
    assert "Join" not in catalogue.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
