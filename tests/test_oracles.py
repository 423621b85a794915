"""Every registered query against its SQL, over the same files."""

from __future__ import annotations

import pytest

from papyra.plans import catalogue, object_queries, reading_queries  # noqa: F401

from .conftest import DATA, rows_of


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, DATA).toArrow()
    said = duck.execute(catalogue.ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(said.column_names)
    assert rows_of(got, columns) == rows_of(said, columns)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES)))
def test_query_runs(spark, name):
    out = catalogue.QUERIES[name](spark, DATA)
    assert out.count() >= 0
    assert len(set(out.columns)) == len(out.columns)
