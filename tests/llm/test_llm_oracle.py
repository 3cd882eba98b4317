"""Every training-data query that SQL can say equals DuckDB on the smoke tables."""

from __future__ import annotations

import os

import oracle
import pytest

from answerlab.llm import queries

DATA = os.environ.get("ANSWERLAB_DATA", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    assert oracle.compare(spark, oracle.views(DATA), DATA, queries.queries()[name], queries.oracle_sql()[name]) == ""
