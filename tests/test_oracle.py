"""Every registered query with SQL equals DuckDB on the smoke tables."""

from __future__ import annotations

import os

import oracle
import pytest

from answerlab.plans import registry

DATA = os.environ.get("ANSWERLAB_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    return oracle.views(DATA)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, DATA, registry.queries()[name], registry.oracle_sql()[name]) == ""


def test_entry_runs(spark):
    import __spark_entry__ as e

    if not os.path.isdir(e.SMOKE_DIR):
        pytest.skip("no test tables")
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
