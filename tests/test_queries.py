"""Every query of the library against SQL on the same tables, and the driver's entry points."""

from __future__ import annotations

import pytest

from tests.conftest import spark_rows, sql_rows
from waymark.plans.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert spark_rows(QUERIES[name](spark, sf_dir)) == sql_rows(ORACLE_SQL[name], sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES.keys() - ORACLE_SQL.keys()))
def test_other_queries_have_rows(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert {"incident_id", "person_id", "status"} <= set(driver.entry(spark).columns)
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(QUERIES) <= set(driver.queries())
