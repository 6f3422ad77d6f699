"""Every registered query runs over whole tables and keeps the columns that its SQL names."""

import os
import re

import pytest

from corpusloom import registry

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_runs(spark, name):
    rows = registry.QUERIES[name](spark, TABLES)
    assert rows.columns and len(set(rows.columns)) == len(rows.columns)
    rows.write.format("noop").mode("overwrite").save()
    sql = registry.ORACLE_SQL.get(name)
    if sql is not None:
        assert all(re.search(rf"\b{c}\b", sql) for c in rows.columns)


def test_every_sql_has_its_query():
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES) and registry.FLAGSHIP in registry.QUERIES
