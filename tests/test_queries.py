import pytest
from compare import assert_same, views

from lexgrain import registry

SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_against_sql(spark, data, name):
    assert_same(QUERIES[name](spark, data), SQL[name], views(data))


def test_every_core_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
