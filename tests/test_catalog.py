"""Every catalogued query against its SQL, and the package without the corpus operators."""

import pytest

from gridweave.plans import catalog, drainage, landscape  # noqa: F401  (register their queries)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, duck, same_rows, name):
    same_rows(catalog.QUERIES[name](spark, sf_dir), duck.sql(catalog.ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_entry_has_the_catalogue(spark):
    import __spark_entry__ as e

    assert set(catalog.QUERIES) <= set(e.queries())
    assert set(catalog.ORACLE_SQL) <= set(e.oracle_sql())
    assert e.entry(spark).count() > 0
