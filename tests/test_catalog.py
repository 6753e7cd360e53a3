"""Every query with an oracle gives DuckDB's rows; every other one runs."""

import pytest

from convoke.plans import catalog, journals, workloads  # noqa: F401  (the others add their queries to the catalog)
from tests import compare


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, con, sf_dir, name):
    assert compare.difference(spark, con, sf_dir, catalog.QUERIES[name], catalog.SQL[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0
