"""Every registered query against its oracle on whole tables."""

import pytest

from framewright import registry
from tests.oracle import compare, connect

registry.load()


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, con, name):
    run, sql = registry.QUERIES[name], registry.ORACLE.get(name)
    if sql is None:
        assert run(spark, sf).count() > 0
    else:
        assert compare(spark, sf, run, sql, con) == []


def test_entry_has_rows(spark):
    import __spark_entry__ as e
    out = e.entry(spark)
    assert out.columns == ["folder", "decision", "reason", "images", "mean_sharpness", "mean_luma"]
    assert out.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
