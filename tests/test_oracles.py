"""Every query beside its SQL on the smallest tables."""

import pytest
from run_oracle import compare, duck

from rasterloom import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, con, sf_dir, name):
    said = compare(spark, con, name, catalog.QUERIES[name], catalog.ORACLES[name], sf_dir)
    assert said.startswith("ok"), said


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
