"""Every registered key against its DuckDB oracle on the driver tables."""

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from oracle_harness import compare
from triagekit.plans.catalog import REGISTRY
from triagekit.plans.oracle import ORACLE

KEYS = sorted(ORACLE)  # the optional training-data keys have tests of their own


def test_every_key_has_oracle():
    assert set(REGISTRY) <= set(ORACLE)


@pytest.mark.parametrize("key", KEYS)
def test_key_matches_oracle(spark, key):
    r = compare(spark, key, SF_SMALL, E.queries()[key], E.oracle_sql()[key])
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["query_id", "id", "title", "similarity", "url"]
    assert df.count() > 0
    assert E.entry(spark).schema == df.schema  # stable across calls
