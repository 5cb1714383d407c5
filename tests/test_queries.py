"""Every named query against its SQL counterpart, row for row."""

import compare
import pytest

from plaintide.bindings.oracles import ORACLES
from plaintide.bindings.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, duck, name):
    assert compare.differences(QUERIES[name](spark, sf_dir), duck, ORACLES[name]) == []


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
