"""Every query against its SQL, on the smallest tables."""

import pytest

from compare import connect, differences
from fathomline import queries


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, sf, duck, name):
    ours, theirs = differences(queries.QUERIES[name](spark, sf), duck, queries.SQL[name])
    assert not ours and not theirs, (list(ours)[:3], list(theirs)[:3])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, sf, name):
    assert queries.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0 and "fund" in df.columns
    assert set(e.oracle_sql()) <= set(e.queries())
