"""Every registered query of the market part against its SQL."""

import pytest

from barloom import plans

from .conftest import SF
from .helpers import canonical


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    assert df.columns
    if name in plans.ORACLE:
        found = duck.execute(plans.ORACLE[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
