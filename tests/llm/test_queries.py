"""The registered queries against their SQL."""

import pytest

from barloom.llm import queries

from ..conftest import SF
from ..helpers import canonical


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    table = "pages" if name.startswith("op1_") else "conversations" if name.startswith("op7_") else "documents"
    n = duck.execute("SELECT count(DISTINCT conv_id) + 1 FROM conversations" if table == "conversations" else f"SELECT count(*) FROM {table}").fetchone()[0]
    assert len(rows) == n
    if name in queries.ORACLE:
        found = duck.execute(queries.ORACLE[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(rows, df.columns) == canonical(found.fetchall(), columns)
