"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest

from truegauge.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows(spark, duck, name):
    mine, theirs = QUERIES[name](spark, FOLDER).toPandas(), duck(FOLDER).execute(ORACLE_SQL[name]).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    cols = sorted(mine.columns)
    mine, theirs = (t[cols].sort_values(cols).reset_index(drop=True) for t in (mine, theirs))
    assert mine.equals(theirs.astype(mine.dtypes.to_dict()))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_alike_twice(spark, name):
    first, again = (sorted(map(tuple, QUERIES[name](spark, "/root/testdata/sf0.001").collect()), key=str) for _ in range(2))
    assert first and str(first) == str(again)
