"""Every query with SQL, at the smallest scale, against DuckDB."""

import duckdb
import pytest

from checks import load
from checks.registry import ORACLES, QUERIES
from checks.run import TABLES, compare

SF = "/root/testdata/sf0.001"
load()


@pytest.fixture(scope="module")
def duck():
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return db


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert compare(rows, df.columns, found.fetchall(), names) is None


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
