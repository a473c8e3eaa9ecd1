"""Every query with SQL, against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from check_oracles import compare, types
from readgrove.workload.oracles import ORACLES
from readgrove.workload.queries import QUERIES

TABLES = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.exists(), reason="the given tables are not here")


LARGER = TABLES.parent / "sf0.01"


def connected(tables):
    connection = duckdb.connect()
    for path in tables.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.fixture(scope="module")
def con():
    return connected(TABLES)


#: Minutes long even on the smallest tables; run ``check_oracles.py`` for it.
SLOW = {"divide_unlimited"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_query_equals_its_sql(spark, con, name):
    frame = QUERIES[name](spark, str(TABLES))
    assert compare(frame.toPandas(), con.execute(ORACLES[name]).df()) == "ok"
    assert types(frame, con.execute(f"DESCRIBE {ORACLES[name]}").fetchall()) == ""


#: Their data have names and reads in common only where the tables are larger.
@pytest.mark.parametrize("name", ["otu_table_merge", "subcluster_many", "nearest_landmark_short"])
def test_query_equals_its_sql_on_larger_tables(spark, name):
    assert compare(QUERIES[name](spark, str(LARGER)).toPandas(), connected(LARGER).execute(ORACLES[name]).df()) == "ok"
