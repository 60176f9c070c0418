"""Every query with SQL against that SQL, at the smallest scale; the others must give rows."""

from pathlib import Path

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tools.check_queries import difference

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, con, name):
    got = queries()[name](spark, SF).toPandas()
    if name in oracle_sql():
        assert difference(got, con.execute(oracle_sql()[name]).df()) == ""
    else:
        assert len(got) > 0


def test_entry(spark):
    df = entry(spark)
    assert df.columns == ["context_id", "dcg", "ideal", "ndcg"] and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(oracle_sql()) <= set(queries())
