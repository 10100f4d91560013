"""The registered queries against their SQL in DuckDB, over the smallest driver tables."""

import os

import duckdb
import pytest

from skein.plans import catalogue

SF = os.environ.get("SKEIN_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", catalogue.oracle_sql())
def test_query_matches_sql(spark, duck, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = [tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()]
    names = ", ".join(f'"{c}"' for c in columns)
    assert plain(mine) == plain(duck.sql(f"SELECT {names} FROM ({catalogue.oracle_sql()[name]})").fetchall())


def test_entry_runs(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["order_key", "revenue", "order_date"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
