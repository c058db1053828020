"""Each query of the tables against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from palimpsest import contract_queries  # noqa: F401
from palimpsest import queries as own

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(rows):
    return sorted(repr(tuple(float(x) if isinstance(x, int | float) and not isinstance(x, bool) else x for x in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(own.ORACLE_SQL))
def test_query_equals_sql(spark, db, name):
    df = own.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in df.columns)
    expected = db.execute(f"SELECT {columns} FROM ({own.ORACLE_SQL[name]}) q").fetchall()
    assert normal(map(tuple, df.collect())) == normal(expected) and expected


def test_entry_and_registration(spark):
    import __spark_entry__ as e

    assert set(own.ORACLE_SQL) <= set(e.queries()) and e.entry(spark).count() > 0
