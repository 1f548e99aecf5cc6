"""Every registered query of the library against its SQL, run by DuckDB on the same tables."""

from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tallyforge.plans import registry

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in Path(SF_DIR).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float | Decimal):
        return f"{float(value):.9g}"
    return str(value)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    ours = sorted(tuple(map(plain, r)) for r in df.select(*columns).collect())
    result = duck.execute(SQL[name])
    at = {d[0]: i for i, d in enumerate(result.description)}
    assert sorted(at) == columns
    assert ours == sorted(tuple(plain(r[at[c]]) for c in columns) for r in result.fetchall())
