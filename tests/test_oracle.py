"""Every query with SQL, against DuckDB on the same files."""

import duckdb
import pytest
from conftest import SF

from lamella.plans import catalogue


def normal(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in catalogue.TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE[name])
    columns = [c[0] for c in want.description]
    df = catalogue.QUERIES[name](spark, SF)
    assert sorted(df.columns) == sorted(columns)
    assert normal(df.select(*columns).collect()) == normal(want.fetchall())
