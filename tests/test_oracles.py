"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from quernstone.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 9)
    return value


def rows(columns, names, found):
    at = [names.index(c) for c in columns]
    return sorted((tuple(plain(r[i]) for i in at) for r in found), key=lambda r: tuple((v is not None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_is_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = rows(columns, df.columns, df.collect())
    if name not in registry.ORACLES:
        assert got
        return
    run = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in run.description]
    assert sorted(names) == columns
    assert got == rows(columns, names, run.fetchall())
