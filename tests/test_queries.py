import glob
import os

import duckdb
import pytest

from knotwork.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        read = f"{path}/*.parquet" if os.path.isdir(path) else path
        c.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{read}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, tables, name):
    got, want = registry.QUERIES[name](spark, FOLDER).toPandas(), tables.execute(registry.ORACLES[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    a, b = (x[columns].astype(str).sort_values(columns).reset_index(drop=True) for x in (got, want))
    assert a.equals(b)
