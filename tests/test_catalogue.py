"""Every catalogue query against its SQL on the smallest tables, and the driver's contract."""

import math
import pathlib

import pytest

import __spark_entry__ as entry_module
from tallyloom.plans import catalogue
from tallyloom.tables import NAMES

duckdb = pytest.importorskip("duckdb")
TABLES = pathlib.Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not TABLES.is_dir(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for name in NAMES:
        c.execute(f"create view {name} as select * from '{TABLES}/{name}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = catalogue.queries()[name](spark, str(TABLES))
    columns = sorted(df.columns)
    got = sorted([plain(r[c]) for c in columns] for r in df.collect())
    result = con.execute(catalogue.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    want = sorted([plain(r[names.index(c)]) for c in columns] for r in result.fetchall())
    assert got == want


def test_contract(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
