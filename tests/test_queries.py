"""Every registered query runs at the smallest size and, where SQL is given, agrees with it."""

import glob
import os

import pytest

import __spark_entry__ as entry  # noqa: E402
from ripplegraph.session import data_home

SF = data_home("sf0.001")
#: The queries on training text have their own run, in ``tests/llm``.
CORE = sorted(name for module in entry._MODULES for name in module.QUERIES)
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        source = f"{path}/*.parquet" if os.path.isdir(path) else path
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{source}'")
    return connection


def plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, float):
        return f"{value:.9g}"
    return str(value.replace(tzinfo=None)) if hasattr(value, "tzinfo") else str(value)


def test_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 2, 3)} <= set(entry.queries())


def agrees(spark, duck, name):
    frame = entry.queries()[name](spark, SF)
    columns = sorted(frame.columns)
    rows = frame.select(*columns).collect()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    result = duck.execute(sql)
    given = [d[0] for d in result.description]
    assert sorted(given) == columns
    order = [given.index(c) for c in columns]
    assert sorted(tuple(map(plain, r)) for r in rows) == sorted(tuple(plain(r[i]) for i in order) for r in result.fetchall())


@pytest.mark.parametrize("name", CORE)
def test_query(spark, duck, name):
    agrees(spark, duck, name)
