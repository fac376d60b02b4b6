"""Every query of the core against its SQL on the smallest tables, and the entry point's contract."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import pytest

import __spark_entry__ as entry_point

DATA = Path("/root/testdata/sf0.001")
CORE = ["termloom.plans.core_queries", "termloom.plans.rdf_queries", "termloom.plans.fixture_queries"]


def names() -> list[str]:
    import importlib

    return [k for m in CORE for k in importlib.import_module(m).QUERIES]


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return bytes(value) if isinstance(value, bytearray) else repr(value) if isinstance(value, (list, dict)) else value


@pytest.fixture(scope="session")
def duck():
    import duckdb

    db = duckdb.connect()
    db.execute("SET TimeZone = 'UTC'")
    for path in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return db


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", names())
def test_query(spark, duck, name):
    df = entry_point.queries()[name](spark, str(DATA))
    rows = df.collect()
    sql = entry_point.oracle_sql().get(name)
    if sql is None:
        assert df.columns and rows
        return
    cursor = duck.execute(sql)
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    want = Counter(tuple(plain(r[columns.index(c)]) for c in order) for r in cursor.fetchall())
    assert Counter(tuple(plain(r[c]) for c in order) for r in rows) == want


@pytest.mark.skipif(not DATA.is_dir(), reason="the driver's tables are not here")
def test_entry(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
