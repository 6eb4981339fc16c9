"""Every query with an SQL twin returns the same rows as DuckDB on the same tables."""

import math
from collections import Counter

import duckdb
import pytest

from pyrogrid.plans.catalog import REGISTRY

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
COMPARED = sorted(n for n, e in REGISTRY.items() if e.sql is not None)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _value(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(float(v), 5) if isinstance(v, (int, float)) else v


def _bag(rows):
    return Counter(tuple(map(_value, r)) for r in rows)


@pytest.mark.parametrize("name", COMPARED)
def test_same_rows(spark, sf_dir, duck, name):
    entry = REGISTRY[name]
    got = entry.run(spark, sf_dir)
    columns = ", ".join(got.columns)
    want = duck.execute(f"SELECT {columns} FROM ({entry.sql})").fetchall()
    assert _bag(got.collect()) == _bag(want)


def test_entry_points(spark):
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
