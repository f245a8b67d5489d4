"""Every registered query of the core equals its SQL on the small tables."""

import math

import duckdb
import pytest
from changeloom import catalog, catalog_store  # noqa: F401

TABLES = ["events", "customer", "orders", "lineitem"]


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    return round(v, 6) if isinstance(v, float) and not math.isnan(v) else v


def test_all_have_sql():
    assert set(catalog.queries()) == set(catalog.oracle_sql())


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_equals_its_sql(spark, sf, tables, name):
    got = catalog.queries()[name](spark, sf)
    want = tables.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    left = sorted(([plain(v) for v in r] for r in got.select(*(f"`{c}`" for c in columns)).collect()), key=str)
    right = sorted(([plain(v) for v in r] for r in want.fetchall()), key=str)
    assert left == right
