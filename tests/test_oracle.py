"""Every registered query against its DuckDB twin; queries without one must run and keep their schema."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

from seriesloom.plans import catalogue

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


def same(rows, want):
    order = lambda r: tuple((v is None, str(round(v, 4) + 0.0) if isinstance(v, float) else str(v)) for v in r)
    rows, want = sorted(rows, key=order), sorted(want, key=order)
    assert len(rows) == len(want)
    for a, b in zip(rows, want):
        if a != b:
            assert all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) <= 2e-6 * max(1, abs(x))) for x, y in zip(a, b)), (a, b)
    return sum(a != b for a, b in zip(rows, want))


@pytest.mark.parametrize("name", list(catalogue.ORACLE_SQL))
def test_same_as_duckdb(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    want = duck.sql(catalogue.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    want = [tuple(plain(v) for v in r) for r in want.project(", ".join(f'"{c}"' for c in columns)).fetchall()]
    off = same([tuple(plain(v) for v in r) for r in got.select(*columns).collect()], want)
    assert off == 0, f"{off} of {len(want)} rows differ in a last digit"


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0
