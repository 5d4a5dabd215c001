"""Every query with a DuckDB twin gives the same rows on the small tables."""

import datetime
import math
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))
NAMES = sorted(entry.registry.ORACLES)


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.5f}"
    if isinstance(x, datetime.datetime):
        return x.date().isoformat()
    return None if x is None else str(x)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(cell(r[i])) for i in order) for r in data)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_same_rows(spark, con, name):
    df = entry.queries()[name](spark, str(DATA))
    got = rows(df.columns, df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    want = rows([d[0] for d in cur.description], cur.fetchall())
    assert len(got) == len(want)
    bad = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert not bad, bad[:3]
