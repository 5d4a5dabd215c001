"""Queries against their SQL on tables whose keys are too large for the codes cut from them, so that several rows have one code."""

import duckdb
import pytest

import __spark_entry__ as entry
from tests.test_oracles import rows

PART = "(1, 'a', 5, 10.0), (100001, 'b', 6, 11.0), (2, 'c', 6, 12.5), (100002, 'd', 5, 13.0), (3, 'e', 6, 14.0), (100003, 'f', 9, 15.0), (100007, 'g', 8, 16.0)"
TABLES = {
    "part": f"SELECT p_partkey::BIGINT AS p_partkey, p_name, p_size::INT AS p_size, p_retailprice::DOUBLE AS p_retailprice FROM (VALUES {PART}) t(p_partkey, p_name, p_size, p_retailprice)",
    "supplier": "SELECT k::BIGINT AS s_suppkey, k::INT AS s_nationkey, k + 0.25::DOUBLE AS s_acctbal FROM range(4) t(k)",
    "orders": "SELECT k::BIGINT AS o_orderkey, (k % 4 + CASE WHEN k % 3 = 0 THEN 100000 ELSE 0 END)::BIGINT AS o_custkey, k * 1.5::DOUBLE AS o_totalprice FROM range(20) t(k)",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("keys")
    for name, sql in TABLES.items():
        duckdb.execute(f"COPY ({sql}) TO '{d}/{name}.parquet' (FORMAT parquet)")
    return d


@pytest.mark.parametrize("name", ["hard_filter_rows", "quarter_feeds"])
def test_parts_of_one_code(spark, folder, name):
    df = entry.queries()[name](spark, str(folder))
    con = duckdb.connect()
    for p in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    cur = con.execute(entry.oracle_sql()[name])
    got, want = rows(df.columns, df.collect()), rows([d[0] for d in cur.description], cur.fetchall())
    assert want and got == want
