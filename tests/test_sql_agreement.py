"""Every query against its SQL on the smallest tables."""

import decimal

import duckdb
import pytest

import __spark_entry__ as entry
from votecount.oracle import ORACLE
from votecount.registry import QUERIES

FOLDER = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    return con


def _value(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float, decimal.Decimal)):
        return float(f"{float(v):.12g}")
    return v


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["departamento", "total_votos"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees(spark, sql, name):
    df = entry.queries()[name](spark, FOLDER)
    got = _rows(df.columns, df.collect())
    answer = sql.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in answer.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == _rows(columns, answer.fetchall())
