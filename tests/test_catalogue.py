"""Every registered query with an oracle equals it; the entry points hold."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__
from tonespan.plans import catalogue


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        return "nan" if math.isnan(v) else float(f"{float(v):.9g}")
    return v


def order(row):
    return [(v is None, str(type(v)), v if v is not None else 0) for v in row]


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_oracle(spark, duck, sf_dir, name):
    df = catalogue.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(([plain(v) for v in r] for r in df.select(*columns).collect()), key=order)
    names = ", ".join(f'"{c}"' for c in columns)
    want = sorted(([plain(v) for v in r] for r in duck.sql(f"SELECT {names} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()), key=order)
    assert got == want and got


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_other_queries_run(spark, sf_dir, name):
    assert catalogue.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
