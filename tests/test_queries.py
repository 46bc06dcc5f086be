"""Every query with SQL against that SQL, on the smallest tables; the rest must give rows."""

import glob
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(path).removesuffix('.parquet')} as select * from '{path}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    text = lambda v: repr(float(v)) if isinstance(v, float) else str(v)
    return Counter(tuple(text(r[k]) for k in order) for r in values)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_and_sql_agree(spark, duck, name):
    df, sql = entry.queries()[name](spark, SF), duck.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(sql.columns)
    assert rows(df.columns, df.collect()) == rows(sql.columns, sql.fetchall())


@pytest.mark.parametrize("name", sorted(n for n in entry.queries().keys() - entry.oracle_sql().keys() if not n.startswith("op") and n != "pipeline"))
def test_query_without_sql_runs(spark, name):
    # natural text may hold nothing that looks like a tag
    assert entry.queries()[name](spark, SF).count() > 0 or name == "fp_natural"


def test_entry(spark):
    assert len(entry.entry(spark).collect()) == 6
