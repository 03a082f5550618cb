"""Every registered query against its SQL, on the smallest data."""

import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "string": "VARCHAR", "double": "DOUBLE"}
QUERIES, ORACLE = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return con


def _sorted(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].astype(object)
    df = df.where(df.notna(), None)
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    frame = QUERIES[name](spark, SF)
    got = frame.toPandas()
    assert len(got) > 0
    if name not in ORACLE:
        return
    relation = duck.sql(ORACLE[name])
    assert {c: TYPES[t] for c, t in frame.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    pd.testing.assert_frame_equal(_sorted(got), _sorted(relation.df()), check_dtype=False, atol=1e-9, rtol=0)


def test_flagship_entry(spark):
    assert entry.entry(spark).count() == 150
