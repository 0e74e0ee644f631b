"""Every registered query against its SQL on the smallest tables."""

import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from millrace.plans import registry

SQL = registry.oracle_sql()
SLOW = {"gate_verdicts", "gate_report"}  # the funnel stands for them here


def canonical(df):
    def value(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return "null"
        return repr(round(v, 10)) if isinstance(v, float) else str(v)

    return sorted(tuple(map(value, row)) for row in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    connection.execute("SET timezone = 'UTC'")
    for f in os.listdir(sf_dir):
        connection.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{sf_dir}/{f}'")
    return connection


@pytest.mark.parametrize("name", sorted(set(SQL) - SLOW))
def test_query_equals_sql(spark, sf_dir, duck, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canonical(got) == canonical(want)


def test_entry_points(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
