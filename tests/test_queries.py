"""Each registered query against its SQL statement on the smallest tables."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES, ORACLES = entry_module.queries(), entry_module.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def canonical(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if not pd.api.types.is_numeric_dtype(df[c]) or pd.api.types.is_bool_dtype(df[c]):
            df[c] = df[c].astype(str).replace({"NaT": "None", "nan": "None", "<NA>": "None"})
        else:
            df[c] = df[c].astype(float)
    return df.sort_values(list(df.columns), kind="stable").reset_index(drop=True)


@pytest.mark.parametrize("name", list(ORACLES))
def test_matches_sql(spark, duck, sf, name):
    got = canonical(QUERIES[name](spark, sf).toPandas())
    want = canonical(duck.execute(ORACLES[name]).df())
    pd.testing.assert_frame_equal(got, want, check_dtype=False, rtol=0, atol=0)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ORACLES])
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0
