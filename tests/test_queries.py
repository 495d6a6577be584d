"""Every registered query that has an oracle gives the oracle's rows; the others give rows with stable columns."""

import duckdb
import pandas as pd
import pytest

from probeloom.jobs import all_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame, columns: list[str]) -> list[str]:
    cell = lambda v: "" if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else f"{float(v):.6g}" if isinstance(v, float) else str(v)
    return sorted("|".join(map(cell, r)) for r in df[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, duck, name):
    want, got = duck.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows(want, sorted(want.columns)) == rows(got, sorted(want.columns))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
