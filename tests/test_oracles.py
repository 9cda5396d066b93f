"""Every registered query of the library against its SQL."""

import duckdb
import pandas as pd
import pytest

from compostat import catalog

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(pdf):
    cell = lambda v: "~" if pd.isna(v) else repr(float(v)) if isinstance(v, float) else str(v)
    pdf = pdf[sorted(pdf.columns)].astype(object)
    return sorted(tuple(cell(v) for v in r) for r in pdf.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF).toPandas(), duck.sql(catalog.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, name):
    assert len(catalog.QUERIES[name](spark, SF).toPandas())


def test_entry(spark):
    assert catalog.entry(spark).count() > 0
