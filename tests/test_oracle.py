"""Each driver query against its DuckDB twin on the smallest tables (the driver's own
check runs the same pairs at sf0.01)."""

import duckdb
import pandas as pd
import pytest

from latecomer.plans.registry import all_oracles, all_queries

from .conftest import SF_SMALL

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
QUERIES = all_queries()
ORACLE = all_oracles()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _rows(pdf: pd.DataFrame):
    pdf = pdf[sorted(pdf.columns)].astype(object).where(pd.notna(pdf), None)

    def norm(v):
        if isinstance(v, float):
            return str(int(v)) if v.is_integer() else repr(round(v, 9))
        return None if v is None else str(v)
    return sorted((tuple(norm(v) for v in r) for r in pdf.itertuples(index=False)),
                  key=lambda r: tuple((x is None, x or "") for x in r))


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLE)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_duckdb(spark, duck, name):
    got = QUERIES[name](spark, SF_SMALL).toPandas()
    want = duck.execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert _rows(got) == _rows(want)
