"""Every query against its SQL in DuckDB, on the same tables."""

import duckdb
import pandas as pd
import pytest

from braid.plans import step_queries  # noqa: F401
from braid.plans.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if isinstance(x, (list, tuple)):
            return str(list(x))
        if x is None or x is pd.NA or x is pd.NaT or x != x:
            return None
        return round(float(x), 6) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    df = df[sorted(df.columns)]
    return sorted((tuple(plain(x) for x in r) for r in df.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, DIR).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want) and len(want)


def test_entry_module_names():
    import __spark_entry__ as entry

    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and set(QUERIES) <= set(names)
