import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
OWN = [n for n in entry.queries() if not n.startswith("op") and n != "pipeline"]


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    value = lambda v: None if v is None or pd.isna(v) else float(v) if hasattr(v, "__float__") and not isinstance(v, str) else str(v)
    return sorted((tuple(value(v) for v in r) for r in df.itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", OWN)
def test_query_against_sql(spark, duck, name):
    got = entry.queries()[name](spark, DIR).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got)
        return
    want = duck.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
