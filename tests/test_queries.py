"""Every load query against its SQL, as the driver does."""

from collections import Counter
from decimal import Decimal

import duckdb
import pandas as pd
import pytest

from sluice.queries import SQL, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def bag(rows, columns):
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or v != v:
            return None
        return float(v) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)

    return Counter(tuple(map(plain, r)) for r in rows[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, db, name):
    ours, theirs = queries()[name](spark, SF).toPandas(), db.execute(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours, sorted(ours.columns)) == bag(theirs, sorted(ours.columns))


def test_entry_without_the_operators(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(SQL) <= set(__spark_entry__.queries())
