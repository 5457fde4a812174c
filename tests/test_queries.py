"""Every engine query against its DuckDB equivalent, on the smallest driver tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tidemark.plans.catalogue import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("events", "lineitem", "orders")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def value(x):
        if isinstance(x, float | Decimal):
            return "nan" if math.isnan(x) else round(float(x), 5) + 0.0
        return x

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.skipif(not Path(SF).exists(), reason="no driver tables here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = [tuple(r) for r in df.collect()]
    made = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in made.description]
    assert sorted(df.columns) == sorted(names)
    assert plain(got, df.columns) == plain(made.fetchall(), names)


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns == ["bucket", "v", "n"]
