"""Every query of the library with SQL, against DuckDB on the same tables."""

import glob
import math
from pathlib import Path

import duckdb
import pytest

from thicket import registry

SMALL = "/root/testdata/sf0.001"
NAMES = sorted(registry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {Path(p).stem} AS SELECT * FROM '{p}'")
    return con


def _value(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    found = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, df.collect()) == _rows(names, found.fetchall())


def test_queries_have_names_of_their_own():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 130


def test_costs_that_let_nothing_split_equal_sql(spark):
    large = "/root/testdata/sf0.1"  # costs grow with the rows, gains on noise don't
    df = registry.queries()["tr25_lazy_costs"](spark, large)
    found = duckdb.connect().execute(registry.oracle_sql()["tr25_lazy_costs"].replace("FROM orders", f"FROM '{large}/orders.parquet'")).fetchall()
    assert sorted(map(tuple, df.collect()), key=str) == sorted(found, key=str) and [x[-1] for x in found] == [150_000] * 3


@pytest.mark.parametrize("name", ["bo01_l1", "bo01_multiclass", "bo04_random_forest", "bo12_init_score", "py02_cv", "py06_by_arrays", "sm04_bagged_training", "tr25_lazy_costs", "tr32_quantised"])
def test_rows_too_few_to_split_equal_sql(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * FROM '{SMALL}/orders.parquet' ORDER BY o_orderkey LIMIT 30) TO '{tmp_path}/orders.parquet'")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    df = registry.queries()[name](spark, str(tmp_path))
    found = con.execute(registry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert _rows(df.columns, df.collect()) == _rows(names, found.fetchall())
