"""The table that most queries share, as Spark columns and as SQL, and the registry that queries enter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Columns of the shared table over ``orders``; each text means the same to Spark and to DuckDB.
COLUMNS = {
    "row_id": "o_orderkey",
    "query_id": "o_custkey",
    "y": "o_totalprice / 98765e0",
    "s": "(o_custkey % 17) / 1e1 - 8e-1",
    "yb": "CASE WHEN o_totalprice > 250000 THEN 1e0 ELSE 0e0 END",
    "yc": "CAST((o_orderkey * 5 + o_custkey) % 3 AS DOUBLE)",
    "p": "((o_custkey * 7) % 19 + 5e-1) / 2e1",
    "w": "1e0 + (o_orderkey % 3)",
    "rel": "CAST((o_orderkey * 3 + o_custkey) % 5 AS DOUBLE)",
    "rs": "((o_orderkey * 37) % 101) / 1e1",
    "f0": "CASE WHEN o_orderkey % 11 = 0 THEN CAST(NULL AS DOUBLE) ELSE floor(o_totalprice / 1e4) END",
    "f1": "CAST((o_custkey % 23) - 5 AS DOUBLE)",
    "f2": "CAST((o_custkey * o_custkey) % 7 AS DOUBLE)",
    "b0": "CAST(CASE WHEN o_orderkey % 11 = 0 THEN 10 ELSE floor(o_totalprice / 6e4) END AS INTEGER)",
    "b1": "CAST(o_custkey % 8 AS INTEGER)",
    "b2": "CAST((o_custkey * o_custkey) % 7 AS INTEGER)",
    "leaf": "CAST(o_custkey % 2 AS INTEGER)",
    "g": "CAST((o_custkey * 11 + o_orderkey) % 9 AS BIGINT) - 4 + CAST(o_custkey % 8 AS BIGINT) % 3",
    "h": "CAST(1 AS BIGINT)",
}
WITH = "WITH t AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in COLUMNS.items()) + " FROM orders)"
#: The same with the array of three class scores.
SCORES = ("s", "(o_custkey % 5) / 1e1", "(o_orderkey % 7) / 1e1 - 3e-1")


def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr(*(f"{v} AS {k}" for k, v in COLUMNS.items()))


def with_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = COLUMNS["s"]
    return df.selectExpr("o_orderkey AS row_id", f"{COLUMNS['yc']} AS yc", f"array({first}, {SCORES[1]}, {SCORES[2]}) AS scores")


WITH_SCORES = f"WITH t AS (SELECT o_orderkey AS row_id, {COLUMNS['yc']} AS yc, {COLUMNS['s']} AS s0, {SCORES[1]} AS s1, {SCORES[2]} AS s2 FROM orders)"


def query(name: str, sql: str | None = None) -> Callable:
    def enter(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return enter


def r6(x: Column | str, name: str) -> Column:
    return F.round(x, 6).alias(name)
