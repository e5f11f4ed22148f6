"""Training tables from matrices and files: dense, sparse (CSR, CSC), columns, TSV; checks of shapes and metadata; models on disk."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.ordered import previous, running
from thicket.operators.binning import codes
from thicket.plans.dataset import TrainSet, encode
from thicket.plans.model import Model
from thicket.plans.tables import materialise


def check_indptr(indptr: list[int], nnz: int) -> None:
    """Starts at 0, never falls, ends at the number of entries."""
    if not len(indptr) or indptr[0] != 0:
        raise ValueError("indptr must start with 0")
    if (np.diff(np.asarray(indptr, np.int64)) < 0).any():
        raise ValueError("indptr must not fall")
    if indptr[-1] != nnz:
        raise ValueError(f"indptr ends with {indptr[-1]}; there are {nnz} entries")


def indptr_faults(df: DataFrame, order: str = "i", value: str = "ptr") -> DataFrame:
    """Places where a table of row pointers falls: (order, value, before)."""
    return previous(df, order, value).where(F.col(value) < F.col("before"))


def from_dense(spark: SparkSession, rows: Any, names: list[str] | None = None, label: list[float] | None = None) -> TrainSet:
    """Rows of a matrix (lists or a numpy array), column by column through Arrow."""
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows differ in length")
    if label is not None and len(label) != len(rows):
        raise ValueError(f"{len(label)} labels for {len(rows)} rows")
    values = np.asarray(rows, float).reshape(len(rows), -1 if len(rows) else len(names or []))
    names = names or [f"Column_{i}" for i in range(values.shape[1])]
    own = pa.array(label, pa.float64()) if label is not None else pa.nulls(len(rows), pa.float64())
    columns = [pa.array(np.arange(len(rows))), own, *(pa.array(np.ascontiguousarray(c), pa.float64(), from_pandas=True) for c in values.T)]
    return TrainSet(spark.createDataFrame(pa.table(columns, ["row_id", "label", *names])), names, row_id="row_id")


def from_row_arrays(df: DataFrame, column: str, width: int, names: list[str] | None = None, label: str = "label", row_id: str | None = "row_id") -> TrainSet:
    """A table whose rows are arrays of ``width`` numbers, as a column a place. A row of another length is an error when it is read."""
    names = names or [f"Column_{i}" for i in range(width)]
    checked = F.when(F.size(column) == width, F.col(column)).otherwise(F.raise_error(F.concat(F.lit(f"a row has not {width} values but "), F.size(column).cast("string"))))
    rows = df.withColumn(column, checked.cast("array<double>"))
    return TrainSet(rows.select(*(F.col(c) for c in df.columns if c != column), *(F.col(column)[i].alias(n) for i, n in enumerate(names))), names, label, row_id=row_id)


def from_entries(entries: DataFrame, width: int, names: list[str] | None = None) -> DataFrame:
    """Wide rows from (row, col, val): absent entries are 0. One aggregation for any width."""
    names = names or [f"Column_{i}" for i in range(width)]
    sums = entries.groupBy(F.col("row").alias("row_id")).agg(*(F.coalesce(F.max(F.when(F.col("col") == i, F.col("val"))), F.lit(0.0)).alias(n) for i, n in enumerate(names)))
    return sums


def expand(pointers: DataFrame, entries: DataFrame) -> DataFrame:
    """Which row (CSR) or column (CSC) holds each entry: entries (k, index, val) with major, from pointers (i, ptr). Major i holds the
    entries from its pointer up to the next one's; so pointers and entries are put in one order, and pointers ahead are counted."""
    both = pointers.select(F.struct(F.col("ptr").cast("long").alias("at"), F.lit(0).alias("kind"), F.col("i").cast("long").alias("i")).alias("place"), F.lit(1).alias("one"), F.lit(None).cast("long").alias("index"), F.lit(None).cast("double").alias("val"))
    both = both.unionByName(entries.select(F.struct(F.col("k").cast("long").alias("at"), F.lit(1).alias("kind"), F.col("k").cast("long").alias("i")).alias("place"), F.lit(0).alias("one"), F.col("index").cast("long").alias("index"), F.col("val").cast("double").alias("val")))
    return running(both, "place", ["one"]).where("place.kind = 1").select(F.col("place.at").alias("k"), "index", "val", (F.col("before_one") - 1).alias("major"))


def sparse_rows(pointers: DataFrame, entries: DataFrame, by_column: bool = False, height: int | None = None) -> DataFrame:
    """row_id, indices and values of a CSR matrix in tables (pointers (i, ptr), entries (k, index, val)), or, ``by_column``, of a CSC one of ``height`` rows: what isn't zero,
    whatever the width. Rows without entries have empty arrays. ``TrainSet(..., sparse=("indices", "values"))`` trains on it."""
    row, column = ("index", "major") if by_column else ("major", "index")
    own = expand(pointers, entries).where("val <> 0 or isnan(val)").groupBy(F.col(row).alias("row_id")).agg(F.sort_array(F.collect_list(F.struct(F.col(column).cast("int").alias("i"), F.col("val").alias("v")))).alias("e"))
    rows = height if by_column else pointers.agg(F.max("i").alias("n")).first()["n"] or 0
    every = pointers.sparkSession.range(rows).withColumnRenamed("id", "row_id").join(own, "row_id", "left")
    none = F.expr("array()")
    return every.select("row_id", F.coalesce(F.col("e.i"), none.cast("array<int>")).alias("indices"), F.coalesce(F.col("e.v"), none.cast("array<double>")).alias("values"))


def csr_rows(pointers: DataFrame, entries: DataFrame, width: int, names: list[str] | None = None) -> DataFrame:
    """Wide rows of a CSR matrix in tables: pointers (i, ptr), one more than rows; entries (k, index, val). Rows without entries are all 0."""
    wide = from_entries(expand(pointers, entries).select(F.col("major").alias("row"), F.col("index").alias("col"), "val"), width, names)
    rows = pointers.agg(F.max("i").alias("n")).first()["n"] or 0
    return pointers.sparkSession.range(rows).withColumnRenamed("id", "row_id").join(wide, "row_id", "left").fillna(0.0)


def csc_rows(pointers: DataFrame, entries: DataFrame, height: int, names: list[str] | None = None) -> DataFrame:
    """Wide rows of a CSC matrix in tables: pointers (i, ptr), one more than columns; entries (k, index, val)."""
    width = pointers.agg(F.max("i").alias("n")).first()["n"] or 0
    wide = from_entries(expand(pointers, entries).select(F.col("index").alias("row"), F.col("major").alias("col"), "val"), width, names)
    return pointers.sparkSession.range(height).withColumnRenamed("id", "row_id").join(wide, "row_id", "left").fillna(0.0)


def _tables(spark: SparkSession, indptr: Any, indices: Any, values: Any, most: int, what: str) -> tuple[DataFrame, DataFrame]:
    """Arrays of this machine as tables, by Arrow."""
    check_indptr(indptr, len(values))
    indices = np.asarray(indices, np.int64)
    if len(indices) and not (indices.min() >= 0 and indices.max() < most):
        raise ValueError(f"a {what} is out of range")
    pointers = pa.table([pa.array(np.arange(len(indptr))), pa.array(np.asarray(indptr, np.int64))], ["i", "ptr"])
    entries = pa.table([pa.array(np.arange(len(indices))), pa.array(indices), pa.array(np.asarray(values, float))], ["k", "index", "val"])
    return spark.createDataFrame(pointers), spark.createDataFrame(entries)


def from_csr(spark: SparkSession, indptr: Any, indices: Any, values: Any, width: int, names: list[str] | None = None) -> DataFrame:
    """Rows of a CSR matrix in arrays of this machine."""
    return csr_rows(*_tables(spark, indptr, indices, values, width, "column"), width, names)


def from_csc(spark: SparkSession, indptr: Any, indices: Any, values: Any, height: int, names: list[str] | None = None) -> DataFrame:
    """Rows of a CSC matrix in arrays of this machine."""
    return csc_rows(*_tables(spark, indptr, indices, values, height, "row"), height, names)


def from_table(df: DataFrame, label: str, features: list[str] | None = None, categorical: list[str] | None = None, **more: Any) -> TrainSet:
    """Columns by type: numbers as they are; strings become codes in the order of their values, and are categorical. The codes stay with the set: its ``encode`` codes
    other tables alike."""
    features = features or [c for c in df.columns if c not in (label, *more.values())]
    kinds = dict(df.dtypes)
    cats, known = list(categorical or []), {}
    for c in features:
        if kinds[c] == "string":
            known[c] = materialise(codes(df, c), "codes")
            cats.append(c)
        elif kinds[c] == "boolean":
            df = df.withColumn(c, F.col(c).cast("int"))
    return TrainSet(encode(df, known), features, label, categorical=list(dict.fromkeys(cats)), codes=known, **more)


def read_tsv(spark: SparkSession, path: str) -> TrainSet:
    """Tab-separated numbers, the label first."""
    df = spark.read.option("sep", "\t").option("inferSchema", "true").csv(path)
    names = df.columns
    return TrainSet(df.withColumnRenamed(names[0], "label"), names[1:])


def query_weights(df: DataFrame, query: str = "query_id", weight: str = "weight") -> DataFrame:
    """query, weight: the mean weight of its rows."""
    return df.groupBy(query).agg(F.avg(weight).alias("weight"))


def check_metadata(df: DataFrame, label: str, weight: str | None = None, query: str | None = None) -> dict[str, int]:
    """Counts of rows that training can't use: missing labels, missing or negative weights, missing queries."""
    checks = {"rows": F.count(F.lit(1)), "no_label": F.count_if(F.col(label).isNull() | F.isnan(F.col(label).cast("double")))}
    if weight:
        checks["bad_weight"] = F.count_if(F.col(weight).isNull() | (F.col(weight) < 0))
    if query:
        checks["no_query"] = F.count_if(F.col(query).isNull())
    return df.agg(*(c.alias(k) for k, c in checks.items())).first().asDict()


def save_model(model: Model, path: str, spark: SparkSession | None = None) -> None:
    """Text at a path of Spark's (with a session) or of this machine."""
    if spark is not None:
        spark.createDataFrame([(model.to_text(),)], "value string").coalesce(1).write.mode("overwrite").option("lineSep", "\0").text(path)
    else:
        with open(path, "w") as f:
            f.write(model.to_text())


def load_model(path: str, spark: SparkSession | None = None) -> Model:
    if spark is not None:
        return Model.from_text(spark.read.text(path, wholetext=True).first()["value"].rstrip("\0"))
    with open(path) as f:
        return Model.from_text(f.read())
