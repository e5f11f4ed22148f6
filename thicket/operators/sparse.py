"""Sparse rows: of many features a row has the numbers and values of those that aren't zero, as two arrays.

Bins are found as for columns, from counts of the entries; zeros are the rows that have no entry. A binned row keeps the numbers and bins of what isn't at the
feature's common bin, that of zero; sums of common bins are what a leaf's totals leave, so a histogram costs the entries, not rows times features.
Numbers are unique in a row; entries of features that aren't known are passed over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.operators import binning
from thicket.operators.binning import NAN, BinMapper
from thicket.plans.tables import scratch

Arrays = tuple[str, str]


def distinct_counts(df: DataFrame, arrays: Arrays, rows: int, width: int) -> DataFrame:
    """feature, value (null for missing), n over ``rows`` sparse rows, the zeros that have no entry included."""
    entries = df.select(F.explode(F.arrays_zip(F.col(arrays[0]).alias("f"), F.col(arrays[1]).cast("array<double>").alias("v"))).alias("e")).select(F.col("e.f").cast("int").alias("feature"), "e.v").where(F.col("feature").between(0, width - 1))
    value = F.when(F.isnan("v"), F.lit(None)).otherwise(F.col("v") + 0.0).alias("value")
    counts = entries.groupBy("feature", value).agg(F.count(F.lit(1)).alias("n"))
    zeros = entries.groupBy("feature").agg((F.lit(rows) - F.count(F.lit(1))).alias("n")).where("n > 0").select("feature", F.lit(0.0).alias("value"), "n")
    return counts.unionByName(zeros).groupBy("feature", "value").agg(F.sum("n").alias("n"))


def fit(df: DataFrame, features: list[str], arrays: Arrays, max_bin: int = 255, min_data_in_bin: int = 3, use_missing: bool = True, zero_as_missing: bool = False, sample: int | None = None, key: str = "row_id", seed: int = 1, rows: int | None = None) -> list[BinMapper]:
    """Mappers of sparse features; their common bin is that of zero."""
    rows = df.count() if rows is None else rows
    if sample is not None and rows > sample:
        df, rows = binning.row_sample(df, sample, key, seed, rows), sample
    with scratch(df.sparkSession):
        counts = distinct_counts(df, arrays, rows, len(features)).persist()
        mappers = binning.fit_counts(counts, features, set(), [max_bin] * len(features), min_data_in_bin, use_missing, zero_as_missing, {}, max(binning.MAX_DISTINCT, 4 * max_bin))
    for m in mappers:
        m.most_frequent = m.default_bin
        m.sparse_rate = m.counts[m.default_bin] / rows if m.counts and rows else 0.0
    return mappers


class Bounds:
    """The bounds of all features one after another, for a search of many (feature, value) at once."""

    def __init__(self, mappers: list[BinMapper], used: set[int]) -> None:
        self.known = np.array([i in used for i in range(len(mappers))], bool)
        sizes = np.array([len(m.upper) for m in mappers], np.int64)
        self.first = np.concatenate([[0], np.cumsum(sizes)])
        self.upper = np.concatenate([np.asarray(m.upper, float) for m in mappers]) if mappers else np.zeros(0)
        self.common = np.array([m.default_bin for m in mappers], np.int64)
        self.missing = np.array([m.num_bin - 1 if m.missing == NAN else m.default_bin for m in mappers], np.int64)

    def bins(self, feature: np.ndarray, value: np.ndarray) -> np.ndarray:
        low, high = self.first[feature], self.first[feature + 1] - 1
        gone = np.isnan(value)
        while (low < high).any():
            middle = (low + high) // 2
            left = value <= self.upper[middle]
            low, high = np.where(left, low, np.minimum(middle + 1, high)), np.where(left, middle, high)
        return np.where(gone, self.missing[feature], low - self.first[feature])


def entries(batch: pa.RecordBatch, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, number and value of each entry of two list columns from ``at`` on; null lists are empty."""
    ids, values = batch.column(at), batch.column(at + 1)
    counts = np.asarray(pa.compute.fill_null(pa.compute.list_value_length(ids), 0)).astype(np.int64)
    flat = np.asarray(values.flatten().cast(pa.float64()).fill_null(np.nan))
    return np.repeat(np.arange(len(batch)), counts), np.asarray(ids.flatten()).astype(np.int64), flat


def binned(df: DataFrame, mappers: list[BinMapper], arrays: Arrays, used: set[int], out: Arrays = ("_sf", "_sb")) -> DataFrame:
    """``df`` with arrays of the numbers and bins of each row's features that aren't at their common bin, in place of its sparse arrays."""
    import pyarrow.compute  # noqa: F401

    kept = [c for c in df.columns if c not in arrays]
    shared = df.sparkSession.sparkContext.broadcast(Bounds(mappers, used))
    width = len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        bounds = shared.value
        for batch in batches:
            row, feature, value = entries(batch, width)
            mine = (feature >= 0) & (feature < len(bounds.known))
            mine[mine] = bounds.known[feature[mine]]
            row, feature, value = row[mine], feature[mine], value[mine]
            bins = bounds.bins(feature, value)
            away = bins != bounds.common[feature]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[away], minlength=len(batch)))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x[away].astype(np.int32))) for x in (feature, bins)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:width], *lists], [*kept, *out])

    schema = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.ArrayType(T.IntegerType())) for c in out)])
    return df.select(*kept, *(F.col(c) for c in arrays)).mapInArrow(run, schema)


def bin_sql(feature: int, mapper: BinMapper, arrays: Arrays = ("_sf", "_sb")) -> str:
    """SQL for a feature's bin in a binned row."""
    return f"coalesce(try_element_at({arrays[1]}, CAST(nullif(array_position({arrays[0]}, {feature}), 0) AS INT)), {mapper.default_bin})"
