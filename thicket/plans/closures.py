"""Objectives and metrics of the caller that are functions of arrays: of labels and scores, of weights too, or of whole queries."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from inspect import signature
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a query that one call may get.
MOST_ROWS = 2_000_000


class ByArrays:
    """``function(labels, scores)``, ``(labels, scores, weights)`` or ``(labels, scores, weights, group)``; several classes: scores has a row a row and a column a class.

    As an objective it gives gradients and hessians of the same shape as the scores; as a metric (name, value, higher is better).
    With two or three arguments the arrays are batches of rows, in any number, so an objective must judge rows by themselves; a metric's values are averaged by the
    batches' weights. With four they are one query's rows, ``group`` being the array of its size, and a metric's values are averaged over queries. Without four arguments weights are
    applied to what an objective gives if its function doesn't ask for them. A query of over ``MOST_ROWS`` rows is an error, as one task would hold it.
    """

    def __init__(self, function: Callable[..., Any]) -> None:
        self.function, self.arguments = function, len(signature(function).parameters)
        if not 2 <= self.arguments <= 4:
            raise ValueError(f"a function of 2, 3 or 4 arguments is wanted, not of {self.arguments}")

    def _call(self, labels: np.ndarray, scores: np.ndarray, weights: np.ndarray) -> Any:
        return self.function(*(labels, scores, weights, np.array([len(labels)]))[: self.arguments])

    def _sizes(self, df: DataFrame, query: str) -> None:
        if query not in df.columns:
            raise ValueError("a function of whole queries needs a query column")
        largest = df.groupBy(query).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
        if largest > MOST_ROWS:
            raise ValueError(f"a query has {largest} rows, more than {MOST_ROWS}")

    def gradients(self, state: DataFrame, k: int, weighted: bool) -> DataFrame:
        """``state`` (_label, _weight, score, ...) with grad and hess."""
        kind = T.ArrayType(T.DoubleType()) if k > 1 else T.DoubleType()
        schema = T.StructType([*state.schema.fields, T.StructField("grad", kind), T.StructField("hess", kind)])
        names = state.columns
        at = [names.index(c) for c in ("_label", "score", "_weight")]

        def add(rows: pa.RecordBatch | pa.Table) -> list[pa.Array]:
            label, score, weight = (c.combine_chunks() if isinstance(c := rows.column(i), pa.ChunkedArray) else c for i in at)
            y, w = np.asarray(label, float), np.asarray(weight, float)
            s = np.asarray(score.flatten(), float).reshape(len(y), k) if k > 1 else np.asarray(score, float)
            out = [np.asarray(x, float) for x in self._call(y, s, w)]
            if any(x.shape != s.shape for x in out) or len(out) != 2:
                raise ValueError("an objective gives gradients and hessians of the shape of the scores")
            if weighted and self.arguments == 2:
                out = [x * (w[:, None] if k > 1 else w) for x in out]
            if k == 1:
                return [pa.array(x) for x in out]
            return [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, k, np.int32)), pa.array(x.ravel())) for x in out]

        if self.arguments == 4:
            self._sizes(state, "_query")
            return state.groupBy("_query").applyInArrow(lambda t: pa.table([*t.columns, *add(t)], [*names, "grad", "hess"]), schema).cache()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([*batch.columns, *add(batch)], [*names, "grad", "hess"])

        return state.mapInArrow(run, schema)

    def metric(self, flat: DataFrame) -> list[tuple[str, float, bool]]:
        """The metric of ``flat`` (label, score, weight and, for whole queries, query_id)."""
        several = dict(flat.dtypes)["score"].startswith("array")

        def judge(rows: pa.RecordBatch | pa.Table) -> tuple[str, float, bool, float]:
            label, score, weight = (np.asarray(rows.column(c).combine_chunks() if isinstance(rows, pa.Table) else rows.column(c)) for c in ("label", "score", "weight"))
            s = np.stack([np.asarray(x, float) for x in score]) if several else score.astype(float)
            name, value, higher = self._call(label.astype(float), s, weight.astype(float))
            return name, float(value), bool(higher), 1.0 if self.arguments == 4 else float(weight.sum())

        out = "name string, value double, higher boolean, w double"
        table = lambda found: [pa.array([x], t) for x, t in zip(found, (pa.string(), pa.float64(), pa.bool_(), pa.float64()), strict=True)]
        names = ["name", "value", "higher", "w"]
        if self.arguments == 4:
            self._sizes(flat, "query_id")
            parts = flat.select("query_id", "label", "score", "weight").groupBy("query_id").applyInArrow(lambda t: pa.table(table(judge(t)), names), out)
        else:

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    if len(batch):
                        yield pa.RecordBatch.from_arrays(table(judge(batch)), names)

            parts = flat.select("label", "score", "weight").mapInArrow(run, out)
        rows = parts.groupBy("name", "higher").agg((F.sum(F.col("value") * F.col("w")) / F.sum("w")).alias("value")).collect()
        return [(r["name"], r["value"], r["higher"]) for r in rows]
