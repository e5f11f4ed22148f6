"""Ranking gradients of whole queries, batch by batch in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Gradients = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def whole_queries(rows: DataFrame, schema: T.StructType, gradients: Gradients) -> DataFrame:
    """``rows`` (columns of ``schema``, _query, _y, _s), a query's rows next to each other, with grad and hess in place of the last
    three. A query that goes on in the next batch waits for it."""
    names = schema.names

    def close(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        table = table.combine_chunks()
        g, h = gradients(np.diff(np.append(starts, len(table))), np.asarray(table.column("_y")), np.asarray(table.column("_s")))
        columns = [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns[: len(names)]]
        return pa.RecordBatch.from_arrays([*columns, pa.array(g), pa.array(h)], [*names, "grad", "hess"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            code = np.asarray(table.column("_query").combine_chunks().dictionary_encode().indices.fill_null(-1)) if table.num_rows else np.zeros(0)
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]]) if len(code) else np.zeros(0, int)
            if len(starts) > 1:
                yield close(table.slice(0, starts[-1]), starts[:-1])
                table = table.slice(starts[-1])
            held = table
        if held is not None and held.num_rows:
            yield close(held, np.zeros(1, int))

    out = T.StructType([*schema.fields, T.StructField("grad", T.DoubleType()), T.StructField("hess", T.DoubleType())])
    return rows.mapInArrow(run, out)


def pair_gradients(sizes: np.ndarray, y: np.ndarray, s: np.ndarray, sigmoid: float, truncation: int, norm: bool) -> tuple[np.ndarray, np.ndarray]:
    """Lambdas and hessians of queries of ``sizes`` rows, each by falling score: one step a place of the first ``truncation``, over all
    later rows of all queries at once."""
    first = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(sizes)), sizes)
    rank = np.arange(len(y)) - first[owner]
    gain, discount = np.exp2(y) - 1.0, 1.0 / np.log2(2.0 + rank)
    ideal = np.lexsort((-y, owner))
    best = np.bincount(owner, np.where(rank < truncation, gain[ideal] * discount, 0.0), len(sizes))
    spread = s[first] != s[first + sizes - 1] if len(sizes) else np.zeros(0, bool)
    g, h, total = np.zeros(len(y)), np.zeros(len(y)), np.zeros(len(sizes))
    for place in range(min(truncation, int(sizes.max(initial=0)))):
        later = np.flatnonzero((rank > place) & (best[owner] > 0))
        if not len(later):
            break
        top = first[owner[later]] + place
        keep = y[top] != y[later]
        later, top = later[keep], top[keep]
        q, up = owner[later], y[top] > y[later]
        delta = np.where(up, s[top] - s[later], s[later] - s[top])
        gap = np.abs(gain[top] - gain[later]) * np.abs(discount[top] - discount[later]) / best[q]
        if norm:
            gap = np.where(spread[q], gap / (0.01 + np.abs(delta)), gap)
        p = 1.0 / (1.0 + np.exp(np.minimum(sigmoid * delta, 700.0)))
        push, bend = sigmoid * gap * p, sigmoid * sigmoid * gap * p * (1.0 - p)
        toward = np.where(up, -push, push)  # the earlier row's
        np.add.at(g, top, toward)
        g[later] -= toward
        np.add.at(h, top, bend)
        h[later] += bend
        total += 2 * np.bincount(q, push, len(sizes))
    if norm:
        factor = np.where(total > 0, np.log2(1.0 + total) / np.where(total > 0, total, 1.0), 1.0)
        g, h = g * factor[owner], h * factor[owner]
    return g, h
