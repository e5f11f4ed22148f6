"""Prediction: raw, transformed, leaves, contributions, early stopping. Small models are one SQL expression, which Catalyst compiles;
larger ones walk all rows of an Arrow batch through node arrays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from thicket.functions.objectives import find, transform
from thicket.operators.binning import NAN, ZERO, ZERO_MISSING
from thicket.plans.model import Model, Tree, tree_sql

#: Leaves of a model up to which it is one expression: beyond it, generated code gets too long.
EXPRESSION_LEAVES = 640


def _check_features(df: DataFrame, model: Model) -> None:
    gone = [f for f in model.features if f not in df.columns]
    if gone:
        raise ValueError(f"features are missing: {', '.join(gone)}")


def raw_columns(model: Model, trees: list[Tree], average: bool) -> list[Column]:
    k, n = model.num_class, max(1, len(trees) // model.num_class)
    out = []
    for c in range(k):
        each = [F.expr(tree_sql(t, model.features, quote="`")) for t in trees[c::k]]
        total = each[0] if each else F.lit(0.0)
        for x in each[1:]:
            total = total + x
        out.append(total / n if average else total)
    return out


# --- batches ------------------------------------------------------------------------------------------------------------


def leaves_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Leaf of every row of a matrix of raw values (nan: missing), level by level."""
    at = np.zeros(len(x), np.int64) if tree.nodes else np.full(len(x), -1)
    for _ in range(len(tree.nodes)):
        inner = np.flatnonzero(at >= 0)
        if not len(inner):
            break
        for i in np.unique(at[inner]):
            n, mine = tree.nodes[i], inner[at[inner] == i]
            v = x[mine, n.feature]
            gone = np.isnan(v)
            if n.cats is not None:
                left = np.isin(np.trunc(np.where(gone | (v <= -1), -1, v)), n.cats)
            else:
                if n.missing != NAN:
                    v = np.where(gone, 0.0, v)
                    gone = (np.abs(v) <= ZERO) if n.missing == ZERO_MISSING else np.zeros(len(v), bool)
                left = np.where(gone, n.default_left, v <= n.threshold)
            at[mine] = np.where(left, n.left, n.right)
    return ~at


def values_of(tree: Tree, x: np.ndarray) -> np.ndarray:
    leaf = leaves_of(tree, x)
    out = np.array([v.value for v in tree.leaves])[leaf]
    if tree.linear:
        for i, one in enumerate(tree.leaves):
            mine = np.flatnonzero(leaf == i)
            if one.const is not None and len(mine):
                v = x[mine][:, one.features]
                good = ~np.isnan(v).any(1)
                out[mine[good]] = one.const + v[good] @ np.array(one.coefs) if one.features else one.const
    return out


def _matrix(batch: pa.RecordBatch, n: int) -> np.ndarray:
    columns = [np.asarray(batch.column(batch.num_columns - n + i).cast(pa.float64()).fill_null(np.nan)) for i in range(n)]
    return np.stack(columns, 1) if n else np.zeros((len(batch), 0))


def compact(trees: list[Tree]) -> tuple[list[Tree], list[int]]:
    """Trees whose features are numbered anew, from 0 on, and the old numbers of these."""
    used = sorted({n.feature for t in trees for n in t.nodes})
    at = {f: i for i, f in enumerate(used)}
    if any(t.linear for t in trees):
        raise ValueError("linear trees need columns")
    return [replace(t, nodes=[replace(n, feature=at[n.feature]) for n in t.nodes]) for t in trees], used


def _by_sparse_batch(df: DataFrame, arrays: tuple[str, str], used: list[int], name: str, element: T.DataType, compute) -> DataFrame:  # noqa: ANN001
    """As ``_by_batch``, on sparse rows: only features that trees use become a matrix, a portion of rows at a time."""
    from thicket.operators.sparse import entries

    kept, width = df.columns, len(df.columns)
    kind = pa.float64() if isinstance(element, T.DoubleType) else pa.int32()
    lookup = np.full(max(used, default=0) + 2, -1)
    lookup[used] = np.arange(len(used))
    rows_at_once = max(1, (1 << 22) // max(1, len(used)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401

        for whole in batches:
            for start in range(0, len(whole), rows_at_once):
                batch = whole.slice(start, rows_at_once)
                row, feature, value = entries(batch, width)
                at = lookup[np.clip(feature, -1, len(lookup) - 1)]
                mine = (feature >= 0) & (feature < len(lookup)) & (at >= 0)
                x = np.zeros((len(batch), len(used)))
                x[row[mine], at[mine]] = value[mine]
                values = compute(x)
                ends = np.arange(0, values.size + 1, max(1, values.shape[1])).astype(np.int32)[: len(batch) + 1]
                yield pa.RecordBatch.from_arrays([*batch.columns[:width], pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), kind, safe=False))], [*kept, name])

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(element))])
    return df.select(*kept, *(F.col(c).alias(f"_arrays_{i}") for i, c in enumerate(arrays))).mapInArrow(run, schema)


def _by_batch(df: DataFrame, model: Model, name: str, kind: str, compute) -> DataFrame:  # noqa: ANN001
    kept, n = df.columns, len(model.features)
    arrow = {"array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32())}[kind]
    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType() if kind == "array<double>" else T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = compute(_matrix(batch, n))
            flat = pa.array(values.ravel().astype(np.float64 if kind == "array<double>" else np.int32))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, max(1, values.shape[1])).astype(np.int32)[: len(batch) + 1]), flat).cast(arrow)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], lists], [*kept, name])

    inputs = df.select(*kept, *(F.col(f"`{f}`").cast("double").alias(f"_f{i}") for i, f in enumerate(model.features)))
    return inputs.mapInArrow(run, schema)


def predict(df: DataFrame, model: Model, mode: str = "prediction", name: str = "prediction", start: int = 0, iterations: int = -1, engine: str = "auto", margin: float = 10.0, freq: int = 10, sparse: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with one more column. ``sparse``: the names of two array columns that hold the numbers and values of each row's features that aren't zero.

    mode: ``raw`` and ``prediction`` (a double, an array for several classes), ``leaf`` (an array of leaf numbers, iteration by
    iteration), ``contrib`` (an array of feature contributions and the expected value, class by class), ``early_stop`` (raw
    scores that stop growing once the margin is reached). Works on streams, as it looks at one row at a time.
    """
    trees = model.of_range(start, iterations)
    if sparse:
        return _sparse(df, model, trees, mode, name, sparse)
    _check_features(df, model)
    if mode == "leaf":
        return _leaf(df, model, trees, name, engine)
    if mode == "contrib":
        from thicket.plans.shap import contributions

        if any(t.linear for t in trees):
            raise ValueError("contributions of linear trees aren't defined")
        return _by_batch(df, model, name, "array<double>", lambda x: contributions(trees, model.num_class, len(model.features), x, model.average))
    if mode == "early_stop":
        return _early_stop(df, model, trees, name, margin, freq)
    if mode not in ("raw", "prediction"):
        raise ValueError(f"unknown mode {mode!r}")
    leaves = sum(len(t.leaves) for t in trees)
    if engine == "expression" or (engine == "auto" and leaves <= EXPRESSION_LEAVES):
        columns = raw_columns(model, trees, model.average)
        out = df.withColumn("_raw", F.array(*columns) if model.num_class > 1 else columns[0])
    else:
        k, n = model.num_class, max(1, len(trees) // model.num_class)

        def scores(x: np.ndarray) -> np.ndarray:
            sums = np.stack([sum((values_of(t, x) for t in trees[c::k]), np.zeros(len(x))) for c in range(k)], 1)
            return sums / n if model.average else sums

        out = _by_batch(df, model, "_raw", "array<double>", scores)
        if k == 1:
            out = out.withColumn("_raw", F.element_at("_raw", 1))
    value = F.col("_raw") if mode == "raw" else transform(model.objective, F.col("_raw"), model.sigmoid, model.squared)
    return out.withColumn(name, value).drop("_raw")


def _sparse(df: DataFrame, model: Model, trees: list[Tree], mode: str, name: str, arrays: tuple[str, str]) -> DataFrame:
    if mode not in ("raw", "prediction", "leaf"):
        raise ValueError(f"{mode} needs columns")
    k, n = model.num_class, max(1, len(trees) // model.num_class)
    own, used = compact(trees)
    if mode == "leaf":
        return _by_sparse_batch(df, arrays, used, name, T.IntegerType(), lambda x: np.stack([leaves_of(t, x) for t in own], 1))

    def scores(x: np.ndarray) -> np.ndarray:
        sums = np.stack([sum((values_of(t, x) for t in own[c::k]), np.zeros(len(x))) for c in range(k)], 1)
        return sums / n if model.average else sums

    out = _by_sparse_batch(df, arrays, used, "_raw", T.DoubleType(), scores)
    raw = F.col("_raw")[0] if k == 1 else F.col("_raw")
    return out.withColumn(name, raw if mode == "raw" else transform(model.objective, raw, model.sigmoid, model.squared)).drop("_raw")


def add_trees(df: DataFrame, model: Model, trees: list[Tree], classes: list[int], score: str, factor: float = 1.0, sparse: tuple[str, str] | None = None) -> DataFrame:
    """``df`` with the outputs of trees, times ``factor``, added to its column ``score`` (an array if there are several classes); ``classes``: of each tree.
    Few leaves are one expression, many go by batches, so the plan doesn't grow with the trees."""
    k = model.num_class
    if sparse:
        trees, used = compact(trees)
    elif sum(len(t.leaves) for t in trees) <= EXPRESSION_LEAVES:
        sums = [sum((F.expr(tree_sql(t, model.features, quote="`")) for t, c in zip(trees, classes, strict=True) if c == i), F.lit(0.0)) * factor for i in range(k)]
        total = F.col(score) + sums[0] if k == 1 else F.array(*(F.col(score)[i] + x for i, x in enumerate(sums)))
        return df.withColumn(score, total)
    more = "_more_" + score

    def outputs(x: np.ndarray) -> np.ndarray:
        return factor * np.stack([sum((values_of(t, x) for t, c in zip(trees, classes, strict=True) if c == i), np.zeros(len(x))) for i in range(k)], 1)

    out = _by_sparse_batch(df, sparse, used, more, T.DoubleType(), outputs) if sparse else _by_batch(df, model, more, "array<double>", outputs)
    total = F.col(score) + F.col(more)[0] if k == 1 else F.zip_with(score, more, lambda a, b: a + b)
    return out.withColumn(score, total).drop(more)


def _leaf(df: DataFrame, model: Model, trees: list[Tree], name: str, engine: str) -> DataFrame:
    if engine != "batch" and sum(len(t.leaves) for t in trees) <= EXPRESSION_LEAVES:
        return df.withColumn(name, F.array(*(F.expr(tree_sql(t, model.features, "leaf", "`")) for t in trees)).cast("array<int>"))
    return _by_batch(df, model, name, "array<int>", lambda x: np.stack([leaves_of(t, x) for t in trees], 1))


def _early_stop(df: DataFrame, model: Model, trees: list[Tree], name: str, margin: float, freq: int) -> DataFrame:
    """Every ``freq`` iterations rows whose margin exceeds ``margin`` stop: twice the score's size for one class, else the
    lead of the first over the second. Objectives that need exact sums don't stop."""
    kind, k = find(model.objective).kind, model.num_class
    stops = kind in ("binary", "multiclass")

    def scores(x: np.ndarray) -> np.ndarray:
        out, live = np.zeros((len(x), k)), np.arange(len(x))
        for i in range(len(trees) // k):
            for c in range(k):
                out[live, c] += values_of(trees[i * k + c], x[live])
            if stops and (i + 1) % freq == 0:
                s = out[live]
                lead = 2 * np.abs(s[:, 0]) if k == 1 else -np.diff(np.sort(s, 1)[:, ::-1][:, :2], axis=1)[:, 0]
                live = live[lead <= margin]
        return out / max(1, len(trees) // k) if model.average else out

    out = _by_batch(df, model, name, "array<double>", scores)
    return out.withColumn(name, F.element_at(name, 1)) if k == 1 else out
