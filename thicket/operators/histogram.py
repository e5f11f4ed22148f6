"""Histograms: sums of gradients, hessians and rows for every (leaf, feature, bin)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def melt_bins(df: DataFrame, bins: list[str], keep: list[str]) -> DataFrame:
    """A row for each row and feature: keep..., feature, bin."""
    pairs = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(c).cast("int").alias("bin")) for i, c in enumerate(bins)))
    return df.select(*keep, F.explode(pairs).alias("_m")).select(*keep, "_m.feature", "_m.bin")


def by_columns(df: DataFrame, bins: list[str], leaf: str = "leaf", grad: str = "grad", hess: str = "hess") -> DataFrame:
    """leaf, feature, bin, g, h, n: one aggregation that combines before the shuffle. Whole numbers stay whole."""
    rows = melt_bins(df, bins, [leaf, grad, hess])
    return rows.groupBy(F.col(leaf).alias("leaf"), "feature", "bin").agg(F.sum(grad).alias("g"), F.sum(hess).alias("h"), F.count(F.lit(1)).alias("n"))


#: Of the arrays of bins of a batch, the leaf of each row; -1 for rows that don't count.
Route = Callable[[list[np.ndarray]], np.ndarray]


def by_batches(df: DataFrame, bins: list[str], leaf: str | Route = "leaf", grad: str = "grad", hess: str = "hess", combine: bool = True) -> DataFrame:
    """The same sums, counted batch by batch in a table that a task keeps, so that a task sends each (leaf, feature, bin) once
    however many rows it has, and rows aren't melted. ``leaf``: a column, or a function of the bins; with that, one compiled plan serves
    all searches of a tree. Without ``combine`` each task's sums come as rows of their own."""
    width, routed = len(bins), not isinstance(leaf, str)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            g, h = np.asarray(batch.column(0), float), np.asarray(batch.column(1), float)
            columns = [np.asarray(batch.column(2 + i)).astype(np.int64) for i in range(width)]
            leaves = leaf(columns) if routed else np.asarray(batch.column(2 + width))
            mine = np.flatnonzero(leaves >= 0)
            if not len(mine):
                continue
            if len(mine) < len(leaves):
                g, h, leaves, columns = g[mine], h[mine], leaves[mine], [c[mine] for c in columns]
            every, place = np.unique(leaves, return_inverse=True)
            for f, b in enumerate(columns):
                size = int(b.max()) + 1
                code, n = place * size + b, len(every) * size
                new = np.stack([np.bincount(code, g, n), np.bincount(code, h, n), np.bincount(code, minlength=n)]).reshape(3, len(every), size)
                for i, one in enumerate(every.tolist()):
                    old = sums.get((one, f))
                    if old is None or old.shape[1] < size:
                        wide = np.zeros((3, size))
                        if old is not None:
                            wide[:, : old.shape[1]] = old
                        old = sums[one, f] = wide
                    old[:, :size] += new[:, i]
        for (one, f), table in sums.items():
            at = np.flatnonzero(table[2])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), one, np.int32)), pa.array(np.full(len(at), f, np.int32)), pa.array(at.astype(np.int32)), *(pa.array(table[i][at]) for i in range(2)), pa.array(table[2][at].astype(np.int64))],
                ["leaf", "feature", "bin", "g", "h", "n"],
            )

    rows = df.selectExpr(f"CAST(`{grad}` AS DOUBLE) AS g", f"CAST(`{hess}` AS DOUBLE) AS h", *(f"CAST(`{c}` AS INT) AS `{c}`" for c in bins), *([] if routed else [f"CAST(`{leaf}` AS INT) AS leaf"]))
    parts = rows.mapInArrow(run, "leaf int, feature int, bin int, g double, h double, n long")
    return parts.groupBy("leaf", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n")) if combine else parts


def subtract(parent: DataFrame, child: DataFrame, leaf: int) -> DataFrame:
    """The other child's histogram, under the number ``leaf``: the parent's sums less the child's; empty bins go."""
    joined = parent.select("feature", "bin", "g", "h", "n").join(child.select("feature", "bin", F.col("g").alias("cg"), F.col("h").alias("ch"), F.col("n").alias("cn")), ["feature", "bin"], "left")
    less = lambda a, b: F.col(a) - F.coalesce(F.col(b), F.lit(0))
    out = joined.select(F.lit(leaf).alias("leaf"), "feature", "bin", less("g", "cg").alias("g"), less("h", "ch").alias("h"), less("n", "cn").alias("n"))
    return out.where("n > 0")


def leaf_totals(df: DataFrame, leaf: str = "leaf", grad: str = "grad", hess: str = "hess") -> DataFrame:
    """leaf, g, h, n."""
    return df.groupBy(F.col(leaf).alias("leaf")).agg(F.sum(grad).alias("g"), F.sum(hess).alias("h"), F.count(F.lit(1)).alias("n"))


def restore_most_frequent(hist: DataFrame, totals: DataFrame, most_frequent: DataFrame) -> DataFrame:
    """A histogram without each feature's most frequent bin gets it back: a leaf's totals less its other bins."""
    others = hist.join(most_frequent, "feature").where("bin <> most_frequent").drop("most_frequent")
    sums = others.groupBy("leaf", "feature").agg(F.sum("g").alias("og"), F.sum("h").alias("oh"), F.sum("n").alias("on"))
    every = totals.withColumn("one", F.lit(1)).join(most_frequent.withColumn("one", F.lit(1)), "one").drop("one").join(sums, ["leaf", "feature"], "left")
    less = lambda a, b: F.col(a) - F.coalesce(F.col(b), F.lit(0))
    back = every.select("leaf", "feature", F.col("most_frequent").alias("bin"), less("g", "og").alias("g"), less("h", "oh").alias("h"), less("n", "on").alias("n"))
    return others.unionByName(back.where("n > 0"))


# --- whole-number gradients --------------------------------------------------------------------------------------------


def _away(x: Column) -> Column:
    """Rounds half away from zero to a whole number."""
    return (F.floor(F.abs(x) + 0.5) * F.when(x < 0, -1).otherwise(1)).cast("long")


def quantise(df: DataFrame, bins: int = 4, hessian_one: bool = False, stochastic: str | None = None, seed: int = 0, grad: str = "grad", hess: str = "hess") -> tuple[DataFrame, float, float]:
    """``df`` with qg and qh, whole numbers of steps, and the two steps. Sums of them are exact in any order. ``stochastic``: a row
    key; then a value is rounded up with the probability of its fraction, drawn from the key."""
    top = df.agg(F.max(F.abs(grad)).alias("g"), F.max(F.abs(hess)).alias("h")).first()
    gs = (top["g"] or 0.0) / (bins / 2) or 1.0
    hs = (top["h"] or 0.0) / (1 if hessian_one else bins) or 1.0
    g, h = F.col(grad) / gs, F.col(hess) / hs
    return df.withColumns({"qg": _whole(g, stochastic, seed, "g", True), "qh": F.lit(1).cast("long") if hessian_one else _whole(h, stochastic, seed, "h", False)}), gs, hs


def _whole(x: Column, stochastic: str | None, seed: int, salt: str, signed: bool) -> Column:
    if not stochastic:
        return _away(x)
    from thicket.functions.objectives import uniform

    up = F.floor(F.abs(x) + uniform(stochastic, F.lit(seed), F.lit(salt)))
    return (up * F.when(x < 0, -1).otherwise(1)).cast("long") if signed else up.cast("long")


def quantise_classes(df: DataFrame, k: int, bins: int = 4, hessian_one: bool = False, stochastic: str | None = None, seed: int = 0) -> tuple[DataFrame, list[float], list[float]]:
    """``quantise`` of arrays grad and hess of ``k`` classes, each with steps of its own, from one aggregation."""
    top = df.agg(*(F.max(F.abs(F.col(c)[i])).alias(f"{c}{i}") for c in ("grad", "hess") for i in range(k))).first()
    gs = [(top[f"grad{i}"] or 0.0) / (bins / 2) or 1.0 for i in range(k)]
    hs = [(top[f"hess{i}"] or 0.0) / (1 if hessian_one else bins) or 1.0 for i in range(k)]
    qg = F.array(*(_whole(F.col("grad")[i] / gs[i], stochastic, seed, "g", True) for i in range(k)))
    qh = F.array(*(F.lit(1).cast("long") if hessian_one else _whole(F.col("hess")[i] / hs[i], stochastic, seed, "h", False) for i in range(k)))
    return df.withColumns({"qg": qg, "qh": qh}), gs, hs
