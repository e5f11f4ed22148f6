"""Linear leaves: ridge regression on the numeric features of each leaf's path, from moments that Spark sums by leaf."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.plans.model import Tree


def path_features(tree: Tree, every: bool = False) -> list[list[int]]:
    """Numeric features on the path to each leaf, or ``every`` one, in order of number."""
    out: list[list[int]] = [[] for _ in tree.leaves]

    def walk(at: int, seen: set[int]) -> None:
        if at < 0:
            out[~at] = sorted(seen)
        else:
            n = tree.nodes[at]
            own = seen | ({n.feature} if every or n.cats is None else set())
            walk(n.left, own)
            walk(n.right, own)

    walk(0 if tree.nodes else -1, set())
    return out


def moments(df: DataFrame, leaf: Column, columns: list[str], used: list[list[int]]) -> DataFrame:
    """leaf, n, and for the leaf's features x (and 1): sums of h x x', g x. Rows with a missing value of the leaf's are left out. One
    aggregation; its size depends on the tree only."""
    rows = df.withColumn("_leaf", leaf)
    every = sorted({f for own in used for f in own})
    gone = F.lit(False)
    for i, own in enumerate(used):
        bad = F.lit(False)
        for f in own:
            v = F.col(f"`{columns[f]}`").cast("double")
            bad = bad | v.isNull() | F.isnan(v)
        gone = F.when(F.col("_leaf") == i, bad).otherwise(gone)
    rows = rows.where(~gone)
    value = lambda f: F.coalesce(F.nanvl(F.col(f"`{columns[f]}`").cast("double"), F.lit(0.0)), F.lit(0.0)) if f >= 0 else F.lit(1.0)
    terms = [*every, -1]
    sums = [F.count(F.lit(1)).alias("n")]
    for a, f in enumerate(terms):
        sums.append(F.sum(value(f) * F.col("grad")).alias(f"g{a}"))
        sums += [F.sum(value(f) * value(terms[b]) * F.col("hess")).alias(f"h{a}_{b}") for b in range(a, len(terms))]
    return rows.groupBy("_leaf").agg(*sums)


def fit(df: DataFrame, leaf: Column, columns: list[str], tree: Tree, penalty: float) -> None:
    """Gives the leaves of ``tree`` their linear models; leaves with too few rows, or that can't be solved, stay constant."""
    used = path_features(tree)
    every = sorted({f for own in used for f in own})
    place = {f: i for i, f in enumerate(every)}
    for r in moments(df, leaf, columns, used).collect():  # a row a leaf
        i, own = r["_leaf"], used[r["_leaf"]]
        at = [*(place[f] for f in own), len(every)]
        if r["n"] <= len(own) + 1 or not own:
            continue
        x = np.array([[r[f"h{min(a, b)}_{max(a, b)}"] for b in at] for a in at])
        g = np.array([r[f"g{a}"] for a in at])
        x[np.arange(len(own)), np.arange(len(own))] += penalty
        try:
            beta = -np.linalg.solve(x, g)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(beta).all():
            tree.leaves[i].features, tree.leaves[i].coefs, tree.leaves[i].const = own, beta[:-1].tolist(), float(beta[-1])
