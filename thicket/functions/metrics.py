"""Evaluation metrics. Pointwise ones are a single aggregation over Columns; sorted ones group equal scores first and then run
over the distinct scores; ranking ones use a window for each query. Every metric takes an optional weight column."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.objectives import discount
from thicket.functions.ordered import running

_EPS = 1e-15


def _safe_log(x: Column) -> Column:
    return F.when(x > 0, F.log(x)).otherwise(F.lit(float("-inf")))


def _clip_log(p: Column, least: float = _EPS) -> Column:
    return F.log(F.greatest(p, F.lit(least)))


#: Losses of one row: s is the transformed score (raw for ``cross_entropy_lambda``), y the label.
LOSSES: dict[str, Callable[..., Column]] = {
    "l2": lambda s, y, **_: (s - y) * (s - y),
    "rmse": lambda s, y, **_: (s - y) * (s - y),
    "l1": lambda s, y, **_: F.abs(s - y),
    "quantile": lambda s, y, alpha=0.9, **_: F.when(y - s < 0, (alpha - 1.0) * (y - s)).otherwise(alpha * (y - s)),
    "huber": lambda s, y, alpha=0.9, **_: F.when(F.abs(s - y) <= alpha, 0.5 * (s - y) * (s - y)).otherwise(alpha * (F.abs(s - y) - 0.5 * alpha)),
    "fair": lambda s, y, fair_c=1.0, **_: fair_c * F.abs(s - y) - fair_c * fair_c * F.log1p(F.abs(s - y) / fair_c),
    "poisson": lambda s, y, **_: F.greatest(s, F.lit(1e-10)) - y * F.log(F.greatest(s, F.lit(1e-10))),
    "mape": lambda s, y, **_: F.abs(y - s) / F.greatest(F.lit(1.0), F.abs(y)),
    # psi is 1: -(y * theta - b) / a - c, with theta = -1 / s, b = -log(-theta), c = log(y / psi) / psi - log(y) - lgamma(1 / psi)
    "gamma": lambda s, y, **_: y / s + _safe_log(s),
    "gamma_deviance": lambda s, y, **_: y / (s + 1e-9) - _safe_log(y / (s + 1e-9)) - 1.0,
    "tweedie": lambda s, y, tweedie_variance_power=1.5, **_: _tweedie(s, y, tweedie_variance_power),
    "binary_logloss": lambda s, y, **_: -F.when(y > 0, _clip_log(s)).otherwise(_clip_log(1.0 - s)),
    "binary_error": lambda s, y, **_: F.when((s <= 0.5) == (y > 0), 1.0).otherwise(0.0),
    "cross_entropy": lambda s, y, **_: -(y * _clip_log(s, 1e-12) + (1.0 - y) * _clip_log(1.0 - s, 1e-12)),
    "cross_entropy_lambda": lambda s, y, **_: _lambda_loss(s, y),
    "kullback_leibler": lambda s, y, **_: -(y * _clip_log(s, 1e-12) + (1.0 - y) * _clip_log(1.0 - s, 1e-12)) + F.when(y > 0, y * F.log(y)).otherwise(0.0) + F.when(y < 1, (1.0 - y) * F.log(1.0 - y)).otherwise(0.0),
    "multi_logloss": lambda s, y, **_: -_clip_log(F.element_at(s, y.cast("int") + 1)),
    "multi_error": lambda s, y, multi_error_top_k=1, **_: F.when(F.size(F.filter(s, lambda v: v >= F.element_at(s, y.cast("int") + 1))) > multi_error_top_k, 1.0).otherwise(0.0),
}


def _tweedie(s: Column, y: Column, r: float) -> Column:
    x = F.greatest(s, F.lit(1e-10))
    return -y * F.exp((1 - r) * F.log(x)) / (1 - r) + F.exp((2 - r) * F.log(x)) / (2 - r)


def _lambda_loss(s: Column, y: Column) -> Column:
    z = 1.0 - F.exp(-F.log1p(F.exp(s)))
    return -(y * _clip_log(z, 1e-12) + (1.0 - y) * _clip_log(1.0 - z, 1e-12))


@dataclass(frozen=True)
class Metric:
    name: str
    higher_is_better: bool = False
    raw: bool = False


METRICS = {m.name: m for m in [*(Metric(n, raw=n == "cross_entropy_lambda") for n in LOSSES), Metric("auc", True, True), Metric("average_precision", True, True), Metric("auc_mu", True, True), Metric("ndcg", True, True), Metric("map", True, True)]}
#: Other names of metrics.
ALIASES = {
    "mean_absolute_error": "l1", "mae": "l1", "regression_l1": "l1",
    "mean_squared_error": "l2", "mse": "l2", "regression": "l2", "regression_l2": "l2",
    "root_mean_squared_error": "rmse", "l2_root": "rmse",
    "mean_absolute_percentage_error": "mape", "gamma-deviance": "gamma_deviance",
    "binary": "binary_logloss", "multiclass": "multi_logloss", "softmax": "multi_logloss", "multiclassova": "multi_logloss", "multiclass_ova": "multi_logloss", "ova": "multi_logloss", "ovr": "multi_logloss",
    "xentropy": "cross_entropy", "xentlambda": "cross_entropy_lambda", "kldiv": "kullback_leibler",
    "mean_average_precision": "map", "lambdarank": "ndcg", "rank_xendcg": "ndcg", "xendcg": "ndcg", "xe_ndcg": "ndcg", "xe_ndcg_mart": "ndcg", "xendcg_mart": "ndcg",
}
EVAL_AT = (1, 2, 3, 4, 5)


def find(name: str) -> Metric | None:
    """None for names that aren't known, which callers drop."""
    return METRICS.get(ALIASES.get(name, name))


def parse(names: str | list[str] | None, objective: str) -> list[str]:
    """Metric names, aliases resolved, without repeats; by default the objective's own."""
    listed = names.replace(" ", "").split(",") if isinstance(names, str) else list(names or [])
    listed = [n for n in listed if n]
    if {"none", "null", "custom", "na"} & set(listed):
        return []
    found = [m.name for n in (listed or [objective]) if (m := find(n))]
    return list(dict.fromkeys(found))


def _mean_loss(name: str, score: str = "score", label: str = "label", weight: str | None = None, **options: Any) -> Column:
    w = F.col(weight) if weight else F.lit(1.0)
    loss = F.sum(LOSSES[name](F.col(score), F.col(label).cast("double"), **options) * w)
    if name == "gamma_deviance":
        return 2.0 * loss
    value = loss / F.sum(w)
    return F.sqrt(value) if name == "rmse" else value


def pointwise(df: DataFrame, name: str, score: str = "score", label: str = "label", weight: str | None = None, **options: Any) -> DataFrame:
    """One row: metric, value."""
    return df.agg(_mean_loss(name, score, label, weight, **options).alias("value")).select(F.lit(name).alias("metric"), "value")


def _by_score(df: DataFrame, score: str, label: str, weight: str | None) -> DataFrame:
    """Positive and negative weight at every distinct score, with the sums above it."""
    w = F.col(weight) if weight else F.lit(1.0)
    sums = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.when(F.col(label) > 0, w).otherwise(0.0)).alias("p"), F.sum(F.when(F.col(label) > 0, 0.0).otherwise(w)).alias("n"))
    return running(sums, "s", ["p", "n"], descending=True)


def auc(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """Area under the ROC curve; equal scores count half; 1 if a class is absent."""
    sums = _by_score(df, score, label, weight)
    area = F.sum(F.col("n") * (F.col("before_p") + 0.5 * F.col("p")))
    both = F.sum("p") * F.sum("n")
    return sums.agg(F.when(both > 0, area / both).otherwise(1.0).alias("value")).select(F.lit("auc").alias("metric"), "value")


def average_precision(df: DataFrame, score: str = "score", label: str = "label", weight: str | None = None) -> DataFrame:
    """Mean precision at the positives, equal scores together; 1 if a class is absent."""
    sums = _by_score(df, score, label, weight)
    precision = (F.col("before_p") + F.col("p")) / (F.col("before_p") + F.col("p") + F.col("before_n") + F.col("n"))
    value = F.when((F.sum("p") > 0) & (F.sum("n") > 0), F.sum(F.col("p") * precision) / F.sum("p")).otherwise(1.0)
    return sums.agg(value.alias("value")).select(F.lit("average_precision").alias("metric"), "value")


def auc_mu(df: DataFrame, num_class: int, score: str = "score", label: str = "label", weights: list[list[float]] | None = None) -> DataFrame:
    """Mean over class pairs of the AUC along the pair's separating direction; ``score`` is an array, ``weights`` the loss matrix."""
    a = weights or [[0.0 if i == j else 1.0 for j in range(num_class)] for i in range(num_class)]
    pairs = [(i, j) for i in range(num_class) for j in range(i + 1, num_class)]
    own = F.col(label).cast("int")
    out = []
    for i, j in pairs:
        v = [a[i][m] - a[j][m] for m in range(num_class)]
        t = v[i] - v[j]
        along = sum((F.element_at(score, m + 1) * (t * v[m]) for m in range(num_class)), F.lit(0.0))
        out.append(F.when((own == i) | (own == j), F.struct(F.lit(f"{i}-{j}").alias("pair"), F.round(along, 12).alias("d"), (own == i).alias("first"))))
    rows = df.select(F.explode(F.filter(F.array(*out), lambda x: x.isNotNull())).alias("e")).select("e.*")
    sums = rows.groupBy("pair", "d").agg(F.count_if("first").cast("double").alias("p"), F.count_if(~F.col("first")).cast("double").alias("n"))
    sums = running(sums, "d", ["p"], descending=True, by=["pair"])
    each = sums.groupBy("pair").agg((F.sum(F.col("n") * (F.col("before_p") + 0.5 * F.col("p"))) / (F.sum("p") * F.sum("n"))).alias("v"))
    return each.agg((F.sum("v") / len(pairs)).alias("value")).select(F.lit("auc_mu").alias("metric"), "value")


def _ranked(df: DataFrame, query: str, label: str, score: str, order: str) -> DataFrame:
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(query).orderBy(F.desc(score), order)))


def ndcg(df: DataFrame, at: tuple[int, ...] = EVAL_AT, query: str = "query_id", label: str = "label", score: str = "score", order: str = "row_id") -> DataFrame:
    """k, value: mean over queries; a query without any gain counts 1. Equal scores keep the order of ``order``."""
    best = Window.partitionBy(query).orderBy(F.desc(label), order)
    both = _ranked(df, query, label, score, order).withColumn("_b", F.row_number().over(best))
    gain = F.pow(F.lit(2.0), F.col(label)) - 1.0
    sums = both.groupBy(query).agg(
        *(F.sum(F.when(F.col("_r") <= k, gain * discount(F.col("_r"))).otherwise(0.0)).alias(f"d{k}") for k in at), *(F.sum(F.when(F.col("_b") <= k, gain * discount(F.col("_b"))).otherwise(0.0)).alias(f"m{k}") for k in at)
    )
    means = sums.agg(*(F.avg(F.when(F.col(f"m{k}") > 0, F.col(f"d{k}") / F.col(f"m{k}")).otherwise(1.0)).alias(f"v{k}") for k in at))
    return means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("value")) for k in at))).alias("e")).select("e.k", "e.value")


def mean_average_precision(df: DataFrame, at: tuple[int, ...] = EVAL_AT, query: str = "query_id", label: str = "label", score: str = "score", order: str = "row_id") -> DataFrame:
    """k, value: labels over 0.5 are hits; a query without hits counts 1."""
    hit = F.when(F.col(label) > 0.5, 1.0).otherwise(0.0)
    w = Window.partitionBy(query).orderBy("_r")
    rows = _ranked(df, query, label, score, order).withColumn("_hit", hit).withColumn("_hits", F.sum("_hit").over(w))
    sums = rows.groupBy(query).agg(F.sum("_hit").alias("n"), *(F.sum(F.when(F.col("_r") <= k, F.col("_hit") * F.col("_hits") / F.col("_r")).otherwise(0.0)).alias(f"s{k}") for k in at))
    means = sums.agg(*(F.avg(F.when(F.col("n") > 0, F.col(f"s{k}") / F.least(F.col("n"), F.lit(float(k)))).otherwise(1.0)).alias(f"v{k}") for k in at))
    return means.select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(f"v{k}").alias("value")) for k in at))).alias("e")).select("e.k", "e.value")


def evaluate(df: DataFrame, name: str, num_class: int = 1, eval_at: tuple[int, ...] = EVAL_AT, weight: str | None = None, raw: str = "raw", score: str = "score", **options: Any) -> list[tuple[str, float, bool]]:
    """(name, value, higher is better) on columns raw, score (transformed), label and, for ranking, query_id and row_id."""
    m = find(name)
    if m is None:
        return []
    column = raw if m.raw else score
    if m.name in ("ndcg", "map"):
        rows = (ndcg if m.name == "ndcg" else mean_average_precision)(df, eval_at, score=column).collect()
        return [(f"{m.name}@{r['k']}", r["value"], True) for r in rows]
    if m.name in ("auc", "average_precision"):
        found = {"auc": auc, "average_precision": average_precision}[m.name](df, column, weight=weight)
    elif m.name == "auc_mu":
        found = auc_mu(df, num_class, column, weights=options.get("auc_mu_weights"))
    else:
        found = pointwise(df, m.name, column, weight=weight, **options)
    return [(m.name, found.first()["value"], m.higher_is_better)]


#: Metrics that need rows in an order, by queries or scores.
ORDERED = ("ndcg", "map", "auc", "average_precision", "auc_mu")


def evaluate_all(df: DataFrame, names: list[str], num_class: int = 1, eval_at: tuple[int, ...] = EVAL_AT, weight: str | None = None, raw: str = "raw", score: str = "score", by: str | None = None, **options: Any) -> list[Any]:
    """``evaluate`` of several metrics, in their order: all that are means over rows come from one aggregation. ``by``: a column of whole numbers from 0
    on; then a list of such lists, one for each of its values, point-wise metrics of all values from the same aggregation."""
    found = [m for n in names if (m := find(n))]
    plain = {m.name: _mean_loss(m.name, raw if m.raw else score, "label", weight, **options) for m in found if m.name not in ORDERED}
    rows = df.groupBy(*([by] if by else [])).agg(F.count(F.lit(1)).alias("_n"), *(c.alias(n) for n, c in plain.items())).collect() if plain or by else [{}]
    out = []
    for row in sorted(rows, key=lambda r: r[by] if by else 0):
        own = df.where(F.col(by) == row[by]) if by else df
        out.append([x for m in found for x in ([(m.name, row[m.name], m.higher_is_better)] if m.name in plain else evaluate(own, m.name, num_class, eval_at, weight, raw, score, **options))])
    return out if by else out[0]
