"""Objectives: gradients and hessians as Columns, initial scores, output transforms, label checks.

A pointwise objective maps a raw score and a label to a gradient and a hessian; everything stays inside whole-stage
code generation. Ranking objectives look at whole queries through windows and one join.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.ordered import percentile, weighted_percentile

Pair = tuple[Column, Column]
#: Gains of labels 0 to 30.
LABEL_GAIN = [float(2**i - 1) for i in range(31)]


def _sign(x: Column) -> Column:
    return F.when(x > 0, 1.0).when(x < 0, -1.0).otherwise(0.0)


def l2(s: Column, y: Column, **_: Any) -> Pair:
    return s - y, F.lit(1.0)


def l1(s: Column, y: Column, **_: Any) -> Pair:
    return _sign(s - y), F.lit(1.0)


def huber(s: Column, y: Column, alpha: float = 0.9, **_: Any) -> Pair:
    d = s - y
    return F.when(F.abs(d) <= alpha, d).otherwise(_sign(d) * alpha), F.lit(1.0)


def fair(s: Column, y: Column, fair_c: float = 1.0, **_: Any) -> Pair:
    x = s - y
    low = F.abs(x) + fair_c
    return fair_c * x / low, fair_c * fair_c / (low * low)


def quantile(s: Column, y: Column, alpha: float = 0.9, **_: Any) -> Pair:
    return F.when(s - y >= 0, 1.0 - alpha).otherwise(-alpha), F.lit(1.0)


def mape(s: Column, y: Column, **_: Any) -> Pair:
    return _sign(s - y) / F.greatest(F.lit(1.0), F.abs(y)), F.lit(1.0)


def poisson(s: Column, y: Column, poisson_max_delta_step: float = 0.7, **_: Any) -> Pair:
    return F.exp(s) - y, F.exp(s + poisson_max_delta_step)


def gamma(s: Column, y: Column, **_: Any) -> Pair:
    e = y * F.exp(-s)
    return 1.0 - e, e


def tweedie(s: Column, y: Column, tweedie_variance_power: float = 1.5, **_: Any) -> Pair:
    r = tweedie_variance_power
    a, b = F.exp((1 - r) * s), F.exp((2 - r) * s)
    return -y * a + b, -y * (1 - r) * a + (2 - r) * b


def binary(s: Column, y: Column, sigmoid: float = 1.0, pos_weight: float = 1.0, neg_weight: float = 1.0, **_: Any) -> Pair:
    side = F.when(y > 0, 1.0).otherwise(-1.0)
    w = F.when(y > 0, pos_weight).otherwise(neg_weight)
    r = -side * sigmoid / (1.0 + F.exp(side * sigmoid * s))
    return r * w, F.abs(r) * (sigmoid - F.abs(r)) * w


def cross_entropy(s: Column, y: Column, **_: Any) -> Pair:
    e = F.exp(-s)
    usual = ((1.0 - y) - y * e) / (1.0 + e), e / ((1.0 + e) * (1.0 + e))
    far = F.exp(s)  # p is as good as exp(s) there, and exp(-s) is out of range
    return F.when(s > -37.0, usual[0]).otherwise(far - y), F.when(s > -37.0, usual[1]).otherwise(far)


def cross_entropy_lambda(s: Column, y: Column, **_: Any) -> Pair:
    z = 1.0 / (1.0 + F.exp(-s))
    return z - y, z * (1.0 - z)


def softmax(scores: Column, y: Column, num_class: int, **_: Any) -> Pair:
    """Arrays of gradients and hessians, one entry a class."""
    top = F.array_max(scores)
    e = F.transform(scores, lambda v: F.exp(v - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    p = F.transform(e, lambda v: v / total)
    factor = num_class / (num_class - 1.0)
    return F.transform(p, lambda v, k: v - F.when(k == y.cast("int"), 1.0).otherwise(0.0)), F.transform(p, lambda v: factor * v * (1.0 - v))


def one_vs_all(scores: Column, y: Column, num_class: int, sigmoid: float = 1.0, weights: list[tuple[float, float]] | None = None, **_: Any) -> Pair:
    """A binary objective for every class; weights: (positive, negative) of each."""
    each = [binary(F.element_at(scores, k + 1), F.when(y.cast("int") == k, 1.0).otherwise(0.0), sigmoid, *(weights[k] if weights else (1.0, 1.0))) for k in range(num_class)]
    return F.array(*(g for g, _ in each)), F.array(*(h for _, h in each))


@dataclass(frozen=True)
class Objective:
    """name: as stored with a model. hessian_one: the hessian is 1, so that counts serve as sums of hessians."""

    name: str
    gradients: Callable[..., Any]
    hessian_one: bool = False
    renew: str | None = None
    kind: str = "regression"
    options: tuple[str, ...] = field(default=())


OBJECTIVES: dict[str, Objective] = {
    o.name: o
    for o in (
        Objective("regression", l2, True),
        Objective("regression_l1", l1, True, "median"),
        Objective("huber", huber, True, options=("alpha",)),
        Objective("fair", fair, options=("fair_c",)),
        Objective("quantile", quantile, True, "alpha", options=("alpha",)),
        Objective("mape", mape, True, "weighted_median"),
        Objective("poisson", poisson, kind="log", options=("poisson_max_delta_step",)),
        Objective("gamma", gamma, kind="log"),
        Objective("tweedie", tweedie, kind="log", options=("tweedie_variance_power",)),
        Objective("binary", binary, kind="binary", options=("sigmoid",)),
        Objective("multiclass", softmax, kind="multiclass"),
        Objective("multiclassova", one_vs_all, kind="multiclass", options=("sigmoid",)),
        Objective("cross_entropy", cross_entropy, kind="xent"),
        Objective("cross_entropy_lambda", cross_entropy_lambda, kind="xentlambda"),
        Objective("lambdarank", lambda *a, **k: None, kind="rank"),
        Objective("rank_xendcg", lambda *a, **k: None, kind="rank"),
    )
}
#: Other names of objectives.
ALIASES = {
    "regression_l2": "regression", "l2": "regression", "mean_squared_error": "regression", "mse": "regression", "l2_root": "regression", "root_mean_squared_error": "regression", "rmse": "regression",
    "l1": "regression_l1", "mean_absolute_error": "regression_l1", "mae": "regression_l1",
    "mean_absolute_percentage_error": "mape",
    "softmax": "multiclass", "multiclass_ova": "multiclassova", "ova": "multiclassova", "ovr": "multiclassova",
    "xentropy": "cross_entropy", "xentlambda": "cross_entropy_lambda",
    "xendcg": "rank_xendcg", "xe_ndcg": "rank_xendcg", "xe_ndcg_mart": "rank_xendcg", "xendcg_mart": "rank_xendcg",
}


def find(name: str) -> Objective:
    key = ALIASES.get(name, name)
    if key not in OBJECTIVES:
        raise ValueError(f"unknown objective {name!r}")
    return OBJECTIVES[key]


def sqrt_label(y: Column) -> Column:
    """sign(y) * sqrt(|y|)."""
    return _sign(y) * F.sqrt(F.abs(y))


def weighted(pair: Pair, weight: Column | None) -> Pair:
    return pair if weight is None else (pair[0] * weight, pair[1] * weight)


def transform(name: str, s: Column, sigmoid: float = 1.0, squared: bool = False) -> Column:
    """Raw score (an array for multiclass) to prediction. ``squared``: labels were square roots."""
    kind = find(name).kind if name else "custom"
    if kind in ("binary", "xent"):
        return 1.0 / (1.0 + F.exp(-(sigmoid if kind == "binary" else 1.0) * s))
    if kind == "log":
        return F.exp(s)
    if kind == "xentlambda":
        return F.log1p(F.exp(s))
    if kind == "multiclass" and find(name).name == "multiclass":
        top = F.array_max(s)
        e = F.transform(s, lambda v: F.exp(v - top))
        total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
        return F.transform(e, lambda v: v / total)
    if kind == "multiclass":
        return F.transform(s, lambda v: 1.0 / (1.0 + F.exp(-sigmoid * v)))
    return _sign(s) * s * s if squared else s


# --- statistics over all labels ---------------------------------------------------------------------------------------


@dataclass(frozen=True)
class LabelFacts:
    """What checks, class weights and first scores need to know of all labels, from one aggregation."""

    n: int
    missing: int
    broken: int
    positives: int
    low: float | None
    high: float | None
    weight: float
    total: float
    positive_weight: float
    classes: tuple[float, ...] = ()

    @staticmethod
    def of(df: DataFrame, label: Column, weight: str | None = None, num_class: int = 0) -> LabelFacts:
        """``num_class``: the classes whose weights are summed up."""
        y, w = label.cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
        row = df.agg(
            F.count(F.lit(1)).alias("n"), F.count_if(y.isNull() | F.isnan(y)).alias("missing"), F.count_if(y != F.floor(y)).alias("broken"), F.count_if(y > 0).alias("positives"), F.min(y).alias("low"), F.max(y).alias("high"),
            F.sum(w).alias("weight"), F.sum(y * w).alias("total"), F.sum(F.when(y > 0, w).otherwise(0.0)).alias("positive_weight"), *(F.sum(F.when(y == k, w).otherwise(0.0)).alias(f"c{k}") for k in range(num_class)),
        ).first()
        sums = [row[c] or 0.0 for c in ("weight", "total", "positive_weight")]
        return LabelFacts(row["n"], row["missing"], row["broken"], row["positives"], row["low"], row["high"], *sums, tuple(row[f"c{k}"] or 0.0 for k in range(num_class)))


def class_weights(df: DataFrame, label: str = "label", is_unbalance: bool = False, scale_pos_weight: float = 1.0, known: tuple[int, int] | None = None) -> tuple[float, float, int, int]:
    """(positive weight, negative weight, positives, negatives). ``known``: the two counts, if they are known."""
    if is_unbalance and scale_pos_weight != 1.0:
        raise ValueError("is_unbalance and scale_pos_weight exclude each other")
    p, n = known or df.agg(F.count_if(F.col(label) > 0), F.count_if(~(F.col(label) > 0))).first()
    if is_unbalance and p and n:
        return (1.0, p / n, p, n) if p > n else (n / p, 1.0, p, n)
    return scale_pos_weight, 1.0, p, n


def check_labels(df: DataFrame, objective: str, label: str = "label", num_class: int = 1, facts: LabelFacts | None = None) -> None:
    """Raises ValueError for labels that an objective can't use."""
    kind, f = find(objective).kind, facts or LabelFacts.of(df, F.col(label))
    if not f.n:
        raise ValueError("there are no rows")
    if f.missing:
        raise ValueError("labels must not be missing")
    if kind == "log" and (f.low < 0 or f.high <= 0):
        raise ValueError(f"{objective}: labels must be at least 0 and not all 0")
    if kind in ("xent", "xentlambda") and (f.low < 0 or f.high > 1):
        raise ValueError(f"{objective}: labels must lie in [0, 1]")
    if kind == "multiclass" and (f.broken or f.low < 0 or f.high >= num_class):
        raise ValueError(f"{objective}: labels must be whole numbers below {num_class}")
    if kind == "rank" and (f.broken or f.low < 0 or f.high >= len(LABEL_GAIN)):
        raise ValueError(f"{objective}: labels must be whole numbers from 0 to {len(LABEL_GAIN) - 1}")


def _log_odds(p: float) -> float:
    p = min(max(p, 1e-15), 1 - 1e-15)
    return math.log(p / (1 - p))


def init_scores(df: DataFrame, objective: str, label: str = "label", weight: str | None = None, num_class: int = 1, alpha: float = 0.9, sigmoid: float = 1.0, facts: LabelFacts | None = None) -> list[float]:
    """Constant first scores, one a class, from sums over the labels (``facts``, if they are known)."""
    o = find(objective)
    y = F.col(label).cast("double")
    if o.kind == "rank":
        return [0.0]
    if o.renew:
        part, w = alpha if o.name == "quantile" else 0.5, F.col(weight).cast("double") if weight else F.lit(1.0)
        if o.name != "mape" and not weight:
            return [percentile(df.select(y.alias("_y")), "_y", part).first()["value"]]
        scale = w / F.greatest(F.lit(1.0), F.abs(y)) if o.name == "mape" else w
        found = weighted_percentile(df.select(y.alias("_y"), scale.alias("_w")), "_y", "_w", part).first()
        return [found["value"] if found else 0.0]
    f = facts if facts and (o.kind != "multiclass" or facts.classes) else LabelFacts.of(df, y, weight, num_class if o.kind == "multiclass" else 0)
    if o.kind == "multiclass":
        prior = [min(max(c / f.weight, 1e-15), 1 - 1e-15) for c in f.classes]
        return [math.log(p) if o.name == "multiclass" else _log_odds(p) / sigmoid for p in prior]
    mean = f.total / f.weight
    if o.kind == "binary":
        return [_log_odds(f.positive_weight / f.weight) / sigmoid]
    if o.kind == "xent":
        return [_log_odds(mean)]
    if o.kind == "log":
        return [math.log(max(mean, 1e-300))]
    if o.kind == "xentlambda":
        return [math.log(math.expm1(max(mean, 1e-15)))]
    return [mean]


# --- ranking ----------------------------------------------------------------------------------------------------------


def _gain(label: Column) -> Column:
    return F.pow(F.lit(2.0), label) - 1.0


def discount(rank: Column) -> Column:
    """rank counts from 1."""
    return 1.0 / F.log2(1.0 + rank)


def max_dcg(df: DataFrame, query: str, label: str, order: str, at: int) -> DataFrame:
    """The best DCG at ``at`` of each query: (query, best)."""
    w = Window.partitionBy(query).orderBy(F.desc(label), order)
    top = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= at)
    return top.groupBy(query).agg(F.sum(_gain(F.col(label)) * discount(F.col("_r"))).alias("best"))


#: Rows of a query up to which it is held by one task.
QUERY_ROWS = 2_000_000


def lambdarank(df: DataFrame, query: str = "query_id", label: str = "label", score: str = "score", order: str = "row_id", sigmoid: float = 1.0, truncation: int = 30, norm: bool = True, largest: int | None = None) -> DataFrame:
    """``df`` with grad and hess. Pairs are of one of a query's first ``truncation`` rows and a later row. Where the largest query (``largest``
    rows, counted if not given) is one that a task can hold, one shuffle by query is all; else its pairs are spread by joins."""
    if largest is None:
        largest = df.groupBy(query).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if largest > QUERY_ROWS:
        return lambdarank_by_joins(df, query, label, score, order, sigmoid, truncation, norm)
    from thicket.functions.ranking import pair_gradients, whole_queries

    rows = df.select(*df.columns, F.col(query).alias("_query"), F.col(label).cast("double").alias("_y"), F.col(score).cast("double").alias("_s"))
    rows = rows.repartition("_query").sortWithinPartitions("_query", F.desc("_s"), order)
    return whole_queries(rows, df.schema, lambda sizes, y, s: pair_gradients(sizes, y, s, sigmoid, truncation, norm))


def lambdarank_by_joins(df: DataFrame, query: str = "query_id", label: str = "label", score: str = "score", order: str = "row_id", sigmoid: float = 1.0, truncation: int = 30, norm: bool = True) -> DataFrame:
    """``lambdarank`` for queries that no task can hold: a query of n rows has ``truncation`` x n pairs at most; its first rows travel as one
    array, and sums combine before the shuffle."""
    w = Window.partitionBy(query).orderBy(F.desc(score), order)
    ranked = df.select("*", F.row_number().over(w).alias("_r")).join(max_dcg(df, query, label, order, truncation), query)
    first = ranked.where(F.col("_r") <= truncation).groupBy(query).agg(
        F.collect_list(F.struct(F.col("_r").alias("r"), F.col(label).cast("double").alias("y"), F.col(score).alias("s"))).alias("_top")  # `truncation` rows at most
    )
    edges = df.groupBy(query).agg(F.max(score).alias("_max"), F.min(score).alias("_min"))
    pairs = ranked.join(first, query).join(edges, query).select("*", F.explode("_top").alias("t")).where((F.col("t.r") < F.col("_r")) & (F.col("t.y") != F.col(label)) & (F.col("best") > 0))
    up = F.col("t.y") > F.col(label)  # the earlier row should stay ahead
    delta = F.when(up, F.col("t.s") - F.col(score)).otherwise(F.col(score) - F.col("t.s"))
    gap = F.abs(_gain(F.col("t.y")) - _gain(F.col(label))) * F.abs(discount(F.col("t.r")) - discount(F.col("_r"))) / F.col("best")
    if norm:
        gap = F.when(F.col("_max") != F.col("_min"), gap / (0.01 + F.abs(delta))).otherwise(gap)
    p = 1.0 / (1.0 + F.exp(sigmoid * delta))
    pairs = pairs.withColumns({"_gap": gap, "_p": p}).withColumns({"_l": sigmoid * F.col("_gap") * F.col("_p"), "_h": sigmoid * sigmoid * F.col("_gap") * F.col("_p") * (1.0 - F.col("_p")), "_up": up})
    ends = pairs.select(
        query, F.explode(F.array(F.struct(F.col("t.r").alias("r"), F.when(F.col("_up"), -F.col("_l")).otherwise(F.col("_l")).alias("g")), F.struct(F.col("_r").alias("r"), F.when(F.col("_up"), F.col("_l")).otherwise(-F.col("_l")).alias("g")))).alias("e"), "_l", "_h"
    )
    sums = ends.groupBy(query, F.col("e.r").alias("_r")).agg(F.sum("e.g").alias("_g"), F.sum("_h").alias("_hh"), F.sum("_l").alias("_ll"))
    factor = F.lit(1.0)
    if norm:
        totals = sums.groupBy(query).agg(F.sum("_ll").alias("_all"))  # each pair counts at both ends: twice its lambda
        sums = sums.join(totals, query)
        factor = F.when(F.col("_all") > 0, F.log2(1.0 + F.col("_all")) / F.col("_all")).otherwise(1.0)
    sums = sums.select(query, "_r", (F.col("_g") * factor).alias("_g"), (F.col("_hh") * factor).alias("_hh"))
    out = ranked.join(sums, [query, "_r"], "left")
    return out.select(*df.columns, F.coalesce("_g", F.lit(0.0)).alias("grad"), F.coalesce("_hh", F.lit(0.0)).alias("hess"))


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) that depends on the parts' texts alone: 52 bits of their MD5 hash, which SQL engines agree on."""
    text = F.concat_ws(":", *((F.col(x) if isinstance(x, str) else x).cast("string") for x in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(1 << 52)


def rank_xendcg(df: DataFrame, query: str = "query_id", label: str = "label", score: str = "score", order: str = "row_id", seed: int = 5, iteration: int = 0) -> DataFrame:
    """``df`` with grad and hess of the cross-entropy surrogate of NDCG, in windows over each query."""
    w = Window.partitionBy(query)
    total = lambda c: F.sum(c).over(w)
    out = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    out = out.withColumns({"_rho": F.col("_e") / total("_e"), "_phi": F.pow(F.lit(2.0), F.col(label)) - uniform(order, F.lit(seed), F.lit(iteration)), "_n": F.count(F.lit(1)).over(w)})
    out = out.withColumn("_one", -F.col("_phi") / F.greatest(total("_phi"), F.lit(1e-15)) + F.col("_rho"))
    rest = F.greatest(1.0 - F.col("_rho"), F.lit(1e-15))
    out = out.withColumn("_a", F.col("_one") / rest).withColumn("_two", F.col("_rho") * (total("_a") - F.col("_a")))
    out = out.withColumn("_b", F.col("_two") / rest).withColumn("_three", F.col("_rho") * (total("_b") - F.col("_b")))
    many = F.col("_n") > 1
    grad = F.when(many, F.col("_one") + F.col("_two") + F.col("_three")).otherwise(0.0)
    return out.select(*df.columns, grad.alias("grad"), F.when(many, F.col("_rho") * (1.0 - F.col("_rho"))).otherwise(0.0).alias("hess"))
