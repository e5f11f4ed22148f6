"""Training, cross-validation and callbacks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.functions.objectives import uniform
from thicket.plans import folds as together
from thicket.plans.boosting import Booster, CallbackEnv, Custom, EarlyStopException, Stopper, refit
from thicket.plans.closures import ByArrays
from thicket.plans.dataset import Dataset, TrainSet
from thicket.plans.model import Model
from thicket.plans.params import Params
from thicket.plans.predict import predict

__all__ = ["ByArrays", "CVBooster", "CallbackEnv", "Dataset", "EarlyStopException", "Model", "Params", "TrainSet", "Training", "cv", "early_stopping", "log_evaluation", "predict", "predict_configured", "record_evaluation", "refit", "reset_parameter", "train"]


def train(
    params: dict[str, Any],
    train_set: TrainSet | Dataset,
    num_boost_round: int | None = None,
    valid_sets: list[TrainSet] | None = None,
    valid_names: list[str] | None = None,
    fobj: Custom | None = None,
    feval: Callable[[DataFrame], list[tuple[str, float, bool]]] | None = None,
    callbacks: list[Callable[[CallbackEnv], None]] | None = None,
    init_model: Model | None = None,
) -> Model:
    """Trains a model. ``fobj`` maps score and label Columns to gradient and hessian Columns; ``feval`` maps a table with raw, score,
    label to (name, value, higher is better); either may be given without the other, or be ``ByArrays``, a function of arrays that may see weights and whole queries."""
    p = Params.of(params, **({"num_iterations": num_boost_round} if num_boost_round is not None else {}))
    names = valid_names or [f"valid_{i}" for i in range(len(valid_sets or []))]
    booster = Booster(train_set, p, dict(zip(names, valid_sets or [], strict=True)), fobj, feval, init_model)
    model = booster.train(callbacks)
    model.params = dict(params)
    return model


# --- callbacks ----------------------------------------------------------------------------------------------------------

#: Places of the callbacks after a round.
LOG, RECORD, STOP = range(1, 4)


def evaluations(env: CallbackEnv) -> Iterator[tuple[str, str, float]]:
    """(dataset, metric, value) of a round."""
    return ((dataset, metric, value) for dataset, metric, value, *_ in env.evaluation_result_list)


def _placed(place: int, call: Callable[[CallbackEnv], None]) -> Callable[[CallbackEnv], None]:
    call.order = place
    return call


def log_evaluation(period: int = 1, show: Callable[[str], None] = print) -> Callable[[CallbackEnv], None]:
    """A line for every ``period`` rounds: the round's number, then dataset, metric and value of each evaluation; never for a period of 0."""
    turns = itertools.count(1)

    def report(env: CallbackEnv) -> None:
        due = period > 0 and next(turns) % period == 0
        text = "; ".join(" ".join((dataset, metric, format(value, ".6g"))) for dataset, metric, value in evaluations(env))
        if due and text:
            show(f"round {env.iteration + 1}: {text}")

    return _placed(LOG, report)


def record_evaluation(into: dict[str, dict[str, list[float]]]) -> Callable[[CallbackEnv], None]:
    """Fills a dictionary: values by dataset, then metric."""

    def record(env: CallbackEnv) -> None:
        for dataset, metric, value in evaluations(env):
            into.setdefault(dataset, {}).setdefault(metric, []).append(value)

    return _placed(RECORD, record)


def reset_parameter(**values: Any) -> Callable[[CallbackEnv], None]:
    """Parameters by iteration: a list, or a function of the iteration."""

    def call(env: CallbackEnv) -> None:
        for name, v in values.items():
            if not hasattr(env.params, name):
                raise ValueError(f"unknown parameter {name!r}")
            setattr(env.params, name, v(env.iteration) if callable(v) else v[env.iteration])

    call.before_iteration = True
    return call


def early_stopping(rounds: int, first_metric_only: bool = False, min_delta: float = 0.0) -> Callable[[CallbackEnv], None]:
    stopper = Stopper(rounds, min_delta, first_metric_only)

    def call(env: CallbackEnv) -> None:
        best = stopper.update(env.iteration, env.evaluation_result_list)
        if best is not None:
            raise EarlyStopException(best, env.evaluation_result_list)

    return _placed(STOP, call)


# --- cross-validation ---------------------------------------------------------------------------------------------------


def folds(df: DataFrame, n: int, row_id: str, label: str | None = None, query: str | None = None, seed: int = 0) -> DataFrame:
    """``df`` with fold, 0 to n - 1. With a label, each class is dealt out in hashed order (stratified); with a query, whole queries go
    together. Plain folds come from the hash alone, an MD5 hash, so SQL deals the same ones."""
    if query:
        return df.withColumn("fold", F.pmod(F.xxhash64(query, F.lit(seed)), F.lit(n)).cast("int"))
    if label:
        # in classes, ranks are by hash: bucket counts first, so that no class is sorted by one task
        h = F.xxhash64(row_id, F.lit(seed))
        rows = df.withColumns({"_h": h, "_b": F.pmod(h, F.lit(1024))})
        counts = rows.groupBy(label, "_b").agg(F.count(F.lit(1)).alias("_c"))
        counts = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.partitionBy(label).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy("_h", row_id)) - 1
        ranked = rows.withColumn("_r", inside).join(counts, [label, "_b"])
        return ranked.withColumn("fold", ((F.col("_r") + F.col("_before")) % n).cast("int")).select(*df.columns, "fold")
    return df.withColumn("fold", F.floor(uniform(F.col(row_id), F.lit(seed)) * n).cast("int"))


class CVBooster:
    """The models of all folds. Their predictions come side by side, as one array column."""

    def __init__(self, boosters: list[Model]) -> None:
        self.boosters = boosters

    @property
    def best_iteration(self) -> int:
        return max((m.best_iteration for m in self.boosters), default=0)

    def predict(self, df: DataFrame, mode: str = "prediction", name: str = "predictions") -> DataFrame:
        out, own = df, [f"_fold_{i}_{name}" for i in range(len(self.boosters))]
        for column, model in zip(own, self.boosters, strict=True):
            out = predict(out, model, mode, column)
        return out.withColumn(name, F.array(*own)).drop(*own)

    def feature_importance(self, kind: str = "split") -> list[list[float]]:
        return [m.importance(kind) for m in self.boosters]


def cv(params: dict[str, Any], train_set: TrainSet, num_boost_round: int = 100, nfold: int = 5, stratified: bool = True, seed: int = 0, feval: Any = None, fobj: Custom | None = None, callbacks: list | None = None, eval_train_metric: bool = False, return_cvbooster: bool = False) -> dict[str, Any]:
    """Mean and standard deviation (of the population) of every metric by round. Each fold trains once, all of them together over one binned table where a round
    needs no rows of its own (``folds.together``) and no function of the caller's, else one after another. ``return_cvbooster``: the folds' models too, under
    ``cvbooster``."""
    if train_set.row_id is None:
        raise ValueError("cv needs a row_id")
    p = Params.of(params)
    strat = train_set.label if stratified and p.objective in ("binary", "multiclass", "multiclassova") else None
    dealt = train_set.like(folds(train_set.df, nfold, train_set.row_id, strat, train_set.query, seed))
    more = {"is_provide_training_metric": True} if eval_train_metric else {}
    models, histories = [], []
    own = Params.of({**params, **more}, num_iterations=num_boost_round)
    if together.together(own) and not (fobj or feval or callbacks or train_set.query):
        all_folds = together.Folds(dealt, own, nfold)
        models = all_folds.train()
        histories = [{name: [x[name] for x in rounds] for name in (rounds[0] if rounds else {})} for rounds in all_folds.history]
    for i in range(nfold if not models else 0):
        kept: dict[str, dict[str, list[float]]] = {}
        models.append(train({**params, **more}, dealt.subset(F.col("fold") != i), num_boost_round, [dealt.subset(F.col("fold") == i)], ["valid"], fobj, feval, [record_evaluation(kept), *(callbacks or [])]))
        histories.append({f"{dataset} {metric}": values for dataset, of in kept.items() for metric, values in of.items()})
    out: dict[str, Any] = {}
    for name in histories[0]:
        rounds = np.array(list(zip(*(h[name] for h in histories), strict=False)))
        out |= {f"{name}-mean": rounds.mean(1).tolist(), f"{name}-stdv": rounds.std(1).tolist()} if len(rounds) else {f"{name}-mean": [], f"{name}-stdv": []}
    return out | ({"cvbooster": CVBooster(models)} if return_cvbooster else {})


class Training:
    """Fluent setting of parameters: ``Training().objective("binary").num_leaves(31).train(data)``. Every parameter and alias is a method."""

    def __init__(self, **params: Any) -> None:
        self.params = params

    def __getattr__(self, name: str) -> Callable[[Any], Training]:
        if name.startswith("_"):
            raise AttributeError(name)
        Params.known(name)
        return lambda value: Training(**{**self.params, name: value})

    def train(self, data: TrainSet, valid: list[TrainSet] | None = None, **more: Any) -> Model:
        return train(self.params, data, valid_sets=valid, **more)


def predict_configured(df: DataFrame, model: Model, params: dict[str, Any] | None = None, name: str = "prediction") -> DataFrame:
    """Mode from parameters: contributions, else leaves, else early stopping (raw), else raw, else transformed."""
    p = Params.of({"objective": model.objective, "num_class": model.num_class, **(params or {})})
    mode = "contrib" if p.predict_contrib else "leaf" if p.predict_leaf_index else "early_stop" if p.pred_early_stop else "raw" if p.predict_raw_score else "prediction"
    return predict(df, model, mode, name, p.start_iteration_predict, p.num_iteration_predict, margin=p.pred_early_stop_margin, freq=p.pred_early_stop_freq)
