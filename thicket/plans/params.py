"""Training parameters: names, aliases, checks, conflicts."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, fields
from typing import Any

from thicket.functions import metrics, objectives
from thicket.operators.sampling import Lcg

#: Other names of parameters.
ALIASES: dict[str, tuple[str, ...]] = {
    "objective": ("objective_type", "app", "application", "loss"),
    "boosting": ("boosting_type", "boost"),
    "data_sample_strategy": (),
    "num_iterations": ("num_iteration", "n_iter", "num_tree", "num_trees", "num_round", "num_rounds", "nrounds", "num_boost_round", "n_estimators", "max_iter"),
    "learning_rate": ("shrinkage_rate", "eta"),
    "num_leaves": ("num_leaf", "max_leaves", "max_leaf", "max_leaf_nodes"),
    "tree_learner": ("tree", "tree_type", "tree_learner_type"),
    "num_threads": ("num_thread", "nthread", "nthreads", "n_jobs"),
    "seed": ("random_seed", "random_state"),
    "min_data_in_leaf": ("min_data_per_leaf", "min_data", "min_child_samples", "min_samples_leaf"),
    "min_sum_hessian_in_leaf": ("min_sum_hessian_per_leaf", "min_sum_hessian", "min_hessian", "min_child_weight"),
    "bagging_fraction": ("sub_row", "subsample", "bagging"),
    "pos_bagging_fraction": ("pos_sub_row", "pos_subsample", "pos_bagging"),
    "neg_bagging_fraction": ("neg_sub_row", "neg_subsample", "neg_bagging"),
    "bagging_freq": ("subsample_freq",),
    "bagging_seed": ("bagging_fraction_seed",),
    "feature_fraction": ("sub_feature", "colsample_bytree"),
    "feature_fraction_bynode": ("sub_feature_bynode", "colsample_bynode"),
    "extra_trees": ("extra_tree",),
    "early_stopping_round": ("early_stopping_rounds", "early_stopping", "n_iter_no_change"),
    "max_delta_step": ("max_tree_output", "max_leaf_output"),
    "lambda_l1": ("reg_alpha", "l1_regularization"),
    "lambda_l2": ("reg_lambda", "lambda", "l2_regularization"),
    "linear_lambda": (),
    "min_gain_to_split": ("min_split_gain",),
    "drop_rate": ("rate_drop",),
    "top_rate": (), "other_rate": (), "max_drop": (), "skip_drop": (), "xgboost_dart_mode": (), "uniform_drop": (), "drop_seed": (),
    "min_data_per_group": (), "max_cat_threshold": (), "cat_l2": (), "cat_smooth": (), "max_cat_to_onehot": (),
    "monotone_constraints": ("mc", "monotone_constraint", "monotonic_cst"),
    "monotone_constraints_method": ("monotone_constraining_method", "mc_method"),
    "monotone_penalty": ("monotone_splits_penalty", "ms_penalty", "mc_penalty"),
    "feature_contri": ("feature_contrib", "fc", "fp", "feature_penalty"),
    "forcedsplits_filename": ("fs", "forced_splits_filename", "forced_splits_file", "forced_splits"),
    "forcedbins_filename": (), "refit_decay_rate": (), "path_smooth": (), "interaction_constraints": (), "cegb_tradeoff": (), "cegb_penalty_split": (),
    "cegb_penalty_feature_coupled": (), "cegb_penalty_feature_lazy": (),
    "verbosity": ("verbose",),
    "linear_tree": ("linear_trees",),
    "max_bin": ("max_bins",),
    "max_bin_by_feature": (), "min_data_in_bin": (), "max_depth": (), "extra_seed": (),
    "bin_construct_sample_cnt": ("subsample_for_bin",),
    "data_random_seed": ("data_seed",),
    "is_enable_sparse": ("is_sparse", "enable_sparse", "sparse"),
    "enable_bundle": ("is_enable_bundle", "bundle"),
    "use_missing": (), "zero_as_missing": (), "feature_pre_filter": (), "feature_fraction_seed": (), "objective_seed": (),
    "categorical_feature": ("cat_feature", "categorical_column", "cat_column", "categorical_features"),
    "num_class": ("num_classes",),
    "is_unbalance": ("unbalance", "unbalanced_sets"),
    "scale_pos_weight": (), "sigmoid": (), "boost_from_average": (), "reg_sqrt": (), "alpha": (), "fair_c": (), "poisson_max_delta_step": (),
    "tweedie_variance_power": (), "lambdarank_truncation_level": (), "lambdarank_norm": (), "first_metric_only": (), "early_stopping_min_delta": (),
    "metric": ("metrics", "metric_types"),
    "metric_freq": ("output_freq",),
    "is_provide_training_metric": ("training_metric", "is_training_metric", "train_metric"),
    "eval_at": ("ndcg_eval_at", "ndcg_at", "map_eval_at", "map_at"),
    "multi_error_top_k": (), "auc_mu_weights": (), "use_quantized_grad": (), "num_grad_quant_bins": (), "quant_train_renew_leaf": (), "stochastic_rounding": (),
    "bagging_by_query": (), "pred_early_stop": (), "pred_early_stop_freq": (), "pred_early_stop_margin": (),
    "start_iteration_predict": (), "num_iteration_predict": (), "predict_raw_score": ("is_predict_raw_score", "predict_rawscore", "raw_score"),
    "predict_leaf_index": ("is_predict_leaf_index", "leaf_index"), "predict_contrib": ("is_predict_contrib", "contrib"),
    "deterministic": (), "count_mode": (),
}
_CANONICAL = {a: k for k, v in ALIASES.items() for a in v}
#: Sub-seeds, in the order in which they are drawn.
SUB_SEEDS = ("data_random_seed", "bagging_seed", "drop_seed", "feature_fraction_seed", "objective_seed", "extra_seed")
BOOSTINGS = {"gbdt": "gbdt", "gbrt": "gbdt", "dart": "dart", "rf": "rf", "random_forest": "rf", "goss": "goss"}


@dataclass
class Params:
    objective: str = "regression"
    boosting: str = "gbdt"
    data_sample_strategy: str = "bagging"
    num_iterations: int = 100
    learning_rate: float = 0.1
    num_leaves: int = 31
    max_depth: int = -1
    min_data_in_leaf: int = 20
    min_sum_hessian_in_leaf: float = 1e-3
    bagging_fraction: float = 1.0
    pos_bagging_fraction: float = 1.0
    neg_bagging_fraction: float = 1.0
    bagging_freq: int = 0
    bagging_by_query: bool = False
    feature_fraction: float = 1.0
    feature_fraction_bynode: float = 1.0
    extra_trees: bool = False
    early_stopping_round: int = 0
    early_stopping_min_delta: float = 0.0
    first_metric_only: bool = False
    max_delta_step: float = 0.0
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    linear_lambda: float = 0.0
    min_gain_to_split: float = 0.0
    drop_rate: float = 0.1
    max_drop: int = 50
    skip_drop: float = 0.5
    xgboost_dart_mode: bool = False
    uniform_drop: bool = False
    top_rate: float = 0.2
    other_rate: float = 0.1
    min_data_per_group: int = 100
    max_cat_threshold: int = 32
    cat_l2: float = 10.0
    cat_smooth: float = 10.0
    max_cat_to_onehot: int = 4
    monotone_constraints: list[int] = field(default_factory=list)
    monotone_constraints_method: str = "basic"
    monotone_penalty: float = 0.0
    feature_contri: list[float] = field(default_factory=list)
    forcedsplits_filename: str = ""
    forcedbins_filename: str = ""
    refit_decay_rate: float = 0.9
    cegb_tradeoff: float = 1.0
    cegb_penalty_split: float = 0.0
    cegb_penalty_feature_coupled: list[float] = field(default_factory=list)
    cegb_penalty_feature_lazy: list[float] = field(default_factory=list)
    path_smooth: float = 0.0
    interaction_constraints: list[list[int]] = field(default_factory=list)
    linear_tree: bool = False
    max_bin: int = 255
    max_bin_by_feature: list[int] = field(default_factory=list)
    min_data_in_bin: int = 3
    bin_construct_sample_cnt: int = 200_000
    use_missing: bool = True
    zero_as_missing: bool = False
    feature_pre_filter: bool = False
    enable_bundle: bool = False
    categorical_feature: list[str] = field(default_factory=list)
    seed: int = 0
    data_random_seed: int = 1
    bagging_seed: int = 3
    drop_seed: int = 4
    feature_fraction_seed: int = 2
    objective_seed: int = 5
    extra_seed: int = 6
    num_class: int = 1
    is_unbalance: bool = False
    scale_pos_weight: float = 1.0
    sigmoid: float = 1.0
    boost_from_average: bool = True
    reg_sqrt: bool = False
    alpha: float = 0.9
    fair_c: float = 1.0
    poisson_max_delta_step: float = 0.7
    tweedie_variance_power: float = 1.5
    lambdarank_truncation_level: int = 30
    lambdarank_norm: bool = True
    metric: list[str] = field(default_factory=list)
    metric_freq: int = 1
    is_provide_training_metric: bool = False
    eval_at: list[int] = field(default_factory=lambda: [1, 2, 3, 4, 5])
    multi_error_top_k: int = 1
    auc_mu_weights: list[float] = field(default_factory=list)
    use_quantized_grad: bool = False
    num_grad_quant_bins: int = 4
    quant_train_renew_leaf: bool = False
    stochastic_rounding: bool = True
    pred_early_stop: bool = False
    pred_early_stop_freq: int = 10
    pred_early_stop_margin: float = 10.0
    start_iteration_predict: int = 0
    num_iteration_predict: int = -1
    predict_raw_score: bool = False
    predict_leaf_index: bool = False
    predict_contrib: bool = False
    tree_learner: str = "serial"
    num_threads: int = 0
    verbosity: int = 1
    is_enable_sparse: bool = True
    deterministic: bool = False
    count_mode: str = "exact"

    @staticmethod
    def known(name: str) -> str:
        """The parameter that a name or alias means."""
        key = _CANONICAL.get(name, name)
        if key not in {f.name for f in fields(Params)}:
            raise AttributeError(f"unknown parameter {name!r}")
        return key

    @staticmethod
    def of(given: dict[str, Any] | None = None, **more: Any) -> Params:
        """From names or aliases. Of several names of one parameter its own wins, then the shortest, then the first in order."""
        given = {**(given or {}), **more}
        chosen: dict[str, tuple[tuple, Any]] = {}
        kinds = {f.name: f for f in fields(Params)}
        for name, value in given.items():
            key = _CANONICAL.get(name, name)
            if key not in kinds:
                raise ValueError(f"unknown parameter {name!r}")
            rank = (name != key, len(name), name)
            if key not in chosen or rank < chosen[key][0]:
                chosen[key] = rank, value
        out = Params()
        for key, (_, value) in chosen.items():
            setattr(out, key, _coerce(key, value, getattr(out, key)))
        if "seed" in chosen:
            rng = Lcg(out.seed)
            for name in SUB_SEEDS:
                drawn = rng.next_short(0, 32767)
                if name not in chosen:
                    setattr(out, name, drawn)
        out._settle(chosen)
        return out

    def _settle(self, given: dict[str, Any]) -> None:
        words = self.objective.split()
        self.objective, self.reg_sqrt = words[0], self.reg_sqrt or "sqrt" in words[1:]
        self.objective = objectives.find(self.objective).name if self.objective not in ("custom", "none") else "custom"
        if self.boosting not in BOOSTINGS:
            raise ValueError(f"unknown boosting {self.boosting!r}")
        self.boosting = BOOSTINGS[self.boosting]
        if self.boosting == "goss":
            self.boosting, self.data_sample_strategy = "gbdt", "goss"
        if self.data_sample_strategy not in ("bagging", "goss"):
            raise ValueError(f"unknown data_sample_strategy {self.data_sample_strategy!r}")
        if self.tree_learner not in ("serial", "data", "feature", "voting"):
            raise ValueError(f"unknown tree_learner {self.tree_learner!r}")
        multi = self.objective in ("multiclass", "multiclassova")
        if multi and self.num_class < 2:
            raise ValueError("num_class must be at least 2 for multiclass objectives")
        if not multi and self.num_class != 1 and self.objective != "custom":
            raise ValueError("num_class must be 1 for this objective")
        self.metric = metrics.parse(self.metric, self.objective)
        for m in self.metric:
            of_many = m in ("multi_logloss", "multi_error", "auc_mu")
            if self.objective != "custom" and of_many != multi:
                raise ValueError(f"metric {m} doesn't suit objective {self.objective}")
        if 0 < self.max_depth < 31 and "num_leaves" not in given:
            self.num_leaves = min(self.num_leaves, 1 << self.max_depth)
        elif 0 < self.max_depth < 31:
            self.num_leaves = min(self.num_leaves, 1 << self.max_depth)
        if self.path_smooth > 0:
            self.min_data_in_leaf = max(2, self.min_data_in_leaf)
        if self.monotone_constraints_method != "basic":
            raise ValueError("of the monotone methods only basic is offered")
        checks = {
            "num_leaves": 1 < self.num_leaves <= 131072, "learning_rate": self.learning_rate > 0, "max_bin": self.max_bin > 1, "min_data_in_bin": self.min_data_in_bin > 0, "bagging_fraction": 0 < self.bagging_fraction <= 1,
            "pos_bagging_fraction": 0 < self.pos_bagging_fraction <= 1, "neg_bagging_fraction": 0 < self.neg_bagging_fraction <= 1, "feature_fraction": 0 < self.feature_fraction <= 1,
            "feature_fraction_bynode": 0 < self.feature_fraction_bynode <= 1, "lambda_l1": self.lambda_l1 >= 0, "lambda_l2": self.lambda_l2 >= 0, "min_gain_to_split": self.min_gain_to_split >= 0, "drop_rate": 0 <= self.drop_rate <= 1,
            "skip_drop": 0 <= self.skip_drop <= 1, "top_rate": 0 <= self.top_rate <= 1, "other_rate": 0 <= self.other_rate <= 1, "sigmoid": self.sigmoid > 0, "alpha": self.alpha > 0, "fair_c": self.fair_c > 0,
            "tweedie_variance_power": 1 <= self.tweedie_variance_power < 2, "path_smooth": self.path_smooth >= 0, "num_iterations": self.num_iterations >= 0, "refit_decay_rate": 0 <= self.refit_decay_rate <= 1,
            "min_data_in_leaf": self.min_data_in_leaf >= 0, "max_cat_threshold": self.max_cat_threshold > 0, "cat_smooth": self.cat_smooth >= 0, "metric_freq": self.metric_freq > 0, "count_mode": self.count_mode in ("exact", "hessian"),
        }
        bad = [k for k, ok in checks.items() if not ok]
        if bad:
            raise ValueError(f"out of range: {', '.join(f'{k}={getattr(self, k)!r}' for k in bad)}")
        if self.top_rate + self.other_rate > 1:
            raise ValueError("top_rate and other_rate must not exceed 1 together")
        if self.boosting == "rf" and not (self.bagging_freq > 0 and self.bagging_fraction < 1 or self.feature_fraction < 1):
            raise ValueError("rf needs bagging or feature_fraction")
        if self.is_unbalance and self.scale_pos_weight != 1.0:
            raise ValueError("is_unbalance and scale_pos_weight exclude each other")

    def auc_mu_matrix(self) -> list[list[float]] | None:
        """The loss matrix for auc_mu, zero on the diagonal."""
        k, w = self.num_class, self.auc_mu_weights
        if not w:
            return None
        if len(w) != k * k:
            raise ValueError(f"auc_mu_weights needs {k * k} numbers")
        if any(w[i * k + j] == 0 for i in range(k) for j in range(k) if i != j):
            raise ValueError("auc_mu_weights must not be 0 beside the diagonal")
        return [[0.0 if i == j else float(w[i * k + j]) for j in range(k)] for i in range(k)]


def parse_groups(text: str) -> list[list[int]]:
    """``[0,1],[2]`` to lists of numbers."""
    if not re.fullmatch(r"\s*(\[\s*\d+(\s*,\s*\d+)*\s*\]\s*(,\s*(?=\[)|$))*", text):
        raise ValueError(f"not a list of groups: {text!r}")
    return [[int(x) for x in g.split(",")] for g in re.findall(r"\[([^\]]*)\]", text)]


def _coerce(key: str, value: Any, default: Any) -> Any:
    if key == "interaction_constraints":
        return parse_groups(value) if isinstance(value, str) else [list(g) for g in value]
    if key == "early_stopping_round" and value is None:
        return 0
    if key == "metric":
        return metrics_list(value)
    if isinstance(default, bool):
        if isinstance(value, str):
            if value.lower() not in ("true", "false", "+", "-", "1", "0"):
                raise ValueError(f"{key}: not a boolean: {value!r}")
            return value.lower() in ("true", "+", "1")
        return bool(value)
    if isinstance(default, int):
        if isinstance(value, float) and value != int(value):
            raise ValueError(f"{key}: not a whole number: {value!r}")
        return int(value)
    if isinstance(default, float):
        return float(value)
    if isinstance(default, list):
        if isinstance(value, str):
            value = [x for x in value.replace(" ", "").split(",") if x]
        kind = {"monotone_constraints": int, "max_bin_by_feature": int, "eval_at": int, "categorical_feature": str}.get(key, float)
        return [kind(x) for x in (value if isinstance(value, (list, tuple)) else [value])]
    return str(value)


def metrics_list(value: Any) -> list[str]:
    if value is None:
        return []
    return [x for x in value.replace(" ", "").split(",") if x] if isinstance(value, str) else list(value)
