"""The boosting loop: a table of bins and scores, a gradient projection each round, one grown tree for each class, a score update.

The driver holds trees and a few numbers. The score column is replaced by one projection a round, cached, and written to the shared
folder every ``CUT`` rounds, so that plans stay short.
"""

from __future__ import annotations

import json
import random
from collections.abc import Callable
from dataclasses import dataclass, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions import metrics, objectives
from thicket.operators import binning, bundling, histogram, sampling
from thicket.operators.split import Feature, SplitParams
from thicket.plans import linear
from thicket.plans.closures import ByArrays
from thicket.plans.dataset import Dataset, TrainSet
from thicket.operators.counting import Slot, Table
from thicket.operators.sparse import bin_sql
from thicket.plans.grower import Grower, GrowParams, Searcher, grow_all, stored_columns
from thicket.plans.model import Leaf, Model, Tree, tree_sql
from thicket.plans.params import Params
from thicket.plans.predict import add_trees
from thicket.plans.tables import materialise, remove, scratch

CUT = 10
Custom = Callable[[Column, Column], tuple[Column, Column]]


@dataclass
class CallbackEnv:
    model: Model
    params: Params
    iteration: int
    begin_iteration: int
    end_iteration: int
    evaluation_result_list: list[tuple[str, str, float, bool]]


class EarlyStopException(Exception):
    def __init__(self, best_iteration: int, best_score: list) -> None:
        super().__init__(best_iteration)
        self.best_iteration, self.best_score = best_iteration, best_score


class Stopper:
    """Early stopping: no (set, metric) may go ``rounds`` evaluations without beating its best by more than ``min_delta``."""

    def __init__(self, rounds: int, min_delta: float = 0.0, first_metric_only: bool = False) -> None:
        self.rounds, self.min_delta, self.first = rounds, min_delta, first_metric_only
        self.best: dict[tuple[str, str], tuple[float, int, list]] = {}

    def update(self, iteration: int, results: list[tuple[str, str, float, bool]]) -> int | None:
        """The best iteration once it is time to stop."""
        first = next((m.split("@")[0] for s, m, _, _ in results if s != "training"), None)
        for name, metric, value, higher in results:
            if name == "training" or (self.first and metric.split("@")[0] != first):
                continue
            key = name, metric
            better = key not in self.best or (value > self.best[key][0] + self.min_delta if higher else value < self.best[key][0] - self.min_delta)
            if better:
                self.best[key] = value, iteration, results
            elif iteration - self.best[key][1] >= self.rounds:
                return self.best[key][1]
        return None


def _into(score: Column, k: int, c: int, more: Column) -> Column:
    """Adds to a score, or to class ``c`` of an array of ``k``."""
    return score + more if k == 1 else F.transform(score, lambda v, i: F.when(i == c, v + more).otherwise(v))


def split_params(p: Params) -> SplitParams:
    return SplitParams(
        p.lambda_l1, p.lambda_l2, p.max_delta_step, p.path_smooth, p.min_data_in_leaf, p.min_sum_hessian_in_leaf, p.min_gain_to_split, p.count_mode, p.max_cat_to_onehot, p.max_cat_threshold, p.cat_smooth, p.cat_l2, p.min_data_per_group, p.monotone_penalty, p.cegb_tradeoff, p.cegb_penalty_split
    )


def _options(p: Params) -> dict[str, Any]:
    return {k: getattr(p, k) for k in ("alpha", "fair_c", "poisson_max_delta_step", "tweedie_variance_power", "sigmoid")}


def steady(tree: Tree, p: Params) -> bool:
    """Whether outputs are bounded by the least hessian: splits see to it that each leaf has as much; a root that can't split, and lacks it, has to hold 0."""
    return bool(tree.nodes) or tree.leaves[0].weight >= p.min_sum_hessian_in_leaf


class Booster:
    """Training state and loop."""

    def __init__(self, data: TrainSet | Dataset, params: Params, valid: dict[str, TrainSet] | None = None, fobj: Custom | None = None, feval: Callable[[DataFrame], list[tuple[str, float, bool]]] | None = None, init_model: Model | None = None) -> None:
        self.p, self.fobj, self.feval = params, fobj, feval
        self.objective = None if fobj else objectives.find(params.objective)
        self.k = params.num_class
        self.rank = self.objective is not None and self.objective.kind == "rank"
        classes = self.k if self.objective and self.objective.kind == "multiclass" else 0
        self.sparse: tuple[str, str] | None = None
        begun = init_model is not None
        if isinstance(data, Dataset):
            data.check(params)
            if begun or params.linear_tree and not data.raw:
                raise ValueError("models are continued, and linear leaves fitted, on the features' own values: train on a TrainSet, or on a data set built with raw=True for linear leaves")
            facts = objectives.LabelFacts.of(data.df, self._target("_y"), "_weight" if data.weighted else None, classes)
        else:
            data.checked()
            self.sparse = data.sparse
            facts = objectives.LabelFacts.of(data.df, self._target(data.label), data.weight, classes)
            if begun:
                # the key first: it may be a hash of all columns
                known = data.df.withColumn("_key", data.key()).withColumn("_begun", self._zero())
                data = replace(data, df=self._scored(known, init_model.trees, init_model, "_begun"), row_id="_key")
            data = Dataset.prepare(data, params, facts.n, params.linear_tree, ["_begun"] if begun else None)
        self.data, self.spark = data, data.df.sparkSession
        if self.rank and not data.ranked:
            raise ValueError("ranking objectives need a query column")
        if data.sparse and (params.linear_tree or params.enable_bundle or self.rank):
            raise ValueError("linear leaves, bundles and ranking need columns")
        self.setup(facts, init_model)
        table = data.df.withColumns({"_label": self._target("_y")}).drop("_y")
        used = {f.index for f in self.features}
        self.bundles = [b for b in bundling.find_bundles(table, self.mappers, key="_row_id") if len(b.features) > 1 and used.issuperset(b.features)] if params.enable_bundle else []
        table = table.withColumns({f"e{j}": bundling.bundle_column(b, self.mappers).cast("short" if b.num_bin > 127 else "byte") for j, b in enumerate(self.bundles)}).drop(*self._bundled())
        base = F.coalesce(F.col("_init").cast(self._kind()), self._constant()) if data.started else self._constant()
        if init_model:
            base = self._sum(F.col("_begun"), base)
        state = table.withColumn("score", base).drop("_init", "_begun")
        if self.grow_params.cegb_lazy:
            if data.sparse or self.rank:
                raise ValueError("costs a row need columns, and an objective that judges rows by themselves")
            state = state.withColumn("_paid", F.array(*[F.lit(0).cast("long")] * -(-len(self.grow_params.cegb_lazy) // 63)))
        cores = self.spark.sparkContext.defaultParallelism
        self.parts = state.rdd.getNumPartitions()
        if self.parts < cores:  # a small file is one partition; every search would be one task
            self.parts, state = cores, state.repartition(cores)
        self.state, self.spent = state.cache(), None
        self.written: list[str] = []  # tables that go when training ends
        self.largest: int | None = None  # rows of the largest query
        self.valid = {name: self._valid(v) for name, v in (valid or {}).items()}
        self.history: list[tuple[int, str, str, float]] = []

    def setup(self, facts: objectives.LabelFacts, init_model: Model | None = None) -> None:
        """What a training holds besides its table: features, constants, the model as it begins, random draws."""
        params, data, rows = self.p, self.data, facts.n
        if self.objective:
            objectives.check_labels(data.df, params.objective, "_y", self.k, facts)
        self.mappers, self.weighted, self.bundles = data.mappers, data.weighted, []
        least = max(1, int(params.min_data_in_leaf))
        # the mappers count sampled rows, so the least number is scaled alike
        sampled = max((sum(m.counts) for m in self.mappers), default=0)
        least = int(least * sampled / rows) if sampled < rows else least
        mono, contri = params.monotone_constraints, params.feature_contri
        self.features = [
            Feature.of(i, m, monotone=mono[i] if i < len(mono) else 0, contri=contri[i] if i < len(contri) else 1.0, column=bin_sql(i, m) if data.sparse else "")
            for i, m in enumerate(self.mappers)
            if not m.trivial and not (params.feature_pre_filter and binning.needs_filter(m, least))
        ]
        self.pos, self.neg = (1.0, 1.0)
        if self.objective and self.objective.name == "binary":
            self.pos, self.neg, *_ = objectives.class_weights(data.df, "_y", params.is_unbalance, params.scale_pos_weight, (facts.positives, facts.n - facts.positives))
        self.init = [0.0] * self.k
        if self.objective and params.boost_from_average and not data.started and not init_model:
            flat = data.df.select(self._target("_y").alias("_label"), "_weight")
            with scratch(self.spark):
                self.init = objectives.init_scores(flat, params.objective, "_label", "_weight" if data.weighted else None, self.k, params.alpha, params.sigmoid, facts)
        self.model = Model(list(data.features), params.objective if self.objective else "custom", self.k, average=params.boosting == "rf", sigmoid=params.sigmoid, squared=params.reg_sqrt, infos=[m.info() for m in self.mappers])
        if init_model:
            self.model.trees += init_model.trees
        if params.boosting == "dart" and not init_model and any(self.init):
            # constants of their own, which are never dropped
            self.model.trees += [Tree(leaves=[Leaf(float(v))]) for v in self.init]
        self.begun = len(self.model.trees)
        self.routes: list[str] = []
        self.weights: list[float] = []
        self.used: set[int] = set()
        self.rngs = {n: random.Random(getattr(params, n)) for n in ("feature_fraction_seed", "drop_seed", "extra_seed")}
        forced = None
        if params.forcedsplits_filename:
            text = params.forcedsplits_filename
            forced = read_forced(text if text.lstrip().startswith("{") else open(text).read(), len(data.features))
        self.grow_params = GrowParams(params.num_leaves, params.max_depth, split_params(params), params.feature_fraction_bynode, [set(g) for g in params.interaction_constraints], params.extra_trees, params.extra_seed, forced, params.cegb_penalty_feature_coupled, params.cegb_tradeoff, {i: params.cegb_tradeoff * c for i, c in enumerate(params.cegb_penalty_feature_lazy) if c > 0})

    def _bundled(self) -> list[str]:
        return [f"b{i}" for b in self.bundles for i in b.features]

    def _opened(self, df: DataFrame) -> DataFrame:
        """``df`` with the bins of bundled features, which aren't stored."""
        return df.withColumns({f"b{i}": bundling.unbundle(F.col(f"e{j}"), b, i, self.mappers) for j, b in enumerate(self.bundles) for i in b.features})

    # --- one round -----------------------------------------------------------------------------------------------------

    def _zero(self) -> Column:
        return F.array(*[F.lit(0.0)] * self.k) if self.k > 1 else F.lit(0.0)

    def _constant(self) -> Column:
        first = [F.lit(float(x)) for x in self.init]
        return F.array(*first) if self.k > 1 else first[0]

    def _kind(self) -> str:
        return "array<double>" if self.k > 1 else "double"

    def _target(self, label: str) -> Column:
        y = F.col(label).cast("double")
        return objectives.sqrt_label(y) if self.p.reg_sqrt else y

    def _sum(self, a: Column, b: Column) -> Column:
        return F.zip_with(a, b, lambda x, y: x + y) if self.k > 1 else a + b

    def _scored(self, df: DataFrame, trees: list[Tree], model: Model, column: str, factor: float = 1.0) -> DataFrame:
        return add_trees(df, model, trees, [i % self.k for i in range(len(trees))], column, factor, self.sparse)

    def _valid(self, v: TrainSet) -> DataFrame:
        """A validation set's rows with their scores so far: start scores, or else the constant, and what the model begins with."""
        if self.data.sparse:
            self.sparse = v.sparse
        df = self.data.encode(v.df)
        base = self._zero() if self.begun else self._constant()
        if v.init_score:
            base = F.coalesce(F.col(v.init_score).cast(self._kind()), base)
        own = {"_row_id": v.key(), "_label": self._target(v.label), "_weight": F.col(v.weight).cast("double") if v.weight else F.lit(1.0), "_score": base}
        rows = df.withColumns(own | ({"_query": F.col(v.query)} if v.query else {}))
        if self.begun:
            rows = self._scored(rows, self.model.trees, self.model, "_score")
        return rows.cache()

    def _gradients(self, state: DataFrame, iteration: int) -> DataFrame:
        s, y, p = F.col("score"), F.col("_label"), self.p
        if isinstance(self.fobj, ByArrays):
            return self.fobj.gradients(state, self.k, self.weighted)
        if self.fobj:
            g, h = self.fobj(s, y)
        elif self.rank:
            renamed = state.withColumnsRenamed({"_query": "query_id", "_label": "label", "_row_id": "row_id"})
            if self.objective.name == "lambdarank":
                if self.largest is None:
                    self.largest = state.groupBy("_query").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
                out = objectives.lambdarank(renamed, largest=self.largest, sigmoid=p.sigmoid, truncation=p.lambdarank_truncation_level, norm=p.lambdarank_norm)
            else:
                out = objectives.rank_xendcg(renamed, seed=p.objective_seed, iteration=iteration)
            out = out.withColumnsRenamed({"query_id": "_query", "label": "_label", "row_id": "_row_id"})
            return out.withColumns({"grad": F.col("grad") * F.col("_weight"), "hess": F.col("hess") * F.col("_weight")}).cache()
        else:
            g, h = self.objective.gradients(s, y, num_class=self.k, pos_weight=self.pos, neg_weight=self.neg, **_options(p))
        if self.weighted:
            w = F.col("_weight")
            g, h = (F.transform(x, lambda v: v * w) if self.k > 1 else x * w for x in (g, h))
        return state.withColumns({"grad": g, "hess": h})

    def _bag(self, rows: DataFrame, iteration: int) -> DataFrame:
        p = self.p
        if p.data_sample_strategy == "goss" and p.boosting != "rf":
            if iteration < int(1 / p.learning_rate):
                return rows
            return sampling.goss(rows, p.top_rate, p.other_rate, "_row_id", p.bagging_seed, iteration).where("in_bag").drop("in_bag")
        balanced = p.pos_bagging_fraction < 1 or p.neg_bagging_fraction < 1
        if p.bagging_freq <= 0 or (p.bagging_fraction >= 1 and not balanced):
            return rows
        turn = iteration // p.bagging_freq
        bagged = sampling.bagging(rows, p.bagging_fraction, "_row_id", p.bagging_seed, turn, p.pos_bagging_fraction, p.neg_bagging_fraction, "_label", "_query" if p.bagging_by_query else None)
        return bagged.where("in_bag").drop("in_bag")

    def _dropped(self, iteration: int) -> tuple[list[int], DataFrame]:
        state = self._opened(self.state)
        if self.p.boosting != "dart" or not self.weights:
            return [], state
        p = self.p
        gone = sampling.dart_drop(len(self.weights), p.drop_rate, self.weights, self.rngs["drop_seed"], p.skip_drop, p.max_drop, p.uniform_drop)
        if not gone:
            return [], state
        return gone, state.withColumn("score", self._add(F.col("score"), gone, -1.0))

    def _counted(self, features: list[Feature]) -> Table:
        if self.data.sparse:
            return Table([], features, {f.index: (f.num_bin, f.default_bin) for f in features}, ("_sf", "_sb"))
        return Table(stored_columns(features, self.bundles, self.mappers), features)

    def _add(self, score: Column, iterations: list[int], factor: float) -> Column:
        """score plus ``factor`` times the outputs of some iterations."""
        for c in range(self.k):
            total = sum((self._output(self.routes[i * self.k + c], self.model.trees[self.begun + i * self.k + c]) for i in iterations), F.lit(0.0)) * factor
            score = self._into(score, c, total)
        return score

    def _into(self, score: Column, c: int, more: Column) -> Column:
        return _into(score, self.k, c, more)

    def _output(self, route: str, tree: Tree) -> Column:
        if not tree.nodes and not tree.linear:
            return F.lit(float(tree.leaves[0].value))
        if tree.linear:
            return F.expr(tree_sql(tree, [f"_x{i}" for i in range(len(self.data.features))]))
        return F.expr(f"array({', '.join(f'{float(x.value)!r}D' for x in tree.leaves)})[{route}]")

    def round(self, iteration: int) -> None:
        """Trains one iteration. A tree that can't split is one leaf; a later round may split again, by other draws or scores."""
        p = self.p
        gone, state = self._dropped(iteration)
        if p.boosting == "rf":
            state = state.withColumn("score", F.array(*(F.lit(float(v)) for v in self.init)) if self.k > 1 else F.lit(float(self.init[0])))
        rows = self._gradients(state, iteration)
        grown: list[tuple[Tree, str]] = []
        names = sampling.column_sample([f.index for f in self.features], p.feature_fraction, self.rngs["feature_fraction_seed"]) if p.feature_fraction < 1 else [f.index for f in self.features]
        features = [f for f in self.features if f.index in set(names)]
        bag, plain = self._bag(rows, iteration), None
        if p.use_quantized_grad:
            one = bool(self.objective and self.objective.hessian_one and not self.weighted)
            key = "_row_id" if p.stochastic_rounding else None
            if self.k == 1:
                plain, gs, hs = histogram.quantise(bag, p.num_grad_quant_bins, one, key, p.seed + iteration)
                bag = plain.withColumns({"grad": F.col("qg") * gs, "hess": F.col("qh") * hs})
            else:
                plain, gs, hs = histogram.quantise_classes(bag, self.k, p.num_grad_quant_bins, one, key, p.seed + iteration)
                bag = plain.withColumns({c: F.zip_with(q, F.array(*map(F.lit, steps)), lambda a, b: a * b) for c, q, steps in (("grad", "qg", gs), ("hess", "qh", hs))})
        # the trees of all classes grow in step
        slots = [Slot(gradient=c if self.k > 1 else None) for c in range(self.k)]
        searcher = Searcher(bag, self._counted(features), slots, self.grow_params.split, p.num_leaves, None if self.rank else self.parts, lazy=self.grow_params.cegb_lazy)
        growers = [Grower(self.mappers, self.grow_params, features, self.used, self.rngs["extra_seed"], c) for c in range(self.k)]
        for c, (tree, route, _) in enumerate(grow_all(searcher, growers)):
            own = lambda df, c=c: df if self.k == 1 else df.withColumns({x: F.col(x)[c] for x in ("grad", "hess")} | {"score": F.col("score")[c]})
            if steady(tree, p):
                if plain is not None and p.quant_train_renew_leaf:
                    self._newton(own(plain), route, tree)
                if self.objective and self.objective.renew:
                    self._renew(own(bag), route, tree)
                elif p.linear_tree and tree.nodes and (len(self.model.trees) > self.begun or self.begun):
                    linear.fit(own(bag), F.expr(route), [f"_x{i}" for i in range(len(self.data.features))], tree, p.linear_lambda)
            else:
                tree.leaves[0].value = 0.0
            grown.append((tree, route))
        if self.rank:
            rows.unpersist()
        if self.spent is not None:  # the first histogram has filled the next round's cache
            self.spent.unpersist()
            self.spent = None
        rate = 1.0 if p.boosting == "rf" else p.learning_rate
        if p.boosting == "dart":
            rate, factor = sampling.dart_factors(len(gone), p.learning_rate, p.xgboost_dart_mode)
        score = F.col("score")
        if p.boosting == "dart" and gone:
            score = self._add(score, gone, factor - 1.0)
        first = len(self.model.trees) == self.begun and not self.begun
        for c, (tree, route) in enumerate(grown):
            tree.shrink(rate)
            score = self._into(score, c, self._output(route, tree))
            self.routes.append(route)
        if p.boosting == "dart" and gone:
            for i in gone:
                for c in range(self.k):
                    self.model.trees[self.begun + i * self.k + c].shrink(factor)
                self.weights[i] *= factor
        self._advance(score, iteration, grown)
        for name, df in self.valid.items():
            fresh = self._scored(df, [t for t, _ in grown], self.model, "_score")
            if p.boosting == "dart" and gone:
                # these trees have been shrunk by ``factor`` already
                fresh = self._scored(fresh, [self.model.trees[self.begun + i * self.k + c] for i in gone for c in range(self.k)], self.model, "_score", 1.0 - 1.0 / factor)
            fresh = (materialise(fresh, "valid", self.written) if (iteration + 1) % CUT == 0 else fresh).cache()
            fresh.count()
            df.unpersist()
            self.valid[name] = fresh
        self.weights.append(rate)
        for c, (tree, _) in enumerate(grown):
            if first or p.boosting == "rf":
                tree.add_bias(self.init[c])
            self.model.trees.append(tree)

    def _advance(self, score: Column, iteration: int, grown: list[tuple[Tree, str]]) -> None:
        """The next round's scores. They are cached when its first histogram reads them, so until then the old ones stay."""
        if self.spent is not None:
            self.spent.unpersist()
        fresh = self._opened(self.state).withColumns({"score": score} | ({"_paid": self._paid(grown)} if self.grow_params.cegb_lazy else {})).drop(*self._bundled())
        fresh = (materialise(fresh, "train", self.written) if (iteration + 1) % CUT == 0 else fresh).cache()
        self.spent, self.state = self.state, fresh

    def _paid(self, grown: list[tuple[Tree, str]]) -> Column:
        """The bits of what each row has paid for: also what its leaves' paths asked of it."""
        bit = {f: i for i, f in enumerate(self.grow_params.cegb_lazy)}
        words = -(-len(bit) // 63)
        out = [F.col("_paid")[w] for w in range(words)]
        for tree, route in grown:
            paths = linear.path_features(tree, every=True)
            for w in range(words):
                masks = [sum(1 << bit[f] % 63 for f in own if f in bit and bit[f] // 63 == w) for own in paths]
                if any(masks):
                    out[w] = out[w].bitwiseOR(F.expr(f"array({', '.join(f'{m}L' for m in masks)})[{route}]"))
        return F.array(*out)

    def _renew(self, bag: DataFrame, route: str, tree: Tree) -> None:
        """Leaf values from percentiles of the residuals."""
        alpha = self.p.alpha if self.objective.name == "quantile" else 0.5
        rows = bag.select(F.expr(route).alias("leaf"), (F.col("_label") - F.col("score")).alias("r"), (F.col("_weight") / (F.greatest(F.lit(1.0), F.abs("_label")) if self.objective.name == "mape" else F.lit(1.0))).alias("w"))
        plain = self.objective.name != "mape" and not self.weighted
        with scratch(self.spark):
            found = objectives.percentile(rows, "r", alpha, ["leaf"]) if plain else objectives.weighted_percentile(rows, "r", "w", alpha, ["leaf"])
            for r in found.collect():  # a row a leaf
                tree.leaves[r["leaf"]].value = r["value"]

    def _newton(self, rows: DataFrame, route: str, tree: Tree) -> None:
        p = self.p
        for r in rows.groupBy(F.expr(route).alias("leaf")).agg(F.sum("grad").alias("g"), F.sum("hess").alias("h")).collect():  # a row a leaf
            shrunk = max(abs(r["g"]) - p.lambda_l1, 0.0) * (-1 if r["g"] < 0 else 1)
            tree.leaves[r["leaf"]].value = -shrunk / (r["h"] + p.lambda_l2)

    # --- evaluation -----------------------------------------------------------------------------------------------------

    def evaluate(self, iteration: int) -> list[tuple[str, str, float, bool]]:
        with scratch(self.spark):
            return self._evaluate(iteration)

    def _evaluate(self, iteration: int) -> list[tuple[str, str, float, bool]]:
        sets = ({"training": self.state.withColumnRenamed("score", "_score")} if self.p.is_provide_training_metric else {}) | self.valid
        out = []
        for name, df in sets.items():
            raw = F.col("_score") / (iteration + 1) if self.p.boosting == "rf" and self.k == 1 else F.col("_score")
            if self.p.boosting == "rf" and self.k == 1:
                # scores of valid sets begin with the constant that every tree also holds
                raw = (F.col("_score") - F.lit(float(self.init[0]))) / (iteration + 1) + F.lit(float(self.init[0]))
            flat = df.select(raw.alias("raw"), F.col("_label").alias("label"), F.col("_row_id").alias("row_id"), F.col("_weight").alias("weight"), *([F.col("_query").alias("query_id")] if "_query" in df.columns else []))
            flat = flat.withColumn("score", objectives.transform(self.p.objective, F.col("raw"), self.p.sigmoid) if self.objective else F.col("raw"))
            found = metrics.evaluate_all(flat, self.p.metric, self.k, tuple(self.p.eval_at), "weight" if self.weighted else None, alpha=self.p.alpha, fair_c=self.p.fair_c, tweedie_variance_power=self.p.tweedie_variance_power, multi_error_top_k=self.p.multi_error_top_k, auc_mu_weights=self.p.auc_mu_matrix())
            out += [(name, n, v, h) for n, v, h in found]
            if self.feval:
                for n, v, h in self.feval.metric(flat) if isinstance(self.feval, ByArrays) else self.feval(flat):
                    if v != v or abs(v) == float("inf"):
                        raise ValueError(f"metric {n} isn't finite")
                    out.append((name, n, v, h))
        return out

    def train(self, callbacks: list[Callable[[CallbackEnv], None]] | None = None) -> Model:
        p = self.p
        stopper = Stopper(p.early_stopping_round, p.early_stopping_min_delta, p.first_metric_only) if p.early_stopping_round > 0 else None
        if stopper and not self.valid:
            raise ValueError("early stopping needs a validation set")
        hooks = sorted(callbacks or [], key=lambda c: getattr(c, "order", 0))
        env = lambda i, results: CallbackEnv(self.model, p, i, 0, p.num_iterations, results)
        begun = len(self.model.trees) // self.k
        try:
            for i in range(p.num_iterations):
                for c in hooks:
                    if getattr(c, "before_iteration", False):
                        c(env(i, []))
                self.round(i)
                if (i + 1) % p.metric_freq == 0 or i == p.num_iterations - 1:
                    results = self.evaluate(i)
                    self.history += [(i, s, m, v) for s, m, v, _ in results]
                    best = stopper.update(i, results) if stopper else None
                    if best is not None:
                        self.model.best_iteration = begun + best + 1
                        self.model.truncate(begun + best + 1)
                        break
                    for c in hooks:
                        if not getattr(c, "before_iteration", False):
                            c(env(i, results))
        except EarlyStopException as stop:
            self.model.best_iteration = begun + stop.best_iteration + 1
            self.model.truncate(begun + stop.best_iteration + 1)
        finally:
            for df in (self.state, self.spent):
                if df is not None:
                    df.unpersist()
            for df in self.valid.values():
                df.unpersist()
            remove(self.spark, self.written)
        if not self.model.trees:  # no rounds: constants
            self.model.trees = [Tree(leaves=[Leaf(float(v))]) for v in self.init]
        return self.model

    def history_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.history, "iteration int, dataset string, metric string, value double")


def read_forced(text: str, features: int, depth: int = 0, node: Any = None) -> dict[str, Any]:
    """Forced splits from JSON: feature, threshold, left, right; at most 64 levels."""
    node = json.loads(text) if node is None else node
    if depth > 64:
        raise ValueError("forced splits go too deep")
    if not 0 <= int(node["feature"]) < features or not abs(float(node["threshold"])) < float("inf"):
        raise ValueError(f"forced split out of range: {node!r}")
    return {"feature": int(node["feature"]), "threshold": float(node["threshold"])} | {k: read_forced("", features, depth + 1, node[k]) for k in ("left", "right") if node.get(k)}


def refit(model: Model, data: TrainSet, params: Params | None = None, decay: float | None = None) -> Model:
    """New leaf values on new data, tree by tree: decay * old + (1 - decay) * Newton step * shrinkage, with the model's objective."""
    p = params or Params.of(objective=model.objective, num_class=model.num_class)
    decay = p.refit_decay_rate if decay is None else decay
    out = Model.from_text(model.to_text())
    o, k = objectives.find(model.objective), model.num_class
    base = F.array(*([F.lit(0.0)] * k)) if k > 1 else F.lit(0.0)
    rows = data.df.select(F.col(data.label).cast("double").alias("_label"), *(F.col(f"`{f}`").cast("double").alias(f"_x{i}") for i, f in enumerate(model.features))).withColumn("score", base)
    names = [f"_x{i}" for i in range(len(model.features))]
    written: list[str] = []
    spent: list[DataFrame] = []
    for i in range(model.iterations):
        g, h = o.gradients(F.col("score"), F.col("_label"), num_class=k, **_options(p))
        sums = rows.withColumns({"grad": g, "hess": h})
        for c in range(k):
            tree = out.trees[i * k + c]
            leaf = F.expr(tree_sql(tree, names, "leaf"))
            one = sums.withColumn("leaf", leaf) if k == 1 else sums.withColumns({"leaf": leaf, "grad": F.element_at("grad", c + 1), "hess": F.element_at("hess", c + 1)})
            found = {r["leaf"]: r for r in histogram.leaf_totals(one).collect()}  # a row a leaf
            for j, x in enumerate(tree.leaves):
                if j in found:
                    shrunk = max(abs(found[j]["g"]) - p.lambda_l1, 0.0) * (-1 if found[j]["g"] < 0 else 1)
                    new = -shrunk / (found[j]["h"] + p.lambda_l2) if found[j]["h"] + p.lambda_l2 else 0.0
                    x.value = decay * x.value + (1 - decay) * new * tree.shrinkage
            more = F.expr(tree_sql(tree, names))
            rows = rows.withColumn("score", _into(F.col("score"), k, c, more))
        old, rows = rows, (materialise(rows, "refit", written) if (i + 1) % CUT == 0 else rows).cache()
        spent.append(old)
        if len(spent) > 1:
            spent.pop(0).unpersist()  # the next round reads its successor
    for x in (*spent, rows):
        x.unpersist()
    remove(data.df.sparkSession, written)
    return out
