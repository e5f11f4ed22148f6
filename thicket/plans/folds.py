"""Models of all folds of a cross-validation, trained together.

The table is binned once. A row has a score for each fold's model; a model's histograms leave out the rows of its fold, which are the ones it is judged by. The trees of
all folds (and classes) of a round grow in step, so a round takes as many jobs as one training's, and point-wise metrics of all folds come from one aggregation.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.functions import metrics, objectives
from thicket.operators import sampling
from thicket.operators.counting import Slot
from thicket.plans.boosting import CUT, Booster, Stopper, _options, steady
from thicket.plans.dataset import Dataset, TrainSet
from thicket.plans.grower import Grower, Searcher, grow_all
from thicket.plans.model import Leaf, Model, Tree
from thicket.plans.params import Params
from thicket.plans.tables import materialise, remove, scratch


def together(p: Params) -> bool:
    """Whether folds of these parameters can be trained together: what a round draws, drops or solves on rows of its own is done fold by fold instead."""
    bagged = p.bagging_freq > 0 and (p.bagging_fraction < 1 or p.pos_bagging_fraction < 1 or p.neg_bagging_fraction < 1)
    o = objectives.find(p.objective)
    return p.boosting == "gbdt" and p.data_sample_strategy != "goss" and not bagged and not p.use_quantized_grad and not p.linear_tree and not p.enable_bundle and not p.cegb_penalty_feature_coupled and not any(p.cegb_penalty_feature_lazy) and o.kind != "rank" and not o.renew


class Folds:
    """``data`` has a column ``fold``, from 0 to n - 1. Models, and what is trained, are kept by fold; a fold whose early stopping says so is done."""

    def __init__(self, data: TrainSet, params: Params, n: int) -> None:
        self.p, self.n, self.k, self.spark = params, n, params.num_class, data.df.sparkSession
        self.written: list[str] = []
        df = data.checked().df
        self.objective = objectives.find(params.objective)
        y = objectives.sqrt_label(F.col(data.label).cast("double")) if params.reg_sqrt else F.col(data.label).cast("double")
        classes = self.k if self.objective.kind == "multiclass" else 0
        self.facts = [objectives.LabelFacts.of(df.where(F.col("fold") != f), y, data.weight, classes) for f in range(n)]
        whole = sum(f.n for f in self.facts) // max(1, n - 1)
        self.set = Dataset.prepare(data, params, whole, keep=["fold"])
        # a booster for each fold holds its model, constants and draws; the table is common to all
        self.boosters = []
        for f in range(n):
            b = Booster.__new__(Booster)
            b.p, b.fobj, b.feval, b.objective, b.k, b.data, b.spark, b.rank, b.sparse = params, None, None, self.objective, self.k, self.set, self.spark, False, None
            b.setup(self.facts[f])
            self.boosters.append(b)
        self.features = self.boosters[0].features
        table = self.set.df.withColumns({"_label": self.boosters[0]._target("_y"), "_fold": F.col("fold").cast("int")}).drop("_y", "fold")
        base = [F.coalesce(F.col("_init").cast(b._kind()), b._constant()) if self.set.started else b._constant() for b in self.boosters]
        self.state = table.withColumn("score", F.array(*base)).drop("_init").repartition(max(table.rdd.getNumPartitions(), self.spark.sparkContext.defaultParallelism)).cache()
        self.parts = self.state.rdd.getNumPartitions()
        self.live = set(range(n))
        self.stoppers = [Stopper(params.early_stopping_round, params.early_stopping_min_delta, params.first_metric_only) if params.early_stopping_round > 0 else None for _ in range(n)]
        self.history: list[list[dict[str, float]]] = [[] for _ in range(n)]

    def _gradients(self) -> DataFrame:
        g, h = [], []
        for f, b in enumerate(self.boosters):
            one = self.objective.gradients(F.col("score")[f], F.col("_label"), num_class=self.k, pos_weight=b.pos, neg_weight=b.neg, **_options(self.p))
            for out, x in zip((g, h), one, strict=True):
                out += [x[c] for c in range(self.k)] if self.k > 1 else [x]
        w = F.col("_weight")
        return self.state.withColumns({name: F.array(*((x * w if self.set.weighted else x) for x in xs)) for name, xs in (("grad", g), ("hess", h))})

    def round(self, iteration: int) -> None:
        p = self.p
        growers, slots = [], []
        folds = sorted(self.live)
        for f in folds:
            b = self.boosters[f]
            drawn = set(sampling.column_sample([x.index for x in self.features], p.feature_fraction, b.rngs["feature_fraction_seed"])) if p.feature_fraction < 1 else None
            for c in range(self.k):
                slots.append(Slot(gradient=f * self.k + c, fold=f))
                growers.append(Grower(self.set.mappers, b.grow_params, self.features, b.used, b.rngs["extra_seed"], len(slots) - 1, drawn))
        table = self.boosters[0]._counted(self.features)
        searcher = Searcher(self._gradients(), table, slots, self.boosters[0].grow_params.split, p.num_leaves, self.parts)
        grown = grow_all(searcher, growers)
        scores = [F.col("score")[f] for f in range(self.n)]
        for i, f in enumerate(folds):
            own, b = grown[i * self.k : (i + 1) * self.k], self.boosters[f]
            for c, (tree, route, _) in enumerate(own):
                if not steady(tree, p):
                    tree.leaves[0].value = 0.0
                tree.shrink(p.learning_rate)
                scores[f] = b._into(scores[f], c, b._output(route, tree))
                if not b.model.trees[c :: self.k]:
                    tree.add_bias(b.init[c])
                b.model.trees.append(tree)
        fresh = self.state.withColumn("score", F.array(*scores))
        fresh = (materialise(fresh, "folds", self.written) if (iteration + 1) % CUT == 0 else fresh).cache()
        old, self.state = self.state, fresh
        self._evaluate(iteration, folds)
        old.unpersist()

    def _evaluate(self, iteration: int, folds: list[int]) -> None:
        p = self.p
        if (iteration + 1) % p.metric_freq and iteration != p.num_iterations - 1:
            self.state.count()
            return
        more = {"alpha": p.alpha, "fair_c": p.fair_c, "tweedie_variance_power": p.tweedie_variance_power, "multi_error_top_k": p.multi_error_top_k, "auc_mu_weights": p.auc_mu_matrix()}
        weight = "weight" if self.set.weighted else None

        def flat(raw: Any) -> DataFrame:
            rows = self.state.select(raw.alias("raw"), F.col("_label").alias("label"), F.col("_row_id").alias("row_id"), F.col("_weight").alias("weight"), "_fold")
            return rows.withColumn("score", objectives.transform(p.objective, F.col("raw"), p.sigmoid))

        with scratch(self.spark):
            found = {f: [] for f in folds}
            if p.is_provide_training_metric:
                for f in folds:
                    found[f] += [("training", *x) for x in metrics.evaluate_all(flat(F.col("score")[f]).where(F.col("_fold") != f), p.metric, self.k, tuple(p.eval_at), weight, **more)]
            judged = metrics.evaluate_all(flat(F.element_at("score", F.col("_fold") + 1)), p.metric, self.k, tuple(p.eval_at), weight, by="_fold", **more)
        for f in folds:
            found[f] += [("valid", *x) for x in judged[f]]
            self.history[f].append({f"{dataset} {metric}": value for dataset, metric, value, _ in found[f]})
            best = self.stoppers[f].update(iteration, found[f]) if self.stoppers[f] else None
            if best is not None:
                model = self.boosters[f].model
                model.best_iteration = best + 1
                model.truncate(best + 1)
                self.live.discard(f)

    def train(self) -> list[Model]:
        try:
            for i in range(self.p.num_iterations):
                if not self.live:
                    break
                self.round(i)
        finally:
            self.state.unpersist()
            remove(self.spark, self.written)
        for b in self.boosters:
            if not b.model.trees:
                b.model.trees = [Tree(leaves=[Leaf(float(v))]) for v in b.init]
        return [b.model for b in self.boosters]
