"""Queries that train models."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.operators import sampling
from thicket.plans import api
from thicket.plans.api import ByArrays, Dataset, TrainSet, predict, train
from thicket.plans.estimators import BoostedClassifier
from thicket.plans.model import Model
from thicket.plans.tables import scratch_folder
from thicket.queries import oracle
from thicket.queries.base import WITH, query, r6, shared

FEATURES = ["f0", "f1", "f2"]
BASE = {"num_leaves": 7, "num_iterations": 3, "min_data_in_leaf": 20, "min_data_in_bin": 1, "learning_rate": 0.3, "verbosity": -1}


def _model(spark: SparkSession, sf_dir: str, label: str, categorical: tuple[str, ...] = (), **params: Any) -> Model:
    df = shared(spark, sf_dir).withColumn("label", F.col(label))
    data = TrainSet(df, FEATURES, row_id="row_id", query="query_id" if params.get("objective") in ("lambdarank", "rank_xendcg") else None, categorical=list(categorical))
    return train({**BASE, **params}, data)


def _train(spark: SparkSession, sf_dir: str, label: str, **params: Any) -> DataFrame:
    """The nodes of a small model, rounded."""
    nodes = _model(spark, sf_dir, label, **params).node_table(spark)
    return nodes.select("tree", "node", "feature", r6("threshold", "threshold"), r6("gain", "gain"), r6("value", "value"), "count")


def _parts(model: Model, spark: SparkSession) -> DataFrame:
    """Splits and leaves as the SQL that trains gives them: where a leaf lacks some values, several thresholds part its rows alike."""
    inner = F.col("feature").isNotNull()
    return model.node_table(spark).select("tree", "feature", F.round("gain", 4).alias("gain"), F.when(~inner, F.round("value", 6)).alias("value"), "count")


_ROOT = f"""{WITH}, m AS (SELECT avg(y) AS mu FROM t), v AS (SELECT f2 AS v, sum(mu - y) AS g, count(*) AS n FROM t, m GROUP BY f2), u AS (SELECT v, sum(g) OVER (ORDER BY v) AS lg, sum(n) OVER (ORDER BY v) AS ln, sum(g) OVER () AS sg, sum(n) OVER () AS sn, (v + lead(v) OVER (ORDER BY v)) / 2 AS mid FROM v),
    c AS (SELECT lg * lg / ln + (sg - lg) * (sg - lg) / (sn - ln) - sg * sg / sn AS gain, ln, mid FROM u WHERE ln < sn)
    SELECT round(gain, 4) AS gain, CAST(ln AS BIGINT) AS n_left FROM c ORDER BY gain DESC LIMIT 1"""


@query("bo01_root_split", _ROOT)
def root_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir).withColumn("label", F.col("y"))
    model = train({"num_leaves": 2, "num_iterations": 1, "min_data_in_bin": 1, "min_data_in_leaf": 1}, TrainSet(df, ["f2"], row_id="row_id"))
    tree = model.trees[0]
    left = tree.leaves[~tree.nodes[0].left]
    return spark.createDataFrame([(round(tree.nodes[0].gain, 4), left.count)], "gain double, n_left long")


@query("bo02_first_scores", f"{WITH} SELECT round(avg(y), 6) AS first FROM t")
def first_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir).withColumn("label", F.col("y"))
    # no leaf may split, so the model is its constant
    model = train({**BASE, "min_data_in_leaf": 10**9}, TrainSet(df, FEATURES, row_id="row_id"))
    return spark.createDataFrame([(round(model.trees[0].leaves[0].value, 6),)], "first double")


def _enter(name: str, label: str, oracle_: dict[str, Any] | None = None, **params: Any) -> None:
    """A training as a query; with SQL where ``oracle_`` says how to train alike."""
    if oracle_ is None:
        query(name)(lambda spark, sf_dir: _train(spark, sf_dir, label, **params))
    else:
        query(name, oracle.trees(**{"label": label, **oracle_}))(lambda spark, sf_dir: _parts(_model(spark, sf_dir, label, **params), spark))


_enter("bo01_regression", "y", {})
_enter("bo01_binary", "yb", {"objective": "binary"}, objective="binary")
_enter("bo01_l1", "y", {"objective": "regression_l1"}, objective="regression_l1")
_enter("bo01_multiclass", "yc", {"several": True}, objective="multiclass", num_class=3)
_enter("bo01_lambdarank", "rel", objective="lambdarank")
_enter("bo01_categorical", "y", categorical=("f2",))
_enter("bo04_random_forest", "y", {"forest": True, "bag": 0.6}, boosting="rf", bagging_freq=1, bagging_fraction=0.6)
_enter("sm04_bagged_training", "y", {"bag": 0.5}, bagging_freq=1, bagging_fraction=0.5)
_enter("sm08_dart", "y", boosting="dart", skip_drop=0.0, drop_rate=0.5)
_enter("sm05_goss", "y", {"goss": True, "rate": 0.9}, data_sample_strategy="goss", learning_rate=0.9)
_enter("sm07_feature_fraction", "y", feature_fraction=0.7)
_enter("tr22_interaction", "y", {"groups": ((0, 1), (2,))}, interaction_constraints="[0,1],[2]")
_enter("tr23_extra_trees", "y", extra_trees=True)
_enter("tr24_forced_splits", "y", {"forced": ((0, 1, 3.0), (0, 2, 2.0))}, forcedsplits_filename='{"feature": 1, "threshold": 3.0, "left": {"feature": 2, "threshold": 2.0}}')
_enter("tr25_coupled_costs", "y", cegb_penalty_feature_coupled=[0.0, 50.0, 0.0])
_enter("tr25_lazy_costs", "rs", {"lazy": (0.002, 0.05, 0.004)}, cegb_penalty_feature_lazy=[0.002, 0.05, 0.004])
_enter("tr26_leaf_wise", "y", {"leaves": 15, "depth": 4}, num_leaves=15, max_depth=4)
_enter("tr31_linear_tree", "y", linear_tree=True)
_enter("tr32_quantised", "y", {"quantised": True}, use_quantized_grad=True, quant_train_renew_leaf=True)
_enter("bn15_bundled", "y", {}, enable_bundle=True)


@query("pr10_importance", f"{oracle.training(label='rs')} SELECT 'f' || feature AS feature, CAST(count(*) AS DOUBLE) AS split, round(sum(gain), 3) AS gain FROM trees WHERE feature IS NOT NULL GROUP BY feature")
def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _model(spark, sf_dir, "rs")
    rows = [(f, n, round(g, 3)) for f, n, g in zip(model.features, model.importance(), model.importance("gain"), strict=True) if n]
    return spark.createDataFrame(rows, "feature string, split double, gain double")


_OWN = "row_id % 5 <> 0"
_NOISE = {"rounds": 6, "rate": 0.9, "label": "rs", "rows": _OWN}
_STOP = " UNION ALL ".join(f"SELECT {r} AS r, avg((s - y) * (s - y)) AS v FROM s{r + 1} WHERE NOT own" for r in range(6))


@query(
    "bo10_early_stopping",
    f"{oracle.training(**_NOISE)}, m AS ({_STOP}), b AS (SELECT r, (SELECT arg_min(o.r, o.v) FROM m o WHERE o.r <= m.r) AS best FROM m), e AS (SELECT min(r) AS stop FROM b WHERE r - best >= 2) SELECT CAST(coalesce((SELECT best + 1 FROM b, e WHERE r = stop), 0) AS INTEGER) AS best",
)
def early_stopping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best round of a training on noise, by a validation set."""
    df = shared(spark, sf_dir).withColumn("label", F.col("rs"))
    own, other = (TrainSet(df.where(c), FEATURES, row_id="row_id") for c in (_OWN, f"NOT {_OWN}"))
    model = train({**BASE, "num_iterations": 6, "learning_rate": 0.9, "early_stopping_round": 2}, own, valid_sets=[other])
    return spark.createDataFrame([(model.best_iteration,)], "best int")


_METRICS = " UNION ALL ".join(f"SELECT {r} AS iteration, CASE WHEN own THEN 'training' ELSE 'valid_0' END AS dataset, y, s FROM s{r + 1}" for r in range(3))
_HISTORY = f"""{oracle.training(objective='binary', label='yb', rows=_OWN)}, e AS MATERIALIZED ({_METRICS}),
    u AS (SELECT iteration, dataset, s, sum(y) AS p, sum(1 - y) AS n FROM e GROUP BY ALL),
    o AS (SELECT *, sum(p) OVER (PARTITION BY iteration, dataset ORDER BY s DESC) - p AS ahead FROM u)
    SELECT CAST(iteration AS INTEGER) AS iteration, dataset, 'auc' AS metric, round(sum(n * (ahead + p / 2)) / (sum(p) * sum(n)), 6) AS value FROM o GROUP BY ALL
    UNION ALL SELECT iteration, dataset, 'binary_logloss', round(avg(-(y * ln(1 / (1 + exp(-s))) + (1 - y) * ln(1 - 1 / (1 + exp(-s))))), 6) FROM e GROUP BY ALL"""


@query("bo11_history", _HISTORY)
def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir).withColumn("label", F.col("yb"))
    part = F.expr(f"NOT {_OWN}")
    kept: dict[str, dict[str, list[float]]] = {}
    own = {"features": FEATURES, "row_id": "row_id"}
    train({**BASE, "objective": "binary", "metric": "auc,binary_logloss", "is_provide_training_metric": True}, TrainSet(df.where(~part), **own), valid_sets=[TrainSet(df.where(part), **own)], callbacks=[api.record_evaluation(kept)])
    rows = [(i, s, m, round(v, 6)) for s, ms in kept.items() for m, vs in ms.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "iteration int, dataset string, metric string, value double")


_STARTED = oracle.training(objective="given", rows=_OWN, start="t.s * 9 + t.rs")


@query("bo12_init_score", f"{_STARTED} {' UNION ALL '.join(f'SELECT {r} AS iteration, round(avg((s - y) * (s - y)), 6) AS value FROM s{r + 1} WHERE NOT own' for r in range(3))}")
def start_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The loss of a validation set round by round, where each row of both sets starts from a score of its own."""
    df = shared(spark, sf_dir).withColumns({"label": F.col("y"), "start": F.col("s") * 9 + F.col("rs")})
    kept: dict[str, dict[str, list[float]]] = {}
    own, other = (TrainSet(df.where(c), FEATURES, row_id="row_id", init_score="start") for c in (_OWN, f"NOT {_OWN}"))
    train({**BASE, "metric": "l2"}, own, valid_sets=[other], callbacks=[api.record_evaluation(kept)])
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(kept["valid_0"]["l2"])], "iteration int, value double")


@query("io02_sparse_training", oracle.trees())
def sparse_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of rows that hold only what isn't zero: those of the same columns."""
    some = F.filter(F.transform(F.array(*(F.struct(F.lit(i).alias("i"), F.coalesce(F.col(c), F.lit(float("nan"))).alias("v")) for i, c in enumerate(FEATURES))), lambda e: e), lambda e: e["v"] != 0)
    df = shared(spark, sf_dir).select("row_id", F.col("y").alias("label"), some.alias("e")).select("row_id", "label", F.col("e.i").alias("indices"), F.col("e.v").alias("values"))
    return _parts(train(BASE, TrainSet(df, FEATURES, row_id="row_id", sparse=("indices", "values"))), spark)


@query("io12_data_set", oracle.trees(rounds=2))
def data_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of a table that was binned and written before."""
    data = TrainSet(shared(spark, sf_dir).withColumn("label", F.col("y")), FEATURES, row_id="row_id")
    with scratch_folder(spark, "data-set") as path:
        Dataset.build(data, BASE, path)
        return _parts(train(BASE, Dataset.load(spark, path), 2), spark)


@query("py06_by_arrays", oracle.trees(objective="given"))
def by_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees of an objective that is a function of arrays."""
    data = TrainSet(shared(spark, sf_dir).withColumn("label", F.col("y")), FEATURES, row_id="row_id")
    return _parts(train(BASE, data, fobj=ByArrays(lambda labels, scores: (scores - labels, scores * 0 + 1))), spark)


@query("bo13_refit", f"{WITH} SELECT leaf, round(mean, 6) AS value FROM (SELECT CASE WHEN f1 <= 3 THEN 0 ELSE 1 END AS leaf, 5e-1 * CASE WHEN f1 <= 3 THEN 5e-1 ELSE -5e-1 END + 5e-1 * avg(y) AS mean FROM t GROUP BY f1 <= 3)")
def refit(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.plans.model import Leaf, Node, Tree

    model = Model(["f1"], "regression", 1, [Tree([Node(0, 3.0, 0, -1, -2)], [Leaf(0.5), Leaf(-0.5)])])
    out = api.refit(model, TrainSet(shared(spark, sf_dir).withColumn("label", F.col("y")), ["f1"]), decay=0.5)
    return spark.createDataFrame([(i, round(x.value, 6)) for i, x in enumerate(out.trees[0].leaves)], "leaf int, value double")


@query("bo14_continued", oracle.trees())
def continued(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir).withColumn("label", F.col("y"))
    data = TrainSet(df, FEATURES, row_id="row_id")
    one = train(BASE, data, 2)
    two = train(BASE, data, 1, init_model=one)
    return _parts(two, spark)


@query("py02_folds", f"{WITH} SELECT CAST(yb AS INTEGER) AS class, count(*) AS n FROM t GROUP BY 1")
def folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = api.folds(shared(spark, sf_dir), 5, "row_id", "yb")
    sizes = dealt.groupBy("yb", "fold").agg(F.count(F.lit(1)).alias("n"))
    even = sizes.groupBy("yb").agg(F.sum("n").alias("n"), (F.max("n") - F.min("n")).alias("gap")).where("gap <= 1")
    return even.select(F.col("yb").cast("int").alias("class"), "n")


_FOLD = f"floor({oracle.draw('row_id', '0')} * 3)"
_FOLDS = " UNION ALL ".join(
    f"SELECT * FROM ({oracle.training(rounds=2, rows=f'{_FOLD} <> {f}')} SELECT {f} AS fold, 0 AS r, avg((s - y) * (s - y)) AS v FROM s1 WHERE NOT own UNION ALL SELECT {f}, 1, avg((s - y) * (s - y)) FROM s2 WHERE NOT own)"
    for f in range(3)
)


@query("py02_cv", f"SELECT 'valid l2-' || n.n AS name, CAST(r AS INTEGER) AS iteration, round(CASE n.n WHEN 'mean' THEN avg(v) ELSE stddev_pop(v) END, 6) AS value FROM ({_FOLDS}), (VALUES ('mean'), ('stdv')) n(n) GROUP BY n.n, r")
def cross_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir).withColumn("label", F.col("y"))
    out = api.cv({**BASE, "metric": "l2"}, TrainSet(df, FEATURES, row_id="row_id"), 2, 3)
    return spark.createDataFrame([(k, i, round(v, 6)) for k, vs in out.items() for i, v in enumerate(vs)], "name string, iteration int, value double")


@query("py05_classifier", f"{oracle.training(objective='binary', label='yb')} SELECT row_id, CASE WHEN s > 0 THEN 1e0 ELSE 0e0 END AS prediction, round(1 / (1 + exp(-s)), 6) AS probability FROM s3")
def classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir)
    fitted = BoostedClassifier(features=FEATURES, labelCol="yb", rowIdCol="row_id", options=BASE).fit(df)
    return fitted.transform(df).select("row_id", "prediction", r6(F.col("probability")[1], "probability"))


_DRAW = "(214013 * {} + 2531011) & 4294967295"


@query("sm10_random_numbers", f"{WITH}, a AS (SELECT row_id, {_DRAW.format('(row_id & 4294967295)')} AS x FROM t), b AS (SELECT row_id, x, {_DRAW.format('x')} AS z FROM a) SELECT row_id, CAST(((x >> 16) & 32767) % 32767 AS INTEGER) AS first, CAST(((z >> 16) & 32767) % 100 + 5 AS INTEGER) AS second FROM b")
def random_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two numbers of the generator that each row's id seeds."""
    seed = F.col("row_id")
    return shared(spark, sf_dir).select("row_id", sampling.lcg_short(seed, 0, 32767).alias("first"), sampling.lcg_short(seed, 5, 105, 1).alias("second"))


@query("io13_model_text", f"{oracle.training()} SELECT row_id, round(s, 6) AS prediction FROM s3")
def model_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of a trained model that has been text in between."""
    model = _model(spark, sf_dir, "y")
    return predict(shared(spark, sf_dir), Model.from_text(model.to_text())).select("row_id", r6("prediction", "prediction"))


@query("st01_batch_loss", "SELECT date_trunc('hour', ts) AS start, round(avg((value - 1e1) * (value - 1e1)), 2) AS loss, count(*) AS n FROM events GROUP BY 1")
def batch_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.streaming.score import windowed_loss

    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", F.col("value").alias("label"), F.lit(10.0).alias("prediction"))
    return windowed_loss(df, "l2").select("start", F.round("loss", 2).alias("loss"), "n")


__all__ = ["predict"]
