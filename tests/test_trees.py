"""Trees: search, growth, prediction, contributions, persistence, parameters."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import binning, bundling, sampling, scan, split
from thicket.operators.binning import BinMapper
from thicket.operators.split import Feature, SplitParams
from thicket.plans import api
from thicket.plans.api import TrainSet, predict, train
from thicket.plans.boosting import Booster
from thicket.plans.estimators import BoostedClassifier, BoostedModel, BoostedRanker, BoostedRegressor
from thicket.plans.model import Leaf, Model, Node, Tree
from thicket.plans.params import Params, parse_groups
from thicket.plans.shap import tree_contributions
from thicket.queries.trees import small_model
from thicket.sources import matrix


def _hist(spark, seed=0, leaves=2):
    rng = np.random.default_rng(seed)
    rows = [(leaf, f, b, float(rng.normal()) * 5, float(rng.integers(1, 30)), 0) for leaf in range(leaves) for f in range(4) for b in range(8)]
    rows = [(a, f, b, g, h, int(h)) for a, f, b, g, h, _ in rows if (f, b) != (1, 3)]
    # features of one leaf have equal totals
    out = []
    for leaf in range(leaves):
        base = {f: [r for r in rows if r[0] == leaf and r[1] == f] for f in range(4)}
        g, h = sum(r[3] for r in base[0]), sum(r[4] for r in base[0])
        for rs in base.values():
            dg, dh = g - sum(r[3] for r in rs), h - sum(r[4] for r in rs)
            last = rs[-1]
            rs[-1] = (*last[:3], last[3] + dg, max(1.0, last[4] + dh), max(1, int(last[4] + dh)))
            out += rs
    return spark.createDataFrame(out, "leaf int, feature int, bin int, g double, h double, n long"), out


@pytest.mark.parametrize(
    "params",
    [
        SplitParams(min_data_in_leaf=3),
        SplitParams(min_data_in_leaf=3, lambda_l1=1.0, lambda_l2=2.0, max_delta_step=0.3),
        SplitParams(min_data_in_leaf=3, path_smooth=5.0, min_gain_to_split=0.1),
        SplitParams(min_data_in_leaf=3, max_cat_to_onehot=10, count_mode="hessian"),
        SplitParams(min_data_in_leaf=3, min_data_per_group=5, cat_smooth=2.0, monotone_penalty=0.5),
    ],
)
def test_the_two_searches_agree(spark, params):
    features = [Feature(0, 8, "nan"), Feature(1, 8, "zero", 2), Feature(2, 8, monotone=1), Feature(3, 8, categorical=True)]
    for seed in range(3):
        df, rows = _hist(spark, seed)
        context = spark.createDataFrame([(i, 0.1, float("-inf"), float("inf"), 1) for i in range(2)], "leaf int, parent_output double, lo double, hi double, depth int")
        found = {r["leaf"]: r for r in split.best(split.scored(split.candidates(df, features, params), params, context), ["leaf"]).collect()}
        for leaf in range(2):
            dense = scan.Dense(np.zeros((4, 8)), np.zeros((4, 8)), np.zeros((4, 8), np.int64))
            for a, f, b, g, h, n in rows:
                if a == leaf:
                    dense.g[f, b], dense.h[f, b], dense.n[f, b] = g, h, n
            one = scan.best_split(dense, features, params, 0.1, depth=1)
            two = found.get(leaf)
            assert (one is None) == (two is None)
            if one:
                assert one["feature"] == two["feature"] and one["gain"] == pytest.approx(two["gain"], rel=1e-9)
                assert (one["cats"] and sorted(one["cats"])) == (two["cats"] and sorted(two["cats"]))
                assert one["cats"] or (one["threshold"], one["dir"]) == (two["threshold"], two["dir"])


def _data(spark, n=600):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(n, 3))
    x[::13, 0] = np.nan
    cat = rng.integers(0, 6, n)
    y = 2 * np.nan_to_num(x[:, 0]) + (x[:, 1] > 0.3) * 3 + np.array([0, 5, -2, 1, 0, 3])[cat] + rng.normal(size=n) * 0.1
    rows = [(i, float(y[i]), *(None if math.isnan(v) else float(v) for v in x[i]), float(cat[i]), i % 40) for i in range(n)]
    return spark.createDataFrame(rows, "row_id long, label double, a double, b double, c double, cat double, q int").repartition(3).cache()


FEATURES = ["a", "b", "c", "cat"]
SMALL = {"num_leaves": 8, "min_data_in_leaf": 10, "learning_rate": 0.3, "num_iterations": 4}


def _set(df, **more):
    return TrainSet(df, FEATURES, row_id="row_id", categorical=["cat"], **more)


def test_training_predicts_what_it_scored(spark):
    df = _data(spark)
    model = train(SMALL, _set(df))
    out = predict(df, model).agg(F.avg((F.col("prediction") - F.col("label")) ** 2).alias("mse"), F.var_pop("label").alias("var")).first()
    assert out["mse"] < 0.4 * out["var"]
    a = predict(df, model, "raw", "one", engine="expression")
    both = predict(a, model, "raw", "two", engine="batch").agg(F.max(F.abs(F.col("one") - F.col("two"))).alias("d")).first()
    assert both["d"] < 1e-12
    assert sum(x.count for x in model.trees[0].leaves) == 600
    assert Model.from_text(model.to_text()).to_text() == model.to_text()
    assert model.to_json()["tree_info"][0]["num_leaves"] == len(model.trees[0].leaves)
    leaves = predict(df, model, "leaf").select(F.col("prediction")[0].alias("leaf")).groupBy("leaf").count().collect()
    assert {r["leaf"]: r["count"] for r in leaves} == {i: x.count for i, x in enumerate(model.trees[0].leaves)}
    contrib = predict(predict(df, model, "raw", "raw"), model, "contrib", "shares")
    assert contrib.agg(F.max(F.abs(F.aggregate("shares", F.lit(0.0), lambda s, v: s + v) - F.col("raw"))).alias("d")).first()["d"] < 1e-9


@pytest.mark.parametrize(
    ("objective", "label", "more"),
    [
        ("binary", "label > 1", {}),
        ("regression_l1", "label", {}),
        ("poisson", "abs(label)", {}),
        ("multiclass", "pmod(cast(cat as int), 3)", {"num_class": 3}),
        ("lambdarank", "pmod(cast(cat as int), 4)", {}),
        ("regression", "label", {"boosting": "dart", "skip_drop": 0.0, "drop_rate": 0.6}),
        ("regression", "label", {"boosting": "rf", "bagging_freq": 1, "bagging_fraction": 0.7}),
        ("regression", "label", {"linear_tree": True}),
        ("regression", "label", {"use_quantized_grad": True, "quant_train_renew_leaf": True, "num_grad_quant_bins": 16}),
        ("regression", "label", {"interaction_constraints": "[0,1],[2,3]", "extra_trees": True}),
        ("regression", "label", {"monotone_constraints": [1, 0, 0, 0], "path_smooth": 2.0}),
    ],
)
def test_variants_learn(spark, objective, label, more):
    df = _data(spark).withColumn("label", F.expr(f"cast({label} as double)"))
    kept: dict = {}
    data = _set(df, query="q" if objective == "lambdarank" else None)
    train({**SMALL, "objective": objective, **more, "num_iterations": 3}, data, valid_sets=[data], callbacks=[api.record_evaluation(kept)])
    metric, values = next(iter(kept["valid_0"].items()))
    better = values[-1] >= values[0] if metric.startswith("ndcg") else values[-1] <= values[0] * (1.15 if more.get("boosting") == "rf" else 1.0)
    assert better, (metric, values)


def test_pre_filter_scales_with_the_sample(spark):
    df = spark.range(20_000).select(F.col("id").alias("row_id"), F.expr("double(id % 100 = 0)").alias("a"), F.expr("double(id % 7)").alias("b"), F.expr("double(id = 5)").alias("c"), F.expr("double(id % 100 = 0)").alias("label"))
    data = TrainSet(df, ["a", "b", "c"], row_id="row_id")
    model = train({"num_leaves": 2, "min_data_in_leaf": 20, "num_iterations": 1, "feature_pre_filter": True, "bin_construct_sample_cnt": 1000}, data)
    assert [n.feature for n in model.trees[0].nodes] == [0]  # 200 rows, about 10 of them in the sample


def test_monotone_model_is_monotone(spark):
    df = _data(spark)
    model = train({**SMALL, "monotone_constraints": [1, 0, 0, 0]}, _set(df))
    for tree in model.trees:
        values = [tree.output([a, 0.0, 0.0, 1.0]) for a in np.linspace(-3, 3, 60)]
        assert all(y >= x - 1e-12 for x, y in itertools.pairwise(values))


def test_early_stopping_and_continuing(spark):
    df = _data(spark)
    own, other = _set(df.where("row_id % 4 <> 0")), _set(df.where("row_id % 4 = 0").withColumn("label", F.rand(1)))
    model = train({**SMALL, "early_stopping_round": 2, "num_iterations": 30}, own, valid_sets=[other])
    assert model.best_iteration == model.iterations < 30
    with pytest.raises(ValueError, match="validation"):
        train({**SMALL, "early_stopping_round": 2}, own)
    two = train(SMALL, own, 2)
    more = train(SMALL, own, 1, init_model=two)
    assert more.iterations == 3
    same = api.refit(two, own, decay=1.0)
    assert same.to_text() == two.to_text()


def test_missing_against_all_others(spark):
    """The best split leaves only missing values on one side: its threshold is infinite."""
    import duckdb

    df = spark.range(400).selectExpr("id AS row_id", "CASE WHEN id % 4 = 0 THEN NULL ELSE double(id) END AS a", "CASE WHEN id % 4 = 0 THEN 5D ELSE 0D END + double(id % 3) / 100 AS label").cache()
    rows, kept = TrainSet(df, ["a"], row_id="row_id"), {}
    model = train({**SMALL, "num_leaves": 2}, rows, 2, valid_sets=[rows], callbacks=[api.record_evaluation(kept)])
    assert model.trees[0].nodes[0].threshold == math.inf and kept["valid_0"]["l2"][1] < kept["valid_0"]["l2"][0]
    assert train({**SMALL, "num_leaves": 2}, rows, 1, init_model=model).iterations == 3
    assert train({**SMALL, "num_leaves": 2, "boosting": "dart", "skip_drop": 0.0, "drop_rate": 1.0}, rows, 3, valid_sets=[rows]).iterations >= 3
    again = Model.from_text(model.to_text())
    assert again.to_text() == model.to_text() and api.refit(again, rows, decay=1.0).to_text() == model.to_text()
    out = predict(predict(df, again, "raw", "one", engine="expression"), again, "raw", "two", engine="batch")
    out = predict(predict(predict(out, again, "leaf", "leaf"), again, "contrib", "shares"), again, "early_stop", "stopped").toPandas()
    want = duckdb.sql(f"SELECT row_id, {again.to_sql()[0]} AS raw FROM (SELECT row_id, CAST(a AS DOUBLE) AS a FROM out)").df().sort_values("row_id")["raw"].to_numpy()
    out = out.sort_values("row_id")
    for got in (out["one"], out["two"], out["stopped"], out["shares"].map(sum)):
        assert np.abs(got.to_numpy() - want).max() < 1e-12
    assert [len(set(map(tuple, out.loc[out["a"].isna() == gone, "leaf"]))) for gone in (True, False)] == [1, 1]
    assert np.abs(want - out["label"]).mean() < 2


def test_shapley_values_by_definition():
    tree = small_model().trees[0]
    rows = np.array([[5.0, 0.0, 1.0], [np.nan, 2.0, 3.0], [40.0, 1.0, 4.0]])

    def game(row, known):
        def go(at):
            if at < 0:
                return tree.leaves[~at].value
            n = tree.nodes[at]
            if n.feature in known:
                from thicket.plans.model import goes_left

                return go(n.left if goes_left(n, row[n.feature]) else n.right)
            count = lambda c: tree.nodes[c].count if c >= 0 else tree.leaves[~c].count
            return (count(n.left) * go(n.left) + count(n.right) * go(n.right)) / count(at)

        return go(0)

    got = tree_contributions(tree, 3, rows)
    for r, row in enumerate(rows):
        for f in range(3):
            rest, want = [g for g in range(3) if g != f], 0.0
            for k in range(3):
                for s in itertools.combinations(rest, k):
                    want += math.factorial(k) * math.factorial(2 - k) / 6 * (game(row, {*s, f}) - game(row, set(s)))
            assert got[r, f] == pytest.approx(want, abs=1e-12)
        assert got[r].sum() == pytest.approx(game(row, {0, 1, 2}), abs=1e-12)


def test_bins_by_hand():
    values, counts = [-2.0, -1.0, 0.0, 1.0, 2.0, 3.0], [5, 5, 9, 5, 1, 5]
    m = binning.numeric_mapper("x", values, counts, 4, min_data_in_bin=3)
    assert m.missing == "nan" and m.num_bin == len(m.upper) + 1 and m.counts[-1] == 4
    assert m.upper[0] == math.nextafter(-1.5, math.inf) and m.upper[1:3] == [-1e-35, 1e-35] and m.upper[-1] == math.inf
    assert [m.bin(v) for v in values] == [0, 1, 2, 3, 4, 4]
    assert m.bin(None) == m.num_bin - 1
    zero = binning.numeric_mapper("x", values, counts, 4, zero_as_missing=True)
    assert zero.missing == "zero" and zero.counts[zero.default_bin] == 13
    many = binning.even_bounds(np.arange(100.0), np.array([1] * 99 + [500]), 10, 3)
    # one heavy value; the other 99 share nine bins: eleven rows each
    assert many == [*(math.nextafter(11 * i - 0.5, math.inf) for i in range(1, 10)), math.inf]
    half = binning.even_bounds(np.arange(8.0), np.array([1, 1, 1, 50, 2, 2, 2, 2]), 4, 1)
    # the heavy value ends its bin, and the half full one before it ends too
    assert half == [math.nextafter(x, math.inf) for x in (2.5, 3.5, 5.5)] + [math.inf]
    forced = binning.bounds_around(np.arange(-4.0, 5.0), np.ones(9, int), 8, 1, [0.0, 2.0, -2.5])
    assert forced[-1] == math.inf and {-2.5, -1e-35, 1e-35, 2.0} <= set(forced) and len(forced) <= 8 and forced == sorted(forced)
    cat = binning.categorical_mapper("c", [-1.0, 0.0, 1.0, 2.0, 7.0], [3, 50, 200, 40, 1], 2)
    assert cat.categories == [1, 0, 2] and cat.counts[0] == 6
    assert BinMapper.from_json(m.to_json()) == m


def test_bins_in_spark_are_those_by_hand(spark):
    df = _data(spark)
    mappers = binning.fit(df, FEATURES, ["cat"], max_bin=100, min_data_in_bin=1)
    rows = binning.apply(df, mappers, FEATURES).collect()
    for r in rows[:200]:
        assert [r[f"b{i}"] for i in range(4)] == [m.bin(r[f]) for m, f in zip(mappers, FEATURES, strict=True)]


def test_wide_features_are_compressed_in_spark(spark):
    df = spark.range(3000).selectExpr("id AS row_id", "double(id) AS a", "CASE WHEN id < 2000 THEN id % 4 ELSE id END AS c")
    narrow, wide = (binning.fit(df, ["a", "c"], ["c"], max_bin=10, max_distinct=m) for m in (5000, 200))
    assert wide[1] == narrow[1] and wide[1].categories == [0, 1, 2, 3]
    assert len(wide[0].upper) == len(narrow[0].upper) and np.abs(np.array(wide[0].upper[:-1]) - narrow[0].upper[:-1]).max() <= 30


def test_bundles_keep_every_bin(spark):
    rows = [(1 if i % 3 == 0 else 0, 1 + i % 2 if i % 3 == 1 else 0, 1 if i % 3 == 2 else 0) for i in range(90)]
    df = spark.createDataFrame(rows, "b0 int, b1 int, b2 int")
    mappers = [BinMapper("x", [0.5, math.inf], sparse_rate=0.66), BinMapper("y", [0.5, 1.5, math.inf], sparse_rate=0.66), BinMapper("z", [0.5, math.inf], sparse_rate=0.66)]
    (bundle,) = bundling.find_bundles(df, mappers)
    out = df.withColumn("s", bundling.bundle_column(bundle, mappers))
    back = out.select(*(bundling.unbundle(F.col("s"), bundle, i, mappers).alias(f"u{i}") for i in range(3)), "b0", "b1", "b2")
    assert back.where("u0 <> b0 or u1 <> b1 or u2 <> b2").count() == 0


def test_bundled_training_is_plain_training(spark):
    """Twelve indicators of one code never meet: they are stored as one column, and the model is the same."""
    df = spark.range(1200).selectExpr("id AS row_id", "(id * 7919) % 12 AS c", "double(id % 9) AS x").selectExpr("*", *(f"double(c = {i}) AS i{i}" for i in range(12)), "double(c % 5) + x / 10 AS label").cache()
    data = TrainSet(df, [*(f"i{i}" for i in range(12)), "x"], row_id="row_id")
    plain, bundled = (train({**SMALL, "enable_bundle": b}, data) for b in (False, True))
    booster = Booster(data, Params.of({**SMALL, "enable_bundle": True}))
    assert [len(b.features) for b in booster.bundles] == [12] and [c for c in booster.state.columns if c[0] in "be"] == ["b12", "e0"]
    strip = lambda m: [[(n.feature, n.threshold, n.count, round(n.gain, 3)) for n in t.nodes] + [(x.count, round(x.value, 6)) for x in t.leaves] for t in m.trees]
    assert strip(plain) == strip(bundled)


def test_forced_bins(spark):
    df = _data(spark)
    booster = Booster(_set(df), Params.of({**SMALL, "max_bin": 8, "forcedbins_filename": '[{"feature": 0, "bin_upper_bound": [0.3, -0.7]}]'}))
    assert {0.3, -0.7} <= set(booster.mappers[0].upper)
    with pytest.raises(ValueError, match="forced bins"):
        Booster(_set(df), Params.of({**SMALL, "forcedbins_filename": '[{"feature": 9, "bin_upper_bound": [0.3]}]'}))


def test_estimators(spark, tmp_path):
    df = _data(spark).withColumn("kind", F.expr("CASE WHEN cat < 2 THEN 'low' WHEN cat < 4 THEN 'mid' ELSE 'top' END"))
    one = BoostedClassifier(features=FEATURES, labelCol="kind", rowIdCol="row_id", categorical=["cat"], options=SMALL)
    one.write().overwrite().save(f"file://{tmp_path}/estimator")
    again = BoostedClassifier.load(f"file://{tmp_path}/estimator")
    assert again.getOrDefault("features") == FEATURES and again.getOrDefault("options") == SMALL
    model = again.setOptions(num_iterations=3).fit(df)
    assert model.classes_ == ["low", "mid", "top"] and model.booster.iterations == 3 and model.n_features_ == 4
    model.write().overwrite().save(f"file://{tmp_path}/model")
    loaded = BoostedModel.load(f"file://{tmp_path}/model")
    out = loaded.transform(df)
    assert out.where("kind = prediction").count() > 590 and loaded.classes_ == model.classes_
    assert out.select("row_id", "probability", "rawPrediction", "prediction").exceptAll(model.transform(df).select("row_id", "probability", "rawPrediction", "prediction")).count() == 0
    assert loaded.predict_proba(df).where("abs(aggregate(probability, 0D, (a, v) -> a + v) - 1) > 1e-9").count() == 0
    regression = BoostedRegressor(features=FEATURES, rowIdCol="row_id", options=SMALL).fit(df)
    assert regression.transform(df).where("prediction <> rawPrediction").count() == 0
    with pytest.raises(ValueError, match="classifiers"):
        regression.predict_proba(df)
    assert BoostedRanker(features=FEATURES, labelCol="cat", queryCol="q", rowIdCol="row_id", options={**SMALL, "num_iterations": 1}).fit(df).booster.objective == "lambdarank"


def test_folds_models_and_fluent_training(spark):
    df, lines = _data(spark), []
    out = api.cv({**SMALL, "metric": "l2"}, _set(df), 2, 3, return_cvbooster=True, callbacks=[api.log_evaluation(2, lines.append)])
    assert len(out["valid l2-mean"]) == 2 and len(out["cvbooster"].boosters) == 3 and len(lines) == 3 and lines[0].startswith("round 2: valid l2 ")
    rows = out["cvbooster"].predict(df)
    assert rows.where("size(predictions) = 3").count() == 600 and rows.columns == [*df.columns, "predictions"]
    fluent = api.Training().num_leaves(8).min_data_in_leaf(10).eta(0.3).n_estimators(4).train(_set(df))
    assert fluent.to_text() == train(SMALL, _set(df)).to_text() and fluent.num_trees() == 4
    with pytest.raises(AttributeError):
        api.Training().nonsense(1)


def test_lambdas_of_both_ways_agree(spark):
    from thicket.functions import objectives

    df = spark.range(3000).selectExpr("id AS row_id", "CASE WHEN id % 50 = 0 THEN NULL WHEN id % 3 = 0 THEN 7 ELSE id % 40 END AS query_id", "double((id * 31) % 5) AS label", "double((id * 17) % 23) / 7 AS score").where("query_id is not null")
    for options in ({}, {"norm": False, "truncation": 3, "sigmoid": 2.0}):
        a, b = objectives.lambdarank(df, **options), objectives.lambdarank_by_joins(df, **options)
        both = a.alias("a").join(b.alias("b"), "row_id")
        assert both.count() == df.count() and both.where("abs(a.grad - b.grad) > 1e-9 or abs(a.hess - b.hess) > 1e-9").count() == 0


def test_sampling_follows_keys(spark):
    df = _data(spark).withColumn("in", F.lit(0))
    bag = lambda d, **k: {r["row_id"] for r in sampling.bagging(d, 0.5, **k).where("in_bag").collect()}
    assert bag(df) == bag(df.repartition(7)) != bag(df, iteration=1)
    assert 200 < len(bag(df)) < 400
    whole = sampling.bagging(df, 0.5, by_query="q").groupBy("q").agg(F.countDistinct("in_bag").alias("n"))
    assert whole.where("n > 1").count() == 0
    goss = sampling.goss(df.withColumns({"grad": F.col("label"), "hess": F.lit(1.0)}), 0.2, 0.1).where("in_bag")
    assert 120 <= goss.count() <= 260
    g = sampling.Lcg(1)
    assert len({g.next_int(0, 10**6) for _ in range(50)}) == 50 and sampling.Lcg(1).sample(10, 10) == list(range(10))
    assert sampling.dart_factors(1, 0.1) == (0.05, 0.5)


def test_parameters():
    p = Params.of({"n_estimators": 7, "eta": 0.2, "shrinkage_rate": 0.3, "reg_lambda": 1, "objective": "mse", "seed": 1})
    assert (p.num_iterations, p.learning_rate, p.lambda_l2, p.objective) == (7, 0.2, 1.0, "regression")
    assert Params.of({"seed": 1}).bagging_seed == p.bagging_seed != 3 and Params.of({"seed": 1, "bagging_seed": 9}).bagging_seed == 9
    assert Params.of({"max_depth": 3}).num_leaves == 8
    assert parse_groups("[0,1], [2]") == [[0, 1], [2]]
    for bad in ({"nonsense": 1}, {"num_leaves": 1}, {"objective": "multiclass"}, {"boosting": "rf"}, {"is_unbalance": True, "scale_pos_weight": 2.0, "objective": "binary"}, {"metric": "multi_error"}, {"monotone_constraints_method": "advanced"}, {"learning_rate": 0}, {"interaction_constraints": "[0,1"}):
        with pytest.raises(ValueError):
            Params.of(bad)


def test_sources(spark, tmp_path):
    dense = matrix.from_dense(spark, [[1, None], [0, 2.5]], label=[1, 0])
    assert dense.num_data() == 2 and dense.num_feature() == 2
    csr = matrix.from_csr(spark, [0, 1, 1, 3], [1, 0, 1], [5.0, 1.0, 2.0], 2).orderBy("row_id").collect()
    assert [tuple(r)[1:] for r in csr] == [(0.0, 5.0), (0.0, 0.0), (1.0, 2.0)]
    csc = matrix.from_csc(spark, [0, 2, 2, 3], [0, 2, 1], [1.0, 3.0, 2.0], 3).orderBy("row_id").collect()
    assert [tuple(r)[1:] for r in csc] == [(1.0, 0.0, 0.0), (0.0, 0.0, 2.0), (3.0, 0.0, 0.0)]
    for bad in ([1, 2], [0, 2, 1], [0, 9]):
        with pytest.raises(ValueError):
            matrix.check_indptr(bad, 3)
    model = small_model()
    matrix.save_model(model, str(tmp_path / "m.txt"))
    matrix.save_model(model, f"file://{tmp_path}/m", spark)
    assert matrix.load_model(str(tmp_path / "m.txt")).to_text() == matrix.load_model(f"file://{tmp_path}/m", spark).to_text() == model.to_text()
    with pytest.raises(ValueError, match="features"):
        predict(spark.range(3), model)
    tree = Tree([Node(0, 1.0, 0, -1, -2)], [Leaf(1.0), Leaf(2.0)])
    assert tree.depth() == 1 and tree.walk([0.5]) == 0 and tree.output([2.0]) == 2.0


def test_streams_are_scored(spark, tmp_path):
    from thicket.streaming.score import score_stream

    df = spark.range(50).selectExpr("id AS row_id", "cast(id AS double) AS f0", "cast(id % 5 AS double) AS f1", "cast(id % 6 AS double) AS f2")
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    run = score_stream(stream, small_model()).writeStream.format("memory").queryName("scored").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    run.awaitTermination(60)
    want = {r["row_id"]: r["prediction"] for r in predict(df, small_model()).collect()}
    assert {r["row_id"]: r["prediction"] for r in spark.table("scored").collect()} == want
