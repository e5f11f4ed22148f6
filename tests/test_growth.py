"""Trees that grow together, on executors, on sparse rows and on data sets that are binned once; long models; what is left behind."""

import glob
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from thicket.operators import binning, counting
from thicket.plans.api import ByArrays, Dataset, TrainSet, cv, predict, train
from thicket.plans.boosting import Booster
from thicket.plans.model import Leaf, Model, Node, Tree
from thicket.plans.params import Params
from thicket.sources.matrix import from_table, sparse_rows

BASE = {"num_leaves": 8, "num_iterations": 3, "min_data_in_leaf": 10, "min_data_in_bin": 1, "learning_rate": 0.3, "verbosity": -1}
NAMES = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(4)
    out = []
    for i in range(900):
        a, b, c = r.random() * 10, None if r.random() < 0.1 else float(r.randrange(30)), float(r.randrange(6))
        out.append((i, a, b, c, 1.0, a * 2 + (b or 3) + 4 * (c == 2) + r.random(), int(a * 7 + (b or 0)) % 3, float(a + r.random() > 5)))
    return spark.createDataFrame(out, "id long, a double, b double, c double, d double, y double, k int, t double").cache()


def _set(df, label="y", **more):
    return TrainSet(df, NAMES, label, row_id="id", **more)


def _parts(model):
    return [([(n.feature, round(n.threshold, 9), n.left, n.right, n.default_left, n.cats, round(n.gain, 5), n.count) for n in t.nodes], [(round(x.value, 8), x.count) for x in t.leaves]) for t in model.trees]


def _left(spark):
    base = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    return {os.path.basename(p) for p in glob.glob(f"{base}/*")}


@pytest.mark.parametrize("more", [{}, {"objective": "multiclass", "num_class": 3}, {"extra_trees": True}, {"interaction_constraints": "[0,1],[2]"}, {"monotone_constraints": [1, 0, 0, 0]}, {"forcedsplits_filename": '{"feature": 1, "threshold": 9.0}'}, {"enable_bundle": True}])
def test_search_on_executors_grows_the_same_trees(spark, rows, monkeypatch, more):
    data = _set(rows, "k" if "num_class" in more else "y", categorical=["c"])
    near = train({**BASE, **more}, data)
    monkeypatch.setattr(counting, "DRIVER_SUMS", 0)
    monkeypatch.setattr(counting, "BLOCK", 2)
    assert _parts(train({**BASE, **more}, data)) == _parts(near)
    assert any(t.nodes for t in near.trees)


def test_classes_take_the_jobs_of_one(spark, rows):
    jobs = []
    for k in (3, 6):
        booster = Booster(_set(rows.withColumn("k", F.col("id") % k), "k"), Params.of({**BASE, "objective": "multiclass", "num_class": k, "num_iterations": 1, "num_leaves": 4, "max_depth": 2}))
        tracker = spark.sparkContext.statusTracker()
        spark.sparkContext.setJobGroup(f"k{k}", "")
        booster.round(0)
        jobs.append(len(tracker.getJobIdsForGroup(f"k{k}")))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1] <= 4


def test_features_that_cannot_split_are_left_out(spark, rows):
    wide = rows.withColumn("d", F.when(F.col("id") < 8, 1.0).otherwise(0.0))  # no split leaves ten rows on both sides
    searched = []
    real = counting.histograms
    try:
        counting.histograms = lambda df, table, slots, *rest: searched.append([s.skip for s in slots]) or real(df, table, slots, *rest)
        model = train({**BASE, "num_iterations": 1}, _set(wide))
    finally:
        counting.histograms = real
    assert searched[0] == [frozenset()] and len(searched) > 2 and all(3 in s[0] for s in searched[1:])
    assert _parts(model) == _parts(train({**BASE, "num_iterations": 1, "feature_contri": [1.0, 1.0, 1.0, 0.0]}, _set(wide)))


def test_rounds_go_on_after_one_that_cannot_split(spark, rows):
    draws = {"feature_fraction": 0.3, "feature_fraction_seed": 4}  # b, c, a, d
    model = train({**BASE, **draws, "num_iterations": 4, "cegb_penalty_feature_coupled": [0.0, 1e9, 1e9, 1e9]}, _set(rows))
    assert [bool(t.nodes) for t in model.trees] == [False, False, True, False]
    assert all(sum(x.count for x in t.leaves) == 900 for t in model.trees)


def test_a_root_of_too_little_hessian_holds_nothing(spark, rows):
    model = train(BASE, _set(rows), fobj=lambda s, y: (s - y, F.lit(1e-9)))
    assert [[(x.value, x.count) for x in t.leaves] for t in model.trees] == [[(0.0, 900)]] * 3


# --- sparse -------------------------------------------------------------------------------------------------------------------


def test_sparse_training_equals_dense(spark):
    """Fifty columns among a hundred thousand."""
    r, width = random.Random(1), 100_000
    place = sorted(r.sample(range(width), 50))
    dense, sparse = [], []
    for i in range(600):
        own = {j: float(r.choice([1, 1, 2, -3])) if r.random() < 0.95 else None for j in range(50) if r.random() < 0.2}
        y = sum((v or 0) * ((j * 7) % 5 - 2) for j, v in own.items()) + r.random()
        dense.append((i, y, *(own.get(j, 0.0) for j in range(50))))
        mine = sorted(own)
        sparse.append((i, y, [place[j] for j in mine], [own[j] if own[j] is not None else float("nan") for j in mine]))
    names = [f"f{j}" for j in range(50)]
    a = TrainSet(spark.createDataFrame(dense, "id long, y double, " + ", ".join(f"{n} double" for n in names)), names, "y", row_id="id")
    df = spark.createDataFrame(sparse, "id long, y double, i array<int>, v array<double>")
    b = TrainSet(df, [f"x{j}" for j in range(width)], "y", row_id="id", sparse=("i", "v"))
    one, two = train(BASE, a, valid_sets=[a]), train(BASE, b, valid_sets=[b])
    named = [([(place[f], *n) for f, *n in nodes], leaves) for nodes, leaves in _parts(one)]
    assert _parts(two) == named and any(t.nodes for t in one.trees)
    dense_scores = {x["id"]: x["p"] for x in predict(a.df, one, name="p").collect()}
    found = predict(df, two, name="p", sparse=("i", "v")).select("id", "p").collect()
    assert len(found) == 600 and all(x["p"] == pytest.approx(dense_scores[x["id"]]) for x in found)
    leaves = {x["id"]: list(x["p"]) for x in predict(a.df, one, "leaf", "p").collect()}
    assert all(list(x["p"]) == leaves[x["id"]] for x in predict(df, two, "leaf", "p", sparse=("i", "v")).collect())
    more = train(BASE, b, 1, init_model=two)
    assert _parts(more)[:3] == _parts(two) and len(more.trees) == 4


def test_sparse_rows_of_pointers(spark):
    pointers = spark.createDataFrame(list(enumerate([0, 2, 2, 3])), "i long, ptr long")
    entries = spark.createDataFrame([(0, 4, 1.5), (1, 0, 2.0), (2, 9, 0.0)], "k long, index long, val double")
    assert [(r["row_id"], r["indices"], r["values"]) for r in sparse_rows(pointers, entries).orderBy("row_id").collect()] == [(0, [0, 4], [2.0, 1.5]), (1, [], []), (2, [], [])]
    assert [(r["row_id"], r["indices"]) for r in sparse_rows(pointers, entries, True, 5).orderBy("row_id").collect()] == [(0, [0]), (1, []), (2, []), (3, []), (4, [0])]


# --- data sets ----------------------------------------------------------------------------------------------------------------


def test_a_data_set_is_binned_once(spark, rows, tmp_path, monkeypatch):
    data, path = _set(rows, categorical=["c"]), f"file://{tmp_path}/set"
    want = _parts(train(BASE, data))
    own = Dataset.build(data, BASE, path)
    monkeypatch.setattr(binning, "fit_counts", lambda *a: pytest.fail("counted again"))
    assert _parts(train(BASE, own)) == want
    assert _parts(train(BASE, Dataset.load(spark, path))) == want
    valid = train({**BASE, "metric": "l2"}, own, valid_sets=[data])
    assert _parts(valid) == want
    with pytest.raises(ValueError, match="max_bin"):
        train({**BASE, "max_bin": 7}, own)
    monkeypatch.undo()
    assert Dataset.build(data, BASE, path).fingerprint == own.fingerprint
    with pytest.raises(ValueError, match="another"):
        Dataset.build(_set(rows), BASE, path)
    with pytest.raises(FileNotFoundError):
        Dataset.load(spark, f"{path}-none")


def test_codes_stay_with_the_set(spark, tmp_path):
    r = random.Random(2)
    rows = [(i, s := r.choice(["ash", "elm", "oak", "yew"]), {"ash": 1.0, "elm": 5.0, "oak": 2.0, "yew": 9.0}[s] + r.random()) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, tree string, y double")
    data = from_table(df, "y", ["tree"], row_id="id")
    own = Dataset.build(data, {**BASE, "min_data_per_group": 1, "cat_smooth": 1}, f"file://{tmp_path}/coded")
    model = train({**BASE, "min_data_per_group": 1, "cat_smooth": 1}, own, 20)
    # another table has other strings, so its own codes would differ
    fresh = spark.createDataFrame([(1, "yew"), (2, "zebra"), (3, "oak"), (4, None)], "id long, tree string")
    for coder in (own, data, Dataset.load(spark, f"file://{tmp_path}/coded")):
        found = {x["id"]: x["p"] for x in predict(coder.encode(fresh), model, name="p").collect()}
        assert found[1] == pytest.approx(9.5, abs=0.4) and found[3] == pytest.approx(2.5, abs=0.4)
        assert len(found) == 4


# --- long models, start scores, leftovers ---------------------------------------------------------------------------------------


def test_a_thousand_trees_continue_and_validate(spark, rows):
    long = Model(NAMES, "regression", 1, [Tree([Node(0, float(i % 10), 0, -1, -2)], [Leaf(0.01), Leaf(0.02)]) for i in range(1000)])
    part = _set(rows.where("id < 300"))
    kept = {}
    from thicket.plans.api import record_evaluation

    out = train({**BASE, "metric": "l2"}, part, 2, valid_sets=[part], init_model=long, callbacks=[record_evaluation(kept)])
    assert len(out.trees) == 1002
    scored = predict(part.df, out, "raw", "s", engine="batch").agg(F.avg(F.pow(F.col("s") - F.col("y"), 2))).first()[0]
    assert kept["valid_0"]["l2"][-1] == pytest.approx(scored)


def test_dropped_trees_leave_validation_scores_right(spark, rows):
    from thicket.plans.api import record_evaluation

    kept, part = {}, _set(rows.where("id < 300"))
    model = train({**BASE, "boosting": "dart", "drop_rate": 0.6, "skip_drop": 0.0, "metric": "l2", "num_leaves": 3}, part, 25, valid_sets=[part], callbacks=[record_evaluation(kept)])
    scored = predict(part.df, model, "raw", "s", engine="batch").agg(F.avg(F.pow(F.col("s") - F.col("y"), 2))).first()[0]
    assert kept["valid_0"]["l2"][-1] == pytest.approx(scored)


@pytest.mark.parametrize("classes", [1, 3])
def test_validation_begins_with_its_start_scores(spark, rows, classes):
    from thicket.plans.api import record_evaluation

    start = F.lit(100.0) if classes == 1 else F.array(*(F.lit(float(i)) for i in range(3)))
    data = _set(rows.withColumn("s0", start), "y" if classes == 1 else "k", init_score="s0")
    kept = {}
    more = {"metric": "l2"} if classes == 1 else {"objective": "multiclass", "num_class": 3, "metric": "multi_logloss"}
    train({**BASE, **more, "is_provide_training_metric": True}, data, 2, valid_sets=[data], callbacks=[record_evaluation(kept)])
    name = more["metric"]
    assert kept["valid_0"][name] == pytest.approx(kept["training"][name])
    assert classes == 3 or kept["valid_0"][name][0] > 1000


def test_trainings_leave_nothing(spark, rows):
    before = _left(spark)
    train({**BASE, "objective": "regression_l1", "metric": "l1,l2"}, _set(rows), valid_sets=[_set(rows)])
    train({**BASE, "objective": "binary", "metric": "auc,average_precision,binary_logloss"}, _set(rows, "t"), 11, valid_sets=[_set(rows, "t")])
    assert _left(spark) == before


def test_metrics_of_a_set_are_one_aggregation(spark, rows):
    data = _set(rows, "t")
    booster = Booster(data, Params.of({**BASE, "objective": "binary", "metric": "binary_logloss,binary_error,l2,l1,rmse,cross_entropy"}), {"v": data})
    booster.round(0)
    spark.sparkContext.setJobGroup("metrics", "")
    found = booster.evaluate(0)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("metrics"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(found) == 6 and jobs <= 2


# --- binning ------------------------------------------------------------------------------------------------------------------


def test_bins_do_not_hang_on_the_number_of_features(spark, rows, monkeypatch):
    whole = binning.fit(rows, NAMES, key="id")
    monkeypatch.setattr(binning, "MAX_VALUES", 500)
    assert binning.fit(rows, NAMES, key="id") == whole


def test_runs_keep_counts_exact(spark):
    df = spark.range(5000).select((F.col("id") * F.col("id") / 7.0).alias("x"), "id").repartition(5)
    (m,) = binning.fit(df, ["x"], max_bin=20, max_distinct=300, key="id")
    values = np.array([i * i / 7.0 for i in range(5000)])
    held = np.bincount([m.bin(v) for v in values], minlength=m.num_bin)
    assert held.tolist() == m.counts and m.low == 0.0 and m.high == values[-1] and m.num_bin > 15


def test_samples_are_exact_and_small(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k").repartition(40)
    got = binning.row_sample(df, 500, "k", 1)
    assert got.count() == 500
    assert {r["k"] for r in got.collect()} == {r["k"] for r in df.orderBy(F.xxhash64("k", F.lit(1)).bitwiseAND(F.lit((1 << 52) - 1)), "k").limit(500).collect()}
    assert binning.row_sample(df, 20_000, "k").count() == 20_000


def test_frequent_codes_are_ranked_in_ranges(spark):
    counts = spark.createDataFrame([(f, float(v), 100 - v if v >= 0 else 500) for f in (0, 1) for v in range(-1, 50)], "feature int, value double, n long")
    top = {(r["feature"], r["value"]): r["n"] for r in binning.top_codes(counts, 3).collect()}
    assert top == {(f, v): n for f in (0, 1) for v, n in ((0.0, 100), (1.0, 99), (2.0, 98), (-1.0, 500 + sum(100 - v for v in range(3, 50))))}


# --- functions of arrays ----------------------------------------------------------------------------------------------------------


def _naive():  # made here, as workers can't import this module
    def lambdarank(labels, scores, weights, group):
        """One query's lambdas, pair by pair."""
        order = np.lexsort((np.arange(len(labels)), -scores))
        y, s, n = labels[order], scores[order], len(labels)
        assert group.tolist() == [n]
        gain, discount = 2.0**y - 1, 1 / np.log2(2.0 + np.arange(n))
        best = (np.sort(gain)[::-1][:30] * discount[:30]).sum()
        g, h, total = np.zeros(n), np.zeros(n), 0.0
        for i in range(min(30, n)):
            for j in range(i + 1, n):
                if best <= 0 or y[i] == y[j]:
                    continue
                up, low = (i, j) if y[i] > y[j] else (j, i)
                gap = abs(gain[i] - gain[j]) * abs(discount[i] - discount[j]) / best
                if s[0] != s[-1]:
                    gap /= 0.01 + abs(s[up] - s[low])
                p = 1 / (1 + np.exp(s[up] - s[low]))
                g[up] -= gap * p
                g[low] += gap * p
                h[up] += gap * p * (1 - p)
                h[low] += gap * p * (1 - p)
                total += 2 * gap * p
        if total > 0:
            g, h = (x * np.log2(1 + total) / total for x in (g, h))
        out = np.zeros(n), np.zeros(n)
        out[0][order], out[1][order] = g * weights[order], h * weights[order]
        return out

    return lambdarank


def test_a_function_of_whole_queries_is_the_objective(spark, rows):
    df = rows.select("*", (F.col("id") % 45).alias("q"), (F.col("id") * 7 % 4).cast("double").alias("rel"), (1.0 + F.col("id") % 3).alias("w"))
    data = TrainSet(df, NAMES, "rel", weight="w", query="q", row_id="id")
    want = train({**BASE, "objective": "lambdarank", "metric": "ndcg", "eval_at": [3]}, data)
    found = train({**BASE, "metric": "none"}, data, fobj=ByArrays(_naive()))
    assert [[(n.feature, n.count) for n in t.nodes] for t in found.trees] == [[(n.feature, n.count) for n in t.nodes] for t in want.trees]
    assert [x.value for t in found.trees for x in t.leaves] == pytest.approx([x.value for t in want.trees for x in t.leaves], abs=1e-9)
    seen = {}
    from thicket.plans.api import record_evaluation

    def top_label(labels, scores, weights, group):
        return "top", labels[np.argmax(scores)], True

    train({**BASE, "objective": "lambdarank", "metric": "none"}, data, 1, valid_sets=[data], feval=ByArrays(top_label), callbacks=[record_evaluation(seen)])
    assert 0 < seen["valid_0"]["top"][0] <= 3
    with pytest.raises(ValueError, match="query"):
        train(BASE, _set(rows), 1, fobj=ByArrays(_naive()))
    with pytest.raises(ValueError, match="argument"):
        ByArrays(lambda labels: labels)


@pytest.mark.parametrize("classes", [1, 3])
def test_functions_of_rows_are_the_objective(spark, rows, classes):
    label = "y" if classes == 1 else "k"
    data = TrainSet(rows.withColumn("w", 1.0 + F.col("id") % 3), NAMES, label, weight="w", row_id="id")
    more = {"boost_from_average": False} | ({} if classes == 1 else {"objective": "multiclass", "num_class": 3})
    want = _parts(train({**BASE, **more}, data))

    def square(labels, scores):
        return scores - labels, np.ones(len(labels))

    def softmax(labels, scores, weights):
        e = np.exp(scores - scores.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        return (p - np.eye(3)[labels.astype(int)]) * weights[:, None], 1.5 * p * (1 - p) * weights[:, None]

    assert _parts(train({**BASE, **more}, data, fobj=ByArrays(square if classes == 1 else softmax))) == want


# --- bundles ----------------------------------------------------------------------------------------------------------------------


def test_thousands_of_sparse_features_bundle(spark):
    """A feature a row holds at most three of, dealt into few bundles by bitmaps of a sample."""
    from thicket.operators import bundling
    from thicket.operators.binning import BinMapper

    width, r = 400, random.Random(5)
    rows = []
    for _ in range(3000):
        own = {r.randrange(width // 4) + g * (width // 4) for g in range(3)}
        rows.append(tuple(int(j in own) for j in range(width)))
    df = spark.createDataFrame(rows, ", ".join(f"b{j} int" for j in range(width))).repartition(4)
    mappers = [BinMapper(f"b{j}", [0.5, float("inf")], sparse_rate=0.99, most_frequent=0) for j in range(width)]
    bits = bundling.presence(df, mappers, list(range(width)))
    assert np.bitwise_count(bits).sum(1).tolist() == [sum(x[j] for x in rows) for j in range(width)]
    groups = bundling.find_bundles(df, mappers, rate=0.0)
    assert sorted(i for g in groups for i in g.features) == list(range(width)) and len(groups) < 40
    held = np.array(rows)
    assert all(held[:, g.features].sum(1).max() <= 1 for g in groups)
    few = bundling.find_bundles(df, mappers, sample=500)
    assert sorted(i for g in few for i in g.features) == list(range(width))


# --- folds ------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("more", [{"objective": "binary", "metric": "auc,binary_logloss"}, {"objective": "multiclass", "num_class": 3, "metric": "multi_logloss"}, {"metric": "l2", "feature_fraction": 0.6}])
def test_folds_together_are_folds_one_by_one(spark, rows, monkeypatch, more):
    from thicket.plans import folds

    label = {"binary": "t", "multiclass": "k"}.get(more.get("objective"), "y")
    # features of few values, so that binning a fold alone gives the same bins
    data = _set(rows.withColumn("a", F.floor("a").cast("double")), label)
    args = ({**BASE, "min_data_in_leaf": 5, **more}, data, 3, 3)
    one = cv(*args, eval_train_metric=True, return_cvbooster=True)
    before = _left(spark)
    monkeypatch.setattr(folds, "together", lambda p: False)
    two = cv(*args, eval_train_metric=True, return_cvbooster=True)
    assert _left(spark) == before
    models = [[[[n.feature for n in t.nodes] for t in m.trees] for m in x.pop("cvbooster").boosters] for x in (one, two)]
    assert models[0] == models[1] and one.keys() == two.keys()
    assert all(one[k] == pytest.approx(two[k]) for k in one)
