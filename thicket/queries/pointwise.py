"""Queries of objectives and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions import metrics, objectives
from thicket.plans.closures import ByArrays
from thicket.queries.oracle import draw
from thicket.queries.base import QUERIES, SQL, WITH, WITH_SCORES, query, r6, shared, with_scores

# --- gradients: (operator, label column, gradient, hessian) in SQL ----------------------------------------------------------

_SIGN = "CASE WHEN s - {y} > 0 THEN 1e0 WHEN s - {y} < 0 THEN -1e0 ELSE 0e0 END"
GRADIENTS = {
    "ob01_regression": ("regression", "y", "s - y", "1e0"),
    "ob03_regression_l1": ("regression_l1", "y", _SIGN.format(y="y"), "1e0"),
    "ob04_huber": ("huber", "y", f"CASE WHEN abs(s - y) <= 9e-1 THEN s - y ELSE 9e-1 * ({_SIGN.format(y='y')}) END", "1e0"),
    "ob05_fair": ("fair", "y", "(s - y) / (abs(s - y) + 1e0)", "1e0 / ((abs(s - y) + 1e0) * (abs(s - y) + 1e0))"),
    "ob06_quantile": ("quantile", "y", "CASE WHEN s - y >= 0 THEN 1e0 - 9e-1 ELSE -9e-1 END", "1e0"),
    "ob07_mape": ("mape", "y", f"({_SIGN.format(y='y')}) / greatest(1e0, abs(y))", "1e0"),
    "ob08_poisson": ("poisson", "y", "exp(s) - y", "exp(s + 7e-1)"),
    "ob09_gamma": ("gamma", "y", "1e0 - y * exp(-s)", "y * exp(-s)"),
    "ob10_tweedie": ("tweedie", "y", "-y * exp(-5e-1 * s) + exp(5e-1 * s)", "y * 5e-1 * exp(-5e-1 * s) + 5e-1 * exp(5e-1 * s)"),
    "ob12_binary": ("binary", "yb", "1e0 / (1e0 + exp(-s)) - yb", "(1e0 / (1e0 + exp(-s))) * (1e0 - 1e0 / (1e0 + exp(-s)))"),
    "ob17_cross_entropy": ("cross_entropy", "p", "1e0 / (1e0 + exp(-s)) - p", "exp(-s) / ((1e0 + exp(-s)) * (1e0 + exp(-s)))"),
    "ob18_cross_entropy_lambda": ("cross_entropy_lambda", "p", "1e0 / (1e0 + exp(-s)) - p", "(1e0 / (1e0 + exp(-s))) * (1e0 - 1e0 / (1e0 + exp(-s)))"),
}


def _gradient(objective: str, label: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        g, h = objectives.find(objective).gradients(F.col("s"), F.col(label))
        return shared(spark, sf_dir).select("row_id", r6(g, "grad"), r6(h, "hess"))

    return run


for _name, (_objective, _label, _g, _h) in GRADIENTS.items():
    QUERIES[_name] = _gradient(_objective, _label)
    SQL[_name] = f"{WITH} SELECT row_id, round({_g}, 6) AS grad, round({_h}, 6) AS hess FROM t"


@query("ob02_sqrt_label", f"{WITH} SELECT row_id, round(sign(s) * sqrt(abs(s)), 6) AS root, round(s, 6) AS back FROM t")
def sqrt_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = objectives.sqrt_label(F.col("s"))
    return shared(spark, sf_dir).select("row_id", r6(root, "root"), r6(objectives.transform("regression", root, squared=True), "back"))


@query(
    "ob11_label_statistics",
    f"{WITH} SELECT count(*) AS n, count(*) FILTER (y < 0) AS below_zero, count(*) FILTER (p < 0 OR p > 1) AS outside, count(*) FILTER (yc <> floor(yc)) AS broken FROM t",
)
def label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir)
    for objective, label, k in (("poisson", "y", 1), ("cross_entropy", "p", 1), ("multiclass", "yc", 3), ("lambdarank", "rel", 1)):
        objectives.check_labels(df, objective, label, k)
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y") < 0).alias("below_zero"), F.count_if((F.col("p") < 0) | (F.col("p") > 1)).alias("outside"), F.count_if(F.col("yc") != F.floor("yc")).alias("broken"))


@query("ob13_class_weights", f"{WITH}, c AS (SELECT sum(yb) AS p, sum(1 - yb) AS n FROM t) SELECT round(CASE WHEN p > n THEN 1e0 ELSE n / p END, 6) AS pos, round(CASE WHEN p > n THEN p / n ELSE 1e0 END, 6) AS neg, CAST(p AS BIGINT) AS positives, CAST(n AS BIGINT) AS negatives FROM c")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos, neg, p, n = objectives.class_weights(shared(spark, sf_dir), "yb", True)
    return spark.createDataFrame([(round(pos, 6), round(neg, 6), p, n)], "pos double, neg double, positives long, negatives long")


@query("ob14_classes_present", f"{WITH} SELECT CAST(yc AS INTEGER) AS class, count(*) AS n FROM t GROUP BY 1")
def classes_present(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir).groupBy(F.col("yc").cast("int").alias("class")).agg(F.count(F.lit(1)).alias("n"))


_EXPS = "exp(s{k} - greatest(s0, s1, s2))"
_SOFT = f"({_EXPS} / ({' + '.join(_EXPS.format(k=i) for i in range(3))}))"


@query(
    "ob15_multiclass",
    WITH_SCORES + " SELECT row_id, " + ", ".join(f"round({_SOFT.format(k=k)} - CASE WHEN yc = {k} THEN 1 ELSE 0 END, 6) AS g{k}, round(15e-1 * {_SOFT.format(k=k)} * (1 - {_SOFT.format(k=k)}), 6) AS h{k}" for k in range(3)) + " FROM t",
)
def multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, h = objectives.softmax(F.col("scores"), F.col("yc"), 3)
    rows = with_scores(spark, sf_dir).select("row_id", g.alias("g"), h.alias("h"))
    return rows.select("row_id", *(r6(F.col(c)[k], f"{c}{k}") for k in range(3) for c in "gh"))


@query("ob16_multiclassova", WITH_SCORES + " SELECT row_id, " + ", ".join(f"round(1e0 / (1e0 + exp(-s{k})) - CASE WHEN yc = {k} THEN 1 ELSE 0 END, 6) AS g{k}, round((1e0 / (1e0 + exp(-s{k}))) * (1e0 - 1e0 / (1e0 + exp(-s{k}))), 6) AS h{k}" for k in range(3)) + " FROM t")
def ova(spark: SparkSession, sf_dir: str) -> DataFrame:
    g, h = objectives.one_vs_all(F.col("scores"), F.col("yc"), 3)
    rows = with_scores(spark, sf_dir).select("row_id", g.alias("g"), h.alias("h"))
    return rows.select("row_id", *(r6(F.col(c)[k], f"{c}{k}") for k in range(3) for c in "gh"))


_LAMBDA = f"""{WITH}, q AS (SELECT row_id, query_id, rel, rs, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, row_id) AS r,
        row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, row_id) AS b, max(rs) OVER (PARTITION BY query_id) AS hi, min(rs) OVER (PARTITION BY query_id) AS lo FROM t),
    d AS (SELECT query_id, sum((pow(2, rel) - 1) / log2(1 + b)) AS best FROM q WHERE b <= 30 GROUP BY query_id),
    pairs AS (SELECT i.query_id, i.row_id AS a, j.row_id AS b, i.rel > j.rel AS up, CASE WHEN i.rel > j.rel THEN i.rs - j.rs ELSE j.rs - i.rs END AS delta,
        abs(pow(2, i.rel) - pow(2, j.rel)) * abs(1 / log2(1 + i.r) - 1 / log2(1 + j.r)) / d.best / CASE WHEN i.hi <> i.lo THEN 1e-2 + abs(i.rs - j.rs) ELSE 1 END AS gap
        FROM q i JOIN q j ON i.query_id = j.query_id AND i.r < j.r AND i.r <= 30 AND i.rel <> j.rel JOIN d ON d.query_id = i.query_id WHERE d.best > 0),
    lam AS (SELECT *, gap / (1 + exp(delta)) AS l, gap / (1 + exp(delta)) * (1 - 1 / (1 + exp(delta))) AS h FROM pairs),
    ends AS (SELECT query_id, a AS row_id, CASE WHEN up THEN -l ELSE l END AS g, h, l FROM lam UNION ALL SELECT query_id, b, CASE WHEN up THEN l ELSE -l END, h, l FROM lam),
    total AS (SELECT query_id, sum(l) AS total FROM ends GROUP BY query_id),
    sums AS (SELECT query_id, row_id, sum(g) AS g, sum(h) AS h FROM ends GROUP BY query_id, row_id)
    SELECT t.row_id, round(coalesce(sums.g * CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END, 0), 6) AS grad, round(coalesce(sums.h * CASE WHEN total > 0 THEN log2(1 + total) / total ELSE 1 END, 0), 6) AS hess
    FROM t LEFT JOIN sums ON t.row_id = sums.row_id LEFT JOIN total ON t.query_id = total.query_id"""


@query("ob19_lambdarank", _LAMBDA)
def lambdarank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = objectives.lambdarank(shared(spark, sf_dir), label="rel", score="rs")
    return out.select("row_id", r6("grad", "grad"), r6("hess", "hess"))


_XENDCG = f"""{WITH}, e AS (SELECT *, exp(rs - max(rs) OVER q) AS x, power(2e0, rel) - {draw('row_id', '5', '0')} AS phi, count(*) OVER q AS n FROM t WINDOW q AS (PARTITION BY query_id)),
    r AS (SELECT *, x / sum(x) OVER q AS rho, phi / greatest(sum(phi) OVER q, 1e-15) AS target FROM e WINDOW q AS (PARTITION BY query_id)),
    a AS (SELECT *, rho - target AS one, (rho - target) / greatest(1 - rho, 1e-15) AS lift FROM r),
    b AS (SELECT *, rho * (sum(lift) OVER q - lift) AS two FROM a WINDOW q AS (PARTITION BY query_id)),
    c AS (SELECT *, two / greatest(1 - rho, 1e-15) AS lift2 FROM b),
    z AS (SELECT *, rho * (sum(lift2) OVER q - lift2) AS three FROM c WINDOW q AS (PARTITION BY query_id))
    SELECT row_id, round(CASE WHEN n > 1 THEN one + two + three ELSE 0 END, 6) AS grad, round(CASE WHEN n > 1 THEN rho * (1 - rho) ELSE 0 END, 6) AS hess FROM z"""


@query("ob20_rank_xendcg", _XENDCG)
def rank_xendcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objectives.rank_xendcg(shared(spark, sf_dir), label="rel", score="rs").select("row_id", r6("grad", "grad"), r6("hess", "hess"))


@query("ob21_query_sizes", f"{WITH} SELECT query_id, count(*) AS n, CAST(max(rel) AS INTEGER) AS top FROM t GROUP BY query_id")
def query_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir)
    objectives.check_labels(df, "lambdarank", "rel")
    return df.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.max("rel").cast("int").alias("top"))


@query("ob22_custom_objective", f"{WITH} SELECT row_id, round(2 * (s - y), 6) AS grad, 2e0 AS hess FROM t")
def custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = lambda s, y: (2.0 * (s - y), F.lit(2.0))
    g, h = own(F.col("s"), F.col("y"))
    return shared(spark, sf_dir).select("row_id", r6(g, "grad"), h.alias("hess"))


@query("ob23_percentile", f"{WITH} SELECT leaf, round(quantile_cont(y - s, 0.9), 6) AS value FROM t GROUP BY leaf")
def percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objectives.percentile(shared(spark, sf_dir).withColumn("r", F.col("y") - F.col("s")), "r", 0.9, ["leaf"]).select("leaf", r6("value", "value"))


@query(
    "ob24_weighted_percentile",
    f"""{WITH}, v AS (SELECT y, sum(w) AS w FROM t GROUP BY y), u AS (SELECT y, sum(w) OVER (ORDER BY y) AS upto, sum(w) OVER () AS total, lag(y) OVER (ORDER BY y) AS last, w FROM v)
    SELECT round(CASE WHEN last IS NULL OR w < 1 THEN y ELSE last + (5e-1 * total - (upto - w)) / w * (y - last) END, 6) AS value FROM u WHERE upto > 5e-1 * total AND upto - w <= 5e-1 * total""",
)
def weighted_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objectives.weighted_percentile(shared(spark, sf_dir), "y", "w", 0.5).select(r6("value", "value"))


@query("ob25_leaf_renewal", f"{WITH} SELECT b1 AS leaf, round(median(y - s), 6) AS value FROM t GROUP BY b1")
def leaf_renewal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return objectives.percentile(shared(spark, sf_dir).withColumn("r", F.col("y") - F.col("s")), "r", 0.5, ["b1"]).select(F.col("b1").alias("leaf"), r6("value", "value"))


@query("ob26_transforms", f"{WITH} SELECT row_id, round(1 / (1 + exp(-s)), 6) AS sigmoid, round(exp(s), 6) AS exponent, round(ln(1 + exp(s)), 6) AS soft_plus FROM t")
def transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s")
    return shared(spark, sf_dir).select("row_id", r6(objectives.transform("binary", s), "sigmoid"), r6(objectives.transform("poisson", s), "exponent"), r6(objectives.transform("cross_entropy_lambda", s), "soft_plus"))


@query(
    "ob27_init_scores",
    f"""{WITH}, a AS (SELECT avg(y) AS m, median(y) AS d, quantile_cont(y, 0.9) AS q, avg(yb) AS b, avg(p) AS p FROM t)
    SELECT 'regression' AS objective, round(m, 6) AS value FROM a UNION ALL SELECT 'regression_l1', round(d, 6) FROM a UNION ALL SELECT 'quantile', round(q, 6) FROM a UNION ALL SELECT 'poisson', round(ln(m), 6) FROM a
    UNION ALL SELECT 'binary', round(ln(b / (1 - b)), 6) FROM a UNION ALL SELECT 'cross_entropy', round(ln(p / (1 - p)), 6) FROM a UNION ALL SELECT 'cross_entropy_lambda', round(ln(exp(p) - 1), 6) FROM a""",
)
def init_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir)
    of = {"regression": "y", "regression_l1": "y", "quantile": "y", "poisson": "y", "binary": "yb", "cross_entropy": "p", "cross_entropy_lambda": "p"}
    return spark.createDataFrame([(o, round(objectives.init_scores(df, o, c)[0], 6)) for o, c in of.items()], "objective string, value double")


# --- metrics -----------------------------------------------------------------------------------------------------------------

_P = "(1 / (1 + exp(-s)))"
LOSS_SQL = {
    "me01_l2": ("l2", "s", "y", "avg((s - y) * (s - y))"),
    "me01_rmse": ("rmse", "s", "y", "sqrt(avg((s - y) * (s - y)))"),
    "me02_l1": ("l1", "s", "y", "avg(abs(s - y))"),
    "me03_quantile": ("quantile", "s", "y", "avg(CASE WHEN y < s THEN (9e-1 - 1) * (y - s) ELSE 9e-1 * (y - s) END)"),
    "me04_huber": ("huber", "s", "y", "avg(CASE WHEN abs(s - y) <= 9e-1 THEN 5e-1 * (s - y) * (s - y) ELSE 9e-1 * (abs(s - y) - 45e-2) END)"),
    "me05_fair": ("fair", "s", "y", "avg(abs(s - y) - ln(1 + abs(s - y)))"),
    "me06_poisson": ("poisson", "e", "y", "avg(exp(s) - y * s)"),
    "me07_mape": ("mape", "s", "y", "avg(abs(y - s) / greatest(1e0, abs(y)))"),
    "me08_gamma": ("gamma", "e", "y", "avg(y / exp(s) + s)"),
    "me09_gamma_deviance": ("gamma_deviance", "e", "y", "2 * sum((y + 1e-9) / (exp(s) + 1e-9) - ln((y + 1e-9) / (exp(s) + 1e-9)) - 1) / count(*)"),
    "me10_tweedie": ("tweedie", "e", "y", "avg(y * exp(-5e-1 * s) / 5e-1 + exp(5e-1 * s) / 5e-1)"),
    "me11_binary_logloss": ("binary_logloss", "q", "yb", f"avg(-CASE WHEN yb > 0 THEN ln({_P}) ELSE ln(1 - {_P}) END)"),
    "me12_binary_error": ("binary_error", "q", "yb", f"avg(CASE WHEN ({_P} <= 5e-1) = (yb > 0) THEN 1e0 ELSE 0e0 END)"),
    "me18_cross_entropy": ("cross_entropy", "q", "p", f"avg(-(p * ln({_P}) + (1 - p) * ln(1 - {_P})))"),
    "me19_cross_entropy_lambda": ("cross_entropy_lambda", "s", "p", "avg(-(p * ln(1 - exp(-ln(1 + exp(s)))) + (1 - p) * ln(exp(-ln(1 + exp(s))))))"),
    "me20_kullback_leibler": ("kullback_leibler", "q", "p", f"avg(-(p * ln({_P}) + (1 - p) * ln(1 - {_P})) + p * ln(p) + (1 - p) * ln(1 - p))"),
}


def _loss(metric: str, score: str, label: str):  # noqa: ANN202
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = shared(spark, sf_dir).withColumns({"e": F.exp("s"), "q": 1.0 / (1.0 + F.exp(-F.col("s")))})
        if metric == "gamma_deviance":
            # a sum, not a mean, and labels of exactly zero have none: shifted, and by row, so that the size stays small
            df = df.withColumn("y", F.col("y") + 1e-9)
            out = metrics.pointwise(df, metric, score, label)
            return out.join(df.agg(F.count(F.lit(1)).alias("n")).withColumn("metric", F.lit(metric)), "metric").select("metric", r6(F.col("value") / F.col("n"), "value"))
        return metrics.pointwise(df, metric, score, label).select("metric", r6("value", "value"))

    return run


for _name, (_metric, _score, _label, _sql) in LOSS_SQL.items():
    QUERIES[_name] = _loss(_metric, _score, _label)
    SQL[_name] = f"{WITH} SELECT '{_metric}' AS metric, round({_sql}, 6) AS value FROM t"

_RUN = f"{WITH}, v AS (SELECT s, sum(yb) AS p, sum(1 - yb) AS n FROM t GROUP BY s), u AS (SELECT *, coalesce(sum(p) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bp, coalesce(sum(n) OVER (ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bn FROM v)"


@query("me13_auc", f"{_RUN} SELECT 'auc' AS metric, round(sum(n * (bp + 5e-1 * p)) / (sum(p) * sum(n)), 6) AS value FROM u")
def auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc(shared(spark, sf_dir), "s", "yb").select("metric", r6("value", "value"))


@query("me14_average_precision", f"{_RUN} SELECT 'average_precision' AS metric, round(sum(p * (bp + p) / (bp + p + bn + n)) / sum(p), 6) AS value FROM u")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(shared(spark, sf_dir), "s", "yb").select("metric", r6("value", "value"))


@query("me15_multi_logloss", WITH_SCORES + f" SELECT 'multi_logloss' AS metric, round(avg(-ln(CASE yc WHEN 0 THEN {_SOFT.format(k=0)} WHEN 1 THEN {_SOFT.format(k=1)} ELSE {_SOFT.format(k=2)} END)), 6) AS value FROM t")
def multi_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = with_scores(spark, sf_dir).withColumn("q", objectives.transform("multiclass", F.col("scores")))
    return metrics.pointwise(df, "multi_logloss", "q", "yc").select("metric", r6("value", "value"))


@query("me16_multi_error", WITH_SCORES + ", o AS (SELECT *, CASE yc WHEN 0 THEN s0 WHEN 1 THEN s1 ELSE s2 END AS own FROM t) SELECT 'multi_error' AS metric, round(avg(CASE WHEN (CASE WHEN s0 >= own THEN 1 ELSE 0 END) + (CASE WHEN s1 >= own THEN 1 ELSE 0 END) + (CASE WHEN s2 >= own THEN 1 ELSE 0 END) > 2 THEN 1e0 ELSE 0e0 END), 6) AS value FROM o")
def multi_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pointwise(with_scores(spark, sf_dir), "multi_error", "scores", "yc", multi_error_top_k=2).select("metric", r6("value", "value"))


def _pair_sql(i: int, j: int) -> str:
    return f"SELECT '{i}-{j}' AS pair, round(2 * (s{i} - s{j}), 12) AS d, CASE WHEN yc = {i} THEN 1e0 ELSE 0e0 END AS p, CASE WHEN yc = {j} THEN 1e0 ELSE 0e0 END AS n FROM t WHERE yc IN ({i}, {j})"


@query(
    "me17_auc_mu",
    WITH_SCORES + f", e AS ({' UNION ALL '.join(_pair_sql(i, j) for i, j in ((0, 1), (0, 2), (1, 2)))}), v AS (SELECT pair, d, sum(p) AS p, sum(n) AS n FROM e GROUP BY pair, d), u AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY pair ORDER BY d DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM v), w AS (SELECT pair, sum(n * (b + 5e-1 * p)) / (sum(p) * sum(n)) AS x FROM u GROUP BY pair) SELECT 'auc_mu' AS metric, round(sum(x) / 3, 6) AS value FROM w",
)
def auc_mu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auc_mu(with_scores(spark, sf_dir), 3, "scores", "yc").select("metric", r6("value", "value"))


_RANKED = f"{WITH}, q AS (SELECT query_id, rel, row_number() OVER (PARTITION BY query_id ORDER BY rs DESC, row_id) AS r, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, row_id) AS b FROM t)"
_KS = "(SELECT unnest([1, 3, 5]) AS k)"


@query(
    "me21_ndcg",
    f"{_RANKED}, v AS (SELECT k, query_id, sum(CASE WHEN r <= k THEN (pow(2, rel) - 1) / log2(1 + r) ELSE 0 END) AS d, sum(CASE WHEN b <= k THEN (pow(2, rel) - 1) / log2(1 + b) ELSE 0 END) AS m FROM q, {_KS} GROUP BY k, query_id) SELECT k, round(avg(CASE WHEN m > 0 THEN d / m ELSE 1 END), 6) AS value FROM v GROUP BY k",
)
def ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ndcg(shared(spark, sf_dir), (1, 3, 5), label="rel", score="rs").select("k", r6("value", "value"))


@query(
    "me22_map",
    f"{_RANKED}, h AS (SELECT *, CASE WHEN rel > 5e-1 THEN 1e0 ELSE 0e0 END AS hit FROM q), c AS (SELECT *, sum(hit) OVER (PARTITION BY query_id ORDER BY r) AS hits FROM h), v AS (SELECT k, query_id, sum(hit) AS n, sum(CASE WHEN r <= k THEN hit * hits / r ELSE 0 END) AS x FROM c, {_KS} GROUP BY k, query_id) SELECT k, round(avg(CASE WHEN n > 0 THEN x / least(n, k) ELSE 1 END), 6) AS value FROM v GROUP BY k",
)
def mean_average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.mean_average_precision(shared(spark, sf_dir), (1, 3, 5), label="rel", score="rs").select("k", r6("value", "value"))


@query("me23_metric_names", f"{WITH}, m AS (SELECT avg((s - y) * (s - y)) AS l2, avg(abs(s - y)) AS l1 FROM t) SELECT 'l2' AS metric, round(l2, 6) AS value, FALSE AS higher_is_better FROM m UNION ALL SELECT 'l1', round(l1, 6), FALSE FROM m UNION ALL SELECT 'rmse', round(sqrt(l2), 6), FALSE FROM m")
def metric_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of a list of aliases: repeats and unknown names are dropped, the order stays."""
    names = metrics.parse("mse, mae,unheard_of,mean_squared_error,l2_root,regression_l1", "regression")
    flat = shared(spark, sf_dir).select(F.col("s").alias("raw"), F.col("s").alias("score"), F.col("y").alias("label"))
    return spark.createDataFrame([(n, round(v, 6), h) for n, v, h in metrics.evaluate_all(flat, names)], "metric string, value double, higher_is_better boolean")


@query("me24_custom_metric", f"{WITH}, q AS (SELECT query_id, sum(w * (s - y)) / sum(w) AS gap FROM t GROUP BY query_id) SELECT 'mean_gap' AS metric, round(avg(gap), 6) AS value FROM q")
def custom_metric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric of the caller's, a function of each query's arrays."""
    own = ByArrays(lambda labels, scores, weights, group: ("mean_gap", (weights * (scores - labels)).sum() / weights.sum(), False))
    flat = shared(spark, sf_dir).select(F.col("s").alias("score"), F.col("y").alias("label"), F.col("w").alias("weight"), "query_id")
    return spark.createDataFrame([(n, round(v, 6)) for n, v, _ in own.metric(flat)], "metric string, value double")


@query("me25_weighted_l2", f"{WITH} SELECT 'l2' AS metric, round(sum(w * (s - y) * (s - y)) / sum(w), 6) AS value FROM t")
def weighted_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pointwise(shared(spark, sf_dir), "l2", "s", "y", "w").select("metric", r6("value", "value"))
