"""Queries of binning, histograms, split search, sampling, prediction and sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from thicket.functions.ordered import running
from thicket.operators import binning, bundling, histogram, sampling, split
from thicket.operators.binning import BinMapper
from thicket.operators.split import Feature, SplitParams
from thicket.plans.model import Leaf, Model, Node, Tree, tree_sql
from thicket.plans.predict import predict
from thicket.queries.base import SQL, WITH, query, r6, shared
from thicket.queries.oracle import draw
from thicket.sources import matrix

# --- sources ---------------------------------------------------------------------------------------------------------------


@query("io01_dense", f"{WITH} SELECT row_id, f1 AS \"Column_0\", f2 AS \"Column_1\", y AS label FROM t")
def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared(spark, sf_dir).select("row_id", F.array("f1", "f2").alias("row"), F.col("y").alias("label"))
    return matrix.from_row_arrays(rows, "row", 2).df.select("row_id", "Column_0", "Column_1", "label")


@query("io02_sparse_rows", f"{WITH} SELECT row_id, CASE WHEN b1 = 0 THEN f1 ELSE 0e0 END AS \"Column_0\", CASE WHEN b1 = 1 THEN f1 ELSE 0e0 END AS \"Column_1\", CASE WHEN b1 = 2 THEN f1 ELSE 0e0 END AS \"Column_2\" FROM t WHERE b1 < 3")
def sparse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = shared(spark, sf_dir).where("b1 < 3").select(F.col("row_id").alias("row"), F.col("b1").alias("col"), F.col("f1").alias("val"))
    return matrix.from_entries(entries, 3)


_CSC = f"""{WITH}, o AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, b1, f1 FROM t)
    SELECT row_id, {', '.join(f'CASE WHEN b1 = {i} THEN f1 ELSE 0e0 END AS "Column_{i}"' for i in range(8))} FROM o"""


@query("io03_sparse_columns", _CSC)
def sparse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a CSC matrix in tables: column b1 holds f1."""
    rows = running(shared(spark, sf_dir).select("row_id", "b1", "f1").withColumn("one", F.lit(1)), "row_id", ["one"]).withColumnRenamed("before_one", "row").cache()
    entries = running(rows.select(F.struct("b1", "row").alias("place"), "f1", F.lit(1).alias("one")), "place", ["one"])
    entries = entries.select(F.col("before_one").alias("k"), F.col("place.row").alias("index"), F.col("f1").alias("val"))
    sizes = spark.range(9).select(F.col("id").cast("int").alias("i")).join(rows.groupBy("b1").agg(F.count(F.lit(1)).alias("n")), F.col("i") == F.col("b1"), "left")
    pointers = running(sizes.select("i", F.coalesce("n", F.lit(0)).alias("n")), "i", ["n"]).select("i", F.col("before_n").alias("ptr"))
    return matrix.csc_rows(pointers, entries, rows.count())


@query("io04_pointer_faults", f"{WITH}, p AS (SELECT row_id AS i, row_id - CASE WHEN row_id % 1000 = 7 THEN 5 ELSE 0 END AS ptr FROM t), q AS (SELECT *, lag(ptr) OVER (ORDER BY i) AS before FROM p) SELECT i, ptr, before FROM q WHERE ptr < before")
def pointer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shared(spark, sf_dir).select(F.col("row_id").alias("i"), (F.col("row_id") - F.when(F.col("row_id") % 1000 == 7, 5).otherwise(0)).alias("ptr"))
    return matrix.indptr_faults(rows)


@query("io05_metadata", f"{WITH} SELECT count(*) AS \"rows\", count(*) FILTER (f0 IS NULL) AS no_label, count(*) FILTER (w < 0) AS bad_weight, count(*) FILTER (query_id IS NULL) AS no_query FROM t")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matrix.check_metadata(shared(spark, sf_dir), "f0", "w", "query_id")
    return spark.createDataFrame([tuple(found[k] for k in ("rows", "no_label", "bad_weight", "no_query"))], "rows long, no_label long, bad_weight long, no_query long")


@query("io06_query_weights", f"{WITH} SELECT query_id, round(avg(w), 6) AS weight FROM t GROUP BY query_id")
def query_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix.query_weights(shared(spark, sf_dir), "query_id", "w").select("query_id", r6("weight", "weight"))


@query("io07_melt", f"{WITH} SELECT row_id, 0 AS feature, f1 AS value FROM t UNION ALL SELECT row_id, 1, f2 FROM t")
def melt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.melt(shared(spark, sf_dir), ["f1", "f2"], ["row_id"])


@query("io11_string_codes", "SELECT o_orderpriority, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS code FROM orders GROUP BY o_orderpriority")
def string_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.codes(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderpriority").select("o_orderpriority", F.col("code").cast("long").alias("code"))


# --- binning ---------------------------------------------------------------------------------------------------------------


@query("bn02_distinct_counts", f"{WITH} SELECT feature, value, count(*) AS n FROM (SELECT 0 AS feature, f0 AS value FROM t UNION ALL SELECT 1, f1 FROM t UNION ALL SELECT 2, f2 FROM t) GROUP BY feature, value")
def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binning.distinct_counts(shared(spark, sf_dir), ["f0", "f1", "f2"])


@query(
    "bn03_few_values",
    f"""{WITH}, v AS (SELECT f1 AS v, count(*) AS n FROM t GROUP BY f1), s AS (SELECT 1 AS side, v, n FROM v WHERE v < 0 UNION ALL SELECT 2, v, n FROM v WHERE v > 0), m AS (SELECT (v + lead(v) OVER (PARTITION BY side ORDER BY v)) / 2 AS upper FROM s)
    SELECT round(upper, 6) AS upper FROM m WHERE upper IS NOT NULL UNION ALL SELECT round(-1e-35, 6) + 0 UNION ALL SELECT round(1e-35, 6)""",
)
def few_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    mapper = binning.fit(shared(spark, sf_dir), ["f1"], min_data_in_bin=1)[0]
    # finite bounds: those between neighbours, and zero's own two
    return spark.createDataFrame([(round(u, 6) + 0.0,) for u in mapper.upper[:-1]], "upper double")


@query("bn03_many_values")
def many_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappers = binning.fit(shared(spark, sf_dir), ["y"], max_bin=63)
    return binning.bound_table(shared(spark, sf_dir), mappers)


@query("bn05_forced_bounds")
def forced_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappers = binning.fit(shared(spark, sf_dir), ["y"], max_bin=16, forced={"y": [1.0, 2.5]})
    return binning.bound_table(shared(spark, sf_dir), mappers)


@query("bn07_missing", f"{WITH} SELECT CAST(count(*) FILTER (f0 IS NULL) AS BIGINT) AS missing, CASE WHEN count(*) FILTER (f0 IS NULL) > 0 THEN 'nan' ELSE 'none' END AS kind FROM t")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = binning.fit(shared(spark, sf_dir), ["f0"])[0]
    return spark.createDataFrame([(m.counts[-1], m.missing)], "missing long, kind string")


@query("bn09_most_frequent", f"{WITH}, v AS (SELECT f2, count(*) AS n FROM t GROUP BY f2) SELECT CAST(n AS BIGINT) AS n, CAST(dense_rank() OVER (ORDER BY f2) - 1 AS INTEGER) AS bin FROM v")
def most_frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = binning.fit(shared(spark, sf_dir), ["f2"], min_data_in_bin=1)[0]
    return spark.createDataFrame([(n, i) for i, n in enumerate(m.counts) if n], "n long, bin int")


@query(
    "bn10_categories",
    f"""{WITH}, v AS (SELECT CAST(f1 AS INTEGER) AS category, count(*) AS n FROM t WHERE f1 >= 0 GROUP BY 1), o AS (SELECT category, n, row_number() OVER (ORDER BY n DESC, category) AS bin, sum(n) OVER (ORDER BY n DESC, category) - n AS before, sum(n) OVER () AS total FROM v)
    SELECT CAST(bin AS INTEGER) AS bin, category FROM o WHERE before < floor(total * 99e-2 + 5e-1)""",
)
def categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = binning.fit(shared(spark, sf_dir), ["f1"], ["f1"])[0]
    return spark.createDataFrame([(i + 1, c) for i, c in enumerate(m.categories)], "bin int, category int")


_BOUNDS = [3.0, 9.0, 15.0, 24.0, 33.0, 40.0]
_MAPPER = BinMapper("f0", [*_BOUNDS, float("inf")], missing="nan")


@query("bn11_value_to_bin", f"{WITH} SELECT row_id, CASE WHEN f0 IS NULL THEN 7 " + " ".join(f"WHEN f0 <= {b}e0 THEN {i}" for i, b in enumerate(int(x) for x in _BOUNDS)) + " ELSE 6 END AS bin FROM t")
def value_to_bin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir).select("row_id", binning.bin_column(_MAPPER, "f0").alias("bin"))


_BINNED = f"""{WITH}, v0 AS (SELECT f0, dense_rank() OVER (ORDER BY f0) - 1 + CASE WHEN (SELECT min(f0) FROM t) > 0 THEN 1 ELSE 0 END AS bin FROM t WHERE f0 IS NOT NULL GROUP BY f0),
    v1 AS (SELECT f1, dense_rank() OVER (ORDER BY f1) - 1 AS bin FROM t GROUP BY f1),
    c2 AS (SELECT f2, n, row_number() OVER (ORDER BY n DESC, f2) AS bin, sum(n) OVER (ORDER BY n DESC, f2) - n AS before, sum(n) OVER () AS total FROM (SELECT f2, count(*) AS n FROM t GROUP BY f2)),
    v2 AS (SELECT f2, CASE WHEN before < floor(total * 99e-2 + 5e-1) THEN bin ELSE 0 END AS bin FROM c2)
    SELECT row_id, CAST(coalesce(v0.bin, (SELECT max(bin) + 1 FROM v0)) AS INTEGER) AS b0, CAST(v1.bin AS INTEGER) AS b1, CAST(v2.bin AS INTEGER) AS b2
    FROM t LEFT JOIN v0 ON t.f0 = v0.f0 JOIN v1 ON t.f1 = v1.f1 JOIN v2 ON t.f2 = v2.f2"""


@query("bn12_binned_table", _BINNED)
def binned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of few values, one bin each (y with its many is binned along, and checked by hand in the tests)."""
    df = shared(spark, sf_dir)
    return binning.apply(df, binning.fit(df, ["f0", "f1", "f2", "y"], ["f2"], min_data_in_bin=1), ["row_id"]).drop("b3")


@query("bn15_bundle_conflicts")
def bundle_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bundling.conflicts(_one_hot(spark, sf_dir), [BinMapper(f"b{i}", [0.5, float("inf")], sparse_rate=0.8, most_frequent=0) for i in range(3)])


SQL["bn15_bundle_conflicts"] = f"{WITH}, o AS (SELECT CASE WHEN f2 = 1 THEN 1 ELSE 0 END AS b0, CASE WHEN f2 = 2 THEN 1 ELSE 0 END AS b1, CASE WHEN f2 = 4 AND b1 < 7 THEN 1 ELSE 0 END AS b2 FROM t) SELECT a, b, n FROM (SELECT 0 AS a, 0 AS b, CAST(sum(b0) AS BIGINT) AS n FROM o UNION ALL SELECT 1, 1, CAST(sum(b1) AS BIGINT) FROM o UNION ALL SELECT 2, 2, CAST(sum(b2) AS BIGINT) FROM o) WHERE n > 0"


def _one_hot(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir)
    return df.select("row_id", F.when(F.col("f2") == 1, 1).otherwise(0).alias("b0"), F.when(F.col("f2") == 2, 1).otherwise(0).alias("b1"), F.when((F.col("f2") == 4) & (F.col("b1") < 7), 1).otherwise(0).alias("b2"))


@query("bn16_bundle_column", f"{WITH} SELECT row_id, CASE WHEN f2 = 4 AND b1 < 7 THEN 3 WHEN f2 = 2 THEN 2 WHEN f2 = 1 THEN 1 ELSE 0 END AS bundle FROM t")
def bundle_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    mappers = [BinMapper(f"b{i}", [0.5, float("inf")], sparse_rate=0.8, most_frequent=0) for i in range(3)]
    return _one_hot(spark, sf_dir).select("row_id", bundling.bundle_column(bundling.Bundle([0, 1, 2], [1, 2, 3], 4), mappers).alias("bundle"))


@query("bn18_feature_infos", f"{WITH} SELECT min(f0) AS low0, max(f0) AS high0, min(f1) AS low1, max(f1) AS high1 FROM t")
def feature_infos(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = binning.fit(shared(spark, sf_dir), ["f0", "f1"])
    return spark.createDataFrame([(a.low, a.high, b.low, b.high)], "low0 double, high0 double, low1 double, high1 double")


@query("bn19_identity", f"{WITH} SELECT min(f1) >= 0 AS f1, min(f2) >= 0 AND bool_and(f2 = floor(f2)) AS f2 FROM t")
def identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir)
    return spark.createDataFrame([(binning.is_identity(df, ["f1"]), binning.is_identity(df, ["f2"]))], "f1 boolean, f2 boolean")


# --- histograms ------------------------------------------------------------------------------------------------------------

_MELT = ", m AS (SELECT leaf, 0 AS feature, b0 AS bin, g, h FROM t UNION ALL SELECT leaf, 1, b1, g, h FROM t UNION ALL SELECT leaf, 2, b2, g, h FROM t)"
_HIST = f"{WITH}{_MELT}, hist AS (SELECT leaf, feature, bin, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h, count(*) AS n FROM m GROUP BY leaf, feature, bin)"
_BINS = ["b0", "b1", "b2"]


def hist_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.by_columns(shared(spark, sf_dir), _BINS, "leaf", "g", "h")


@query("tr01_histogram", f"{_HIST} SELECT * FROM hist")
def tr_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hist_of(spark, sf_dir)


@query("tr02_batch_histogram", f"{_HIST} SELECT leaf, feature, bin, CAST(g AS DOUBLE) AS g, CAST(h AS DOUBLE) AS h, n FROM hist")
def batch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.by_batches(shared(spark, sf_dir), _BINS, "leaf", "g", "h").withColumn("n", F.col("n").cast("long"))


@query("tr03_subtraction", f"{_HIST} SELECT leaf, feature, bin, g, h, n FROM hist WHERE leaf = 1")
def subtraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir)
    parent = histogram.by_columns(df.withColumn("leaf", F.lit(9)), _BINS, "leaf", "g", "h")
    child = histogram.by_columns(df.where("leaf = 0"), _BINS, "leaf", "g", "h")
    return histogram.subtract(parent, child, 1)


@query("tr05_most_frequent_restored", f"{_HIST} SELECT leaf, feature, bin, g, h, n FROM hist")
def restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    hist = hist_of(spark, sf_dir)
    common = spark.createDataFrame([(0, 3), (1, 0), (2, 4)], "feature int, most_frequent int")
    return histogram.restore_most_frequent(hist, histogram.leaf_totals(shared(spark, sf_dir), "leaf", "g", "h"), common)


@query("tr06_leaf_totals", f"{WITH} SELECT leaf, CAST(sum(g) AS BIGINT) AS g, CAST(sum(h) AS BIGINT) AS h, count(*) AS n FROM t GROUP BY leaf")
def leaf_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.leaf_totals(shared(spark, sf_dir), "leaf", "g", "h")


@query("tr32_quantised_histogram", f"{WITH}, q AS (SELECT leaf, b1, y - s AS g FROM t), m AS (SELECT max(abs(g)) / 2 AS step FROM q) SELECT leaf, b1 AS bin, CAST(sum(floor(abs(g / step) + 5e-1) * CASE WHEN g < 0 THEN -1 ELSE 1 END) AS BIGINT) AS g, CAST(count(*) AS BIGINT) AS h FROM q, m GROUP BY leaf, b1")
def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir).withColumns({"grad": F.col("y") - F.col("s"), "hess": F.lit(1.0)})
    rows, _, _ = histogram.quantise(df, 4, True)
    hist = histogram.by_columns(rows, ["b1"], "leaf", "qg", "qh")
    return hist.select("leaf", "bin", "g", "h")


# --- split search ------------------------------------------------------------------------------------------------------------

_NUMERIC = [Feature(0, 11, "nan"), Feature(1, 8), Feature(2, 7)]
_P = SplitParams(lambda_l2=1.0, min_data_in_leaf=5)
_SCAN = f"""{_HIST}, x AS (SELECT *, feature = 0 AND bin = 10 AS gone, sum(g) OVER f AS sg, sum(h) OVER f AS sh, sum(n) OVER f AS sn FROM hist WINDOW f AS (PARTITION BY leaf, feature)),
    u AS (SELECT *, sum(CASE WHEN gone THEN 0 ELSE g END) OVER o AS ug, sum(CASE WHEN gone THEN 0 ELSE h END) OVER o AS uh, sum(CASE WHEN gone THEN 0 ELSE n END) OVER o AS un,
        sum(CASE WHEN gone THEN 0 ELSE g END) OVER f AS tg, sum(CASE WHEN gone THEN 0 ELSE h END) OVER f AS th, sum(CASE WHEN gone THEN 0 ELSE n END) OVER f AS tn FROM x WINDOW f AS (PARTITION BY leaf, feature), o AS (PARTITION BY leaf, feature ORDER BY bin)),
    c AS (SELECT leaf, feature, 0 AS dir, bin - 1 AS threshold, sg - (tg - ug + g) AS lg, sh - (th - uh + h) AS lh, sn - (tn - un + n) AS ln, sg, sh, sn FROM u WHERE NOT gone AND bin >= 1
        UNION ALL SELECT leaf, feature, 1, bin, ug, uh, un, sg, sh, sn FROM u WHERE NOT gone AND feature = 0),
    s AS (SELECT leaf, feature, dir, threshold, ln, sn - ln AS rn, (lg * lg) / (lh + L2) + ((sg - lg) * (sg - lg)) / (sh - lh + L2) - (sg * sg) / (sh + L2) AS gain FROM c WHERE ln >= LEAST AND sn - ln >= LEAST AND lh >= 1e-3 AND sh - lh >= 1e-3)"""


def _scan(l2: str, least: int) -> str:
    return _SCAN.replace("L2", l2).replace("LEAST", str(least))


def _number(x: str) -> Column:
    return F.round(x, 4).alias("gain")


@query("tr07_leaf_gain", f"{WITH}, v AS (SELECT leaf, CAST(sum(g) AS DOUBLE) AS g, CAST(sum(h) AS DOUBLE) AS h FROM t GROUP BY leaf) SELECT leaf, round(power(greatest(abs(g) - 2, 0), 2) / (h + 1), 6) AS gain, round(-sign(g) * greatest(abs(g) - 2, 0) / (h + 1), 6) AS output FROM v")
def leaf_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SplitParams(lambda_l1=2.0, lambda_l2=1.0)
    v = histogram.leaf_totals(shared(spark, sf_dir), "leaf", "g", "h").withColumns({"g": F.col("g").cast("double"), "h": F.col("h").cast("double")})
    return v.select("leaf", r6(split.leaf_gain(F.col("g"), F.col("h"), p), "gain"), r6(split.leaf_output(F.col("g"), F.col("h"), p), "output"))


@query("tr08_smoothed_output", f"{WITH}, v AS (SELECT b1 AS leaf, CAST(sum(g) AS DOUBLE) AS g, CAST(sum(h) AS DOUBLE) AS h, count(*) AS n FROM t GROUP BY b1) SELECT leaf, round(greatest(least(-g / (h + 1), 5e-1), -5e-1) * (n / 1e1) / (n / 1e1 + 1) + 25e-2 / (n / 1e1 + 1), 6) AS output FROM v")
def smoothed(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SplitParams(lambda_l2=1.0, max_delta_step=0.5, path_smooth=10.0)
    v = histogram.leaf_totals(shared(spark, sf_dir), "b1", "g", "h")
    return v.select("leaf", r6(split.leaf_output(F.col("g").cast("double"), F.col("h").cast("double"), p, F.col("n"), F.lit(0.25)), "output"))


@query("tr09_best_split", f"{_scan('1e0', 5)} SELECT leaf, feature, dir, CAST(threshold AS INTEGER) AS threshold, round(gain, 4) AS gain FROM (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY round(gain, 7) DESC, feature, dir, CASE WHEN dir = 0 THEN -threshold ELSE threshold END) AS r FROM s WHERE gain > 0) WHERE r = 1")
def best_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split.scored(split.numeric_candidates(hist_of(spark, sf_dir), _NUMERIC, _P), _P)
    return split.best(found.withColumn("gain", F.round("gain", 7)), ["leaf"]).select("leaf", "feature", "dir", F.col("threshold").cast("int").alias("threshold"), _number("gain"))


@query("tr10_estimated_counts", f"{_HIST}, x AS (SELECT *, sum(h) OVER (PARTITION BY leaf, feature) AS sh, sum(n) OVER (PARTITION BY leaf, feature) AS sn FROM hist) SELECT leaf, feature, bin, CAST(floor(h * sn / CAST(sh AS DOUBLE) + 5e-1) AS BIGINT) AS n FROM x")
def estimated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split._prepared(hist_of(spark, sf_dir), _NUMERIC, SplitParams(count_mode="hessian")).select("leaf", "feature", "bin", "n")


@query("tr11_constrained_candidates", f"{_scan('0e0', 700)} SELECT leaf, feature, dir, CAST(threshold AS INTEGER) AS threshold, round(gain, 4) AS gain FROM s WHERE gain > 0")
def constrained(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SplitParams(min_data_in_leaf=700)
    found = split.scored(split.numeric_candidates(hist_of(spark, sf_dir), _NUMERIC, p), p)
    return found.select("leaf", "feature", "dir", F.col("threshold").cast("int").alias("threshold"), _number("gain"))


@query("tr12_missing_arms", f"{_scan('1e0', 5)} SELECT leaf, dir, CAST(threshold AS INTEGER) AS threshold, CAST(ln AS BIGINT) AS ln, CAST(rn AS BIGINT) AS rn FROM s WHERE feature = 0 AND gain > 0")
def missing_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split.scored(split.numeric_candidates(hist_of(spark, sf_dir), _NUMERIC, _P), _P)
    return found.where("feature = 0").select("leaf", "dir", F.col("threshold").cast("int").alias("threshold"), F.col("ln").cast("long").alias("ln"), F.col("rn").cast("long").alias("rn"))


@query("tr15_one_category", f"{_HIST}, x AS (SELECT *, sum(g) OVER (PARTITION BY leaf) AS sg, sum(h) OVER (PARTITION BY leaf) AS sh FROM hist WHERE feature = 2) SELECT leaf, bin, round((g * g) / (h + 1e0) + ((sg - g) * (sg - g)) / (sh - h + 1e0) - (sg * sg) / (sh + 1e0), 4) AS gain FROM x WHERE bin > 0 AND (g * g) / (h + 1e0) + ((sg - g) * (sg - g)) / (sh - h + 1e0) - (sg * sg) / (sh + 1e0) > 0")
def one_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SplitParams(lambda_l2=1.0, min_data_in_leaf=1, max_cat_to_onehot=10)
    found = split.scored(split.categorical_candidates(hist_of(spark, sf_dir).where("feature = 2"), [Feature(2, 7, categorical=True)], p), p)
    return found.select("leaf", F.col("threshold").cast("int").alias("bin"), _number("gain"))


@query(
    "tr16_many_categories",
    f"""{_HIST}, x AS (SELECT *, g / (h + 1e1) AS ctr, sum(g) OVER (PARTITION BY leaf) AS sg, sum(h) OVER (PARTITION BY leaf) AS sh FROM hist WHERE feature = 1),
    o AS (SELECT *, row_number() OVER (PARTITION BY leaf ORDER BY ctr, bin) AS u, row_number() OVER (PARTITION BY leaf ORDER BY ctr DESC, bin DESC) AS d, count(*) OVER (PARTITION BY leaf) AS used FROM x WHERE bin > 0 AND n >= 10),
    e AS (SELECT leaf, 0 AS dir, u AS i, g, h, sg, sh, used FROM o UNION ALL SELECT leaf, 1, d, g, h, sg, sh, used FROM o),
    c AS (SELECT leaf, dir, i, used, sg, sh, sum(g) OVER (PARTITION BY leaf, dir ORDER BY i) AS lg, sum(h) OVER (PARTITION BY leaf, dir ORDER BY i) AS lh FROM e),
    z AS (SELECT leaf, dir, CAST(i - 1 AS INTEGER) AS place, (lg * lg) / (lh + 11e0) + ((sg - lg) * (sg - lg)) / (sh - lh + 11e0) - (sg * sg) / (sh + 1e0) AS gain FROM c WHERE i <= least(32, (used + 1) // 2) AND sh - lh > 0)
    SELECT leaf, dir, place, round(gain, 4) AS gain FROM z WHERE gain > 0""",
)
def many_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SplitParams(lambda_l2=1.0, min_data_in_leaf=1, min_data_per_group=1)
    found = split.scored(split.categorical_candidates(hist_of(spark, sf_dir).where("feature = 1"), [Feature(1, 8, categorical=True)], p), p)
    return found.select("leaf", "dir", F.col("threshold").cast("int").alias("place"), _number("gain"))


@query("tr19_gain_weights", f"{_scan('1e0', 5)} SELECT leaf, feature, round(max(gain * CASE feature WHEN 0 THEN 5e-1 WHEN 1 THEN 1e0 ELSE 2e0 END), 4) AS gain FROM s WHERE gain > 0 GROUP BY leaf, feature")
def gain_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = [Feature(0, 11, "nan", contri=0.5), Feature(1, 8), Feature(2, 7, contri=2.0)]
    found = split.scored(split.numeric_candidates(hist_of(spark, sf_dir), features, _P), _P)
    return found.groupBy("leaf", "feature").agg(F.round(F.max("gain"), 4).alias("gain"))


@query(
    "tr21_monotone",
    f"{_scan('1e0', 5)}, k AS (SELECT c.leaf, c.feature, c.dir, c.threshold, -lg / (lh + 1e0) AS lo, -(sg - lg) / (sh - lh + 1e0) AS ro, s.gain FROM c JOIN s ON c.leaf = s.leaf AND c.feature = s.feature AND c.dir = s.dir AND c.threshold = s.threshold WHERE c.feature = 1) SELECT leaf, CAST(threshold AS INTEGER) AS threshold, round(gain, 4) AS gain FROM k WHERE gain > 0 AND ro >= lo",
)
def monotone(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaves = spark.createDataFrame([(i, 0.0, float("-inf"), float("inf"), 0) for i in (0, 1)], "leaf int, parent_output double, lo double, hi double, depth int")
    found = split.scored(split.numeric_candidates(hist_of(spark, sf_dir).where("feature = 1"), [Feature(1, 8, monotone=1)], _P), _P, leaves)
    return found.select("leaf", F.col("threshold").cast("int").alias("threshold"), _number("gain"))


@query("tr23_drawn_thresholds", f"{_scan('1e0', 5)} SELECT leaf, feature, CAST(threshold AS INTEGER) AS threshold, round(gain, 4) AS gain FROM s WHERE gain > 0 AND dir = 0 AND threshold = 3")
def drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = split.scored(split.numeric_candidates(hist_of(spark, sf_dir), _NUMERIC, _P), _P).where("dir = 0 AND threshold = 3")
    return found.select("leaf", "feature", F.col("threshold").cast("int").alias("threshold"), _number("gain"))


@query("tr25_split_costs", f"{_scan('1e0', 5)} SELECT leaf, feature, dir, CAST(threshold AS INTEGER) AS threshold, round(gain - 1e-3 * (ln + rn) - CASE feature WHEN 1 THEN 5e0 ELSE 0e0 END, 4) AS gain FROM s WHERE gain > 0")
def costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = SplitParams(lambda_l2=1.0, min_data_in_leaf=5, cegb_penalty_split=1e-3)
    features = [Feature(0, 11, "nan"), Feature(1, 8, penalty=5.0), Feature(2, 7)]
    found = split.scored(split.numeric_candidates(hist_of(spark, sf_dir), features, p), p)
    return found.select("leaf", "feature", "dir", F.col("threshold").cast("int").alias("threshold"), _number("gain"))


@query("tr28_partition", f"{WITH} SELECT leaf, count(*) AS n FROM (SELECT CASE WHEN leaf = 0 AND NOT (CASE WHEN b0 = 10 THEN TRUE ELSE b0 <= 4 END) THEN 2 WHEN leaf = 1 AND b2 NOT IN (1, 4) THEN 3 ELSE leaf END AS leaf FROM t) GROUP BY leaf")
def partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.plans.grower import bin_test

    features = {0: Feature(0, 11, "nan"), 2: Feature(2, 7, categorical=True)}
    a = bin_test({"feature": 0, "cats": None, "threshold": 4, "default_left": True}, features)
    b = bin_test({"feature": 2, "cats": [1, 4]}, features)
    leaf = F.when((F.col("leaf") == 0) & ~a, 2).when((F.col("leaf") == 1) & ~b, 3).otherwise(F.col("leaf"))
    return shared(spark, sf_dir).groupBy(leaf.alias("leaf")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "tr31_leaf_moments",
    f"{WITH} SELECT leaf, count(*) AS n, round(sum(f1 * f1) / count(*), 6) AS xx, round(sum(f1 * f2) / count(*), 6) AS xy, round(sum(f1 * (s - y)) / count(*), 6) AS xg FROM t GROUP BY leaf",
)
def leaf_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.plans import linear

    df = shared(spark, sf_dir).withColumns({"grad": F.col("s") - F.col("y"), "hess": F.lit(1.0)})
    m = linear.moments(df, F.col("leaf"), ["f1", "f2"], [[0, 1], [0, 1]])
    return m.select(F.col("_leaf").alias("leaf"), "n", r6(F.col("h0_0") / F.col("n"), "xx"), r6(F.col("h0_1") / F.col("n"), "xy"), r6(F.col("g0") / F.col("n"), "xg"))


# --- sampling ----------------------------------------------------------------------------------------------------------------


@query("sm01_bagging", f"{WITH} SELECT row_id, {draw('row_id', '3', '0')} < 5e-1 AS in_bag FROM t")
def bagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bagging(shared(spark, sf_dir), 0.5).select("row_id", "in_bag")


@query("sm02_balanced_bagging", f"{WITH} SELECT row_id, yb, {draw('row_id', '3', '0')} < CASE WHEN yb > 0 THEN 3e-1 ELSE 9e-1 END AS in_bag FROM t")
def balanced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bagging(shared(spark, sf_dir), 1.0, pos=0.3, neg=0.9, label="yb").select("row_id", "yb", "in_bag")


@query("sm03_query_bagging", f"{WITH} SELECT row_id, query_id, {draw('query_id', '3', '0')} < 5e-1 AS in_bag FROM t")
def query_bagging(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.bagging(shared(spark, sf_dir), 0.5, by_query="query_id").select("row_id", "query_id", "in_bag")


@query("sm05_goss_top", f"{WITH}, z AS (SELECT row_id, abs(y - s) AS size FROM t), k AS (SELECT size AS cut FROM (SELECT size, row_number() OVER (ORDER BY size DESC) AS r, count(*) OVER () AS n FROM z) WHERE r = greatest(1, CAST(floor(n * 2e-1) AS BIGINT))) SELECT row_id, round(size, 6) AS size FROM z, k WHERE size >= cut")
def goss_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = shared(spark, sf_dir).withColumns({"grad": F.col("y") - F.col("s"), "hess": F.lit(1.0)})
    _, cut = sampling.kth_largest(df, F.abs(F.col("grad") * F.col("hess")), 0.2)
    # the sampled rest is amplified, and its gradients with it: the plain ones tell the top rows
    kept = sampling.goss(df.withColumn("size", F.abs("grad"))).where("in_bag")
    return kept.where(F.col("size") >= cut).select("row_id", r6("size", "size"))


@query("sm06_top_k", f"{WITH} SELECT row_id, round(y, 6) AS y FROM t ORDER BY o_y DESC, row_id LIMIT 25".replace("o_y", "y"))
def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.arg_top(shared(spark, sf_dir).orderBy("row_id"), F.struct(F.col("y"), -F.col("row_id")), 25).select("row_id", r6("y", "y"))


# --- prediction --------------------------------------------------------------------------------------------------------------


def small_model() -> Model:
    """Two trees with missing values, categories and a linear leaf's place kept constant."""
    first = Tree(
        [Node(0, 12.0, 1, 1, -1, True, "nan", gain=5.0, count=100), Node(2, 0.0, 0, -2, -3, cats=[1, 4], bins=[1, 2], gain=3.0, count=60)],
        [Leaf(0.5, 40, 40), Leaf(-0.25, 25, 25), Leaf(0.125, 35, 35)],
    )
    second = Tree([Node(1, 3.0, 3, -1, 1, False, "zero", gain=2.0, count=100), Node(0, 30.0, 5, -2, -3, False, "nan", gain=0.0, count=50)], [Leaf(-0.5, 50, 50), Leaf(0.375, 20, 20), Leaf(0.75, 30, 30)])
    return Model(["f0", "f1", "f2"], "binary", 1, [first, second], infos=["[0:50]", "[-5:17]", "1:2:4"])


_MODEL = small_model()
# the same two trees, written by hand
_FIRST = "CASE WHEN f0 IS NULL OR f0 <= 12 THEN CASE WHEN f2 IN (1, 4) THEN -25e-2 ELSE 125e-3 END ELSE 5e-1 END"
_SECOND = "CASE WHEN f1 <> 0 AND f1 <= 3 THEN -5e-1 WHEN f0 <= 30 THEN 375e-3 ELSE 75e-2 END"
_RAW = f"({_FIRST} + {_SECOND})"


def _predicted(spark: SparkSession, sf_dir: str, mode: str, **more: object) -> DataFrame:
    return predict(shared(spark, sf_dir), _MODEL, mode, **more)


@query("pr01_decisions", f"{WITH} SELECT row_id, CASE WHEN f0 IS NULL THEN TRUE ELSE f0 <= 12 END AS first, f2 IN (1, 4) AS second, CASE WHEN f1 = 0 THEN FALSE ELSE f1 <= 3 END AS third FROM t")
def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    stump = lambda n: Tree([Node(n.feature, n.threshold, 0, -1, -2, n.default_left, n.missing, n.cats)], [Leaf(1.0), Leaf(0.0)])
    nodes = [_MODEL.trees[0].nodes[0], _MODEL.trees[0].nodes[1], _MODEL.trees[1].nodes[0]]
    return shared(spark, sf_dir).select("row_id", *((F.expr(tree_sql(stump(n), _MODEL.features)) > 0.5).alias(name) for n, name in zip(nodes, ("first", "second", "third"), strict=True)))


@query("pr04_raw_score", f"{WITH} SELECT row_id, round({_RAW}, 6) AS prediction FROM t")
def raw_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "raw").select("row_id", r6("prediction", "prediction"))


@query("pr04_raw_score_batches", f"{WITH} SELECT row_id, round({_RAW}, 6) AS prediction FROM t")
def raw_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "raw", engine="batch").select("row_id", r6("prediction", "prediction"))


@query("pr05_prediction", f"{WITH} SELECT row_id, round(1 / (1 + exp(-({_RAW}))), 6) AS prediction FROM t")
def prediction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "prediction").select("row_id", r6("prediction", "prediction"))


_LEAVES = ("CASE WHEN f0 IS NULL OR f0 <= 12 THEN CASE WHEN f2 IN (1, 4) THEN 1 ELSE 2 END ELSE 0 END", "CASE WHEN f1 <> 0 AND f1 <= 3 THEN 0 WHEN f0 <= 30 THEN 1 ELSE 2 END")


@query("pr06_leaf_index", f"{WITH} SELECT row_id, {_LEAVES[0]} AS first, {_LEAVES[1]} AS second FROM t")
def leaf_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "leaf").select("row_id", F.col("prediction")[0].alias("first"), F.col("prediction")[1].alias("second"))


@query("pr07_early_stop", f"{WITH} SELECT row_id, round(CASE WHEN 2 * abs({_FIRST}) > 6e-1 THEN {_FIRST} ELSE {_RAW} END, 6) AS prediction FROM t")
def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _predicted(spark, sf_dir, "early_stop", margin=0.6, freq=1).select("row_id", r6("prediction", "prediction"))


# Shapley values by definition: a tree's mean where only the features of a set are known, others weighing children by their counts
_KNOWN = f"""{WITH}, k AS (SELECT row_id, {_FIRST} AS a, {_SECOND} AS b,
        CASE WHEN f0 IS NULL OR f0 <= 12 THEN 25e0 / 60 * -25e-2 + 35e0 / 60 * 125e-3 ELSE 5e-1 END AS a0, 4e-1 * 5e-1 + 6e-1 * CASE WHEN f2 IN (1, 4) THEN -25e-2 ELSE 125e-3 END AS a2,
        4e-1 * 5e-1 + 6e-1 * (25e0 / 60 * -25e-2 + 35e0 / 60 * 125e-3) AS none_a,
        CASE WHEN f1 <> 0 AND f1 <= 3 THEN -5e-1 ELSE 4e-1 * 375e-3 + 6e-1 * 75e-2 END AS b1, 5e-1 * -5e-1 + 5e-1 * CASE WHEN f0 <= 30 THEN 375e-3 ELSE 75e-2 END AS b0,
        5e-1 * -5e-1 + 5e-1 * (4e-1 * 375e-3 + 6e-1 * 75e-2) AS none_b FROM t)"""


@query(
    "pr08_contributions",
    f"{_KNOWN} SELECT row_id, round((a0 - none_a + a - a2 + b0 - none_b + b - b1) / 2, 6) AS c0, round((b1 - none_b + b - b0) / 2, 6) AS c1, round((a2 - none_a + a - a0) / 2, 6) AS c2, round(none_a + none_b, 6) AS expected FROM k",
)
def contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _predicted(spark, sf_dir, "contrib")
    return out.select("row_id", *(r6(F.col("prediction")[i], name) for i, name in enumerate(("c0", "c1", "c2", "expected"))))


@query("pr09_configured", f"{WITH} SELECT row_id, [{_LEAVES[0]}, {_LEAVES[1]}] AS prediction FROM t")
def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    from thicket.plans import api

    return api.predict_configured(shared(spark, sf_dir), _MODEL, {"predict_leaf_index": True}).select("row_id", "prediction")


def _linear() -> Tree:
    return Tree([Node(1, 3.0, 0, -1, -2)], [Leaf(0.5, const=1.0, features=[0, 1], coefs=[0.5, -0.25]), Leaf(-0.5)])


@query("pr11_linear_leaf", f"{WITH} SELECT row_id, round(CASE WHEN f1 <= 3 THEN CASE WHEN f0 IS NULL THEN 5e-1 ELSE 1e0 + 5e-1 * f0 - 25e-2 * f1 END ELSE -5e-1 END, 6) AS prediction FROM t")
def linear_leaf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict(shared(spark, sf_dir), Model(["f0", "f1"], "regression", 1, [_linear()]), "raw").select("row_id", r6("prediction", "prediction"))


@query("io16_model_sql", f"{WITH} SELECT count(*) AS n, round(avg({_RAW}), 6) AS mean FROM t")
def model_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shared(spark, sf_dir).select(F.expr(_MODEL.to_sql()[0]).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x"), 6).alias("mean"))
