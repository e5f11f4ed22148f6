"""Split search over histograms: gains as Columns, scans as windows over bins, categories as folds over sorted arrays.

All leaves and features are searched by one query. Only bins that hold rows are candidates: a threshold at an empty bin has the sums
of a neighbour, and the order of ties prefers that neighbour.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.operators.binning import NAN, ZERO_MISSING, BinMapper

EPS = 1e-15


@dataclass(frozen=True)
class SplitParams:
    lambda_l1: float = 0.0
    lambda_l2: float = 0.0
    max_delta_step: float = 0.0
    path_smooth: float = 0.0
    min_data_in_leaf: int = 20
    min_sum_hessian_in_leaf: float = 1e-3
    min_gain_to_split: float = 0.0
    count_mode: str = "exact"
    max_cat_to_onehot: int = 4
    max_cat_threshold: int = 32
    cat_smooth: float = 10.0
    cat_l2: float = 10.0
    min_data_per_group: int = 100
    monotone_penalty: float = 0.0
    cegb_tradeoff: float = 1.0
    cegb_penalty_split: float = 0.0

    def with_l2(self, extra: float) -> SplitParams:
        return replace(self, lambda_l2=self.lambda_l2 + extra)


@dataclass(frozen=True)
class Feature:
    """What the search needs to know of a feature."""

    index: int
    num_bin: int
    missing: str = "none"
    default_bin: int = 0
    categorical: bool = False
    monotone: int = 0
    contri: float = 1.0
    penalty: float = 0.0
    draws: dict[int, int] = field(default_factory=dict)
    column: str = ""  # SQL for its bin, if that isn't a column of its own

    @staticmethod
    def of(index: int, m: BinMapper, **more: Any) -> Feature:
        return Feature(index, m.num_bin, m.missing, m.default_bin, m.categorical, **more)


# --- gains ------------------------------------------------------------------------------------------------------------


def soft(g: Column, l1: float) -> Column:
    """The gradient sum less l1, not beyond zero."""
    if l1 == 0:
        return g
    return F.greatest(F.abs(g) - l1, F.lit(0.0)) * F.when(g < 0, -1.0).otherwise(1.0)


def leaf_output(g: Column, h: Column, p: SplitParams, n: Column | None = None, parent: Column | None = None) -> Column:
    raw = -soft(g, p.lambda_l1) / (h + p.lambda_l2)
    if p.max_delta_step > 0:
        raw = F.greatest(F.least(raw, F.lit(p.max_delta_step)), F.lit(-p.max_delta_step))
    if p.path_smooth > 0 and n is not None:
        weight = n / p.path_smooth
        raw = raw * weight / (weight + 1.0) + (parent if parent is not None else F.lit(0.0)) / (weight + 1.0)
    return raw


def gain_given_output(g: Column, h: Column, out: Column, p: SplitParams) -> Column:
    return -(2.0 * soft(g, p.lambda_l1) * out + (h + p.lambda_l2) * out * out)


def leaf_gain(g: Column, h: Column, p: SplitParams, n: Column | None = None, parent: Column | None = None) -> Column:
    """Closed form where nothing holds the output back."""
    if p.max_delta_step > 0 or p.path_smooth > 0:
        return gain_given_output(g, h, leaf_output(g, h, p, n, parent), p)
    s = soft(g, p.lambda_l1)
    return s * s / (h + p.lambda_l2)


def monotone_penalty(depth: Column, penalty: float) -> Column:
    """The factor of a monotone feature's gain at a depth."""
    if penalty <= 0:
        return F.lit(1.0)
    near = 1.0 - penalty / F.pow(F.lit(2.0), depth) if penalty <= 1 else 1.0 - F.pow(F.lit(2.0), penalty - 1.0 - depth)
    return F.when(F.lit(penalty) >= depth + 1.0, F.lit(EPS)).otherwise(near + EPS)


# --- candidates --------------------------------------------------------------------------------------------------------


def _feature_table(hist: DataFrame, features: list[Feature]) -> DataFrame:
    rows = [(f.index, f.num_bin, f.missing if f.num_bin > 2 or f.categorical else "none", f.missing == NAN and f.num_bin <= 2, f.default_bin, f.categorical, f.monotone, f.contri, f.penalty) for f in features]
    return hist.sparkSession.createDataFrame(rows, "feature int, num_bin int, missing string, small_nan boolean, default_bin int, categorical boolean, monotone int, contri double, penalty double")


def _prepared(hist: DataFrame, features: list[Feature], p: SplitParams) -> DataFrame:
    """hist with the features' columns (a row a feature, so it is broadcast), totals, and counts as asked for."""
    rows = hist.join(F.broadcast(_feature_table(hist, features)), "feature")
    whole = Window.partitionBy("leaf", "feature")
    rows = rows.withColumns({"sg": F.sum("g").over(whole), "sh": F.sum("h").over(whole), "sn": F.sum("n").over(whole)})
    if p.count_mode == "hessian":
        rows = rows.withColumn("n", F.floor(F.col("h") * F.col("sn") / F.col("sh") + 0.5).cast("long"))
    return rows


def numeric_candidates(hist: DataFrame, features: list[Feature], p: SplitParams) -> DataFrame:
    """leaf, feature, dir (0: missing left, 1: missing right), threshold, lg, lh, ln, rg, rh, rn and the features' columns."""
    rows = _prepared(hist, [f for f in features if not f.categorical], p)
    gone = ((F.col("missing") == NAN) & (F.col("bin") == F.col("num_bin") - 1)) | ((F.col("missing") == ZERO_MISSING) & (F.col("bin") == F.col("default_bin")))
    order, whole = Window.partitionBy("leaf", "feature").orderBy("bin"), Window.partitionBy("leaf", "feature")
    rows = rows.withColumn("gone", gone)
    for c in ("g", "h", "n"):
        own = F.when(F.col("gone"), F.lit(0)).otherwise(F.col(c))
        rows = rows.withColumns({f"u{c}": F.sum(own).over(order), f"t{c}": F.sum(own).over(whole)})
    side = lambda kind: {
        "g": (F.col("sg") - F.col("tg") + F.col("ug") - F.col("g"), F.col("tg") - F.col("ug") + F.col("g")) if kind == 0 else (F.col("ug"), F.col("sg") - F.col("ug")),
        "h": (F.col("sh") - F.col("th") + F.col("uh") - F.col("h"), F.col("th") - F.col("uh") + F.col("h")) if kind == 0 else (F.col("uh"), F.col("sh") - F.col("uh")),
        "n": (F.col("sn") - F.col("tn") + F.col("un") - F.col("n"), F.col("tn") - F.col("un") + F.col("n")) if kind == 0 else (F.col("un"), F.col("sn") - F.col("un")),
    }
    arms = []
    for kind in (0, 1):
        s = side(kind)
        threshold = F.col("bin") - 1 if kind == 0 else F.col("bin")
        arms.append(F.struct(F.lit(kind).alias("dir"), threshold.alias("threshold"), *(s[c][i].alias(f"{'lr'[i]}{c}") for i in (0, 1) for c in ("g", "h", "n"))))
    # without missing values the two directions agree: one is enough
    both = F.when(F.col("missing").isin(NAN, ZERO_MISSING) & (F.col("sn") > F.col("tn")), F.array(*arms)).otherwise(F.array(arms[0]))
    out = rows.where(~F.col("gone")).withColumn("e", F.explode(both)).where((F.col("e.threshold") >= 0) & (F.col("e.ln") > 0) & (F.col("e.rn") > 0))
    kept = ["leaf", "feature", "sg", "sh", "sn", "small_nan", "monotone", "contri", "penalty"]
    return out.select(*kept, "e.*").withColumn("cats", F.lit(None).cast("array<int>"))


def categorical_candidates(hist: DataFrame, features: list[Feature], p: SplitParams) -> DataFrame:
    """The same columns; cats holds the bins that go left. Few categories: each against the rest. More: prefixes of those with enough
    rows, in order of g / (h + cat_smooth), from both ends, at places where enough rows have come since the last."""
    rows = _prepared(hist, [f for f in features if f.categorical], p).where("bin > 0")
    kept = ["leaf", "feature", "sg", "sh", "sn", "small_nan", "monotone", "contri", "penalty"]
    sides = lambda g, h, n: [g.alias("lg"), h.alias("lh"), n.alias("ln"), (F.col("sg") - g).alias("rg"), (F.col("sh") - h).alias("rh"), (F.col("sn") - n).alias("rn")]
    one = rows.where(F.col("num_bin") <= p.max_cat_to_onehot)
    alone = one.select(*kept, F.lit(0).alias("dir"), F.col("bin").alias("threshold"), *sides(F.col("g"), F.col("h"), F.col("n")), F.array("bin").alias("cats"))
    many = rows.where((F.col("num_bin") > p.max_cat_to_onehot) & (F.col("n") >= p.cat_smooth))
    item = F.struct((F.col("g") / (F.col("h") + p.cat_smooth)).alias("ctr"), F.col("bin").alias("bin"), F.col("g").cast("double").alias("g"), F.col("h").cast("double").alias("h"), F.col("n").alias("n"))
    lists = many.groupBy(*kept).agg(F.sort_array(F.collect_list(item)).alias("up"))  # max_bin entries at most
    most = f"least({p.max_cat_threshold}, int((size(up) + 1) div 2))"
    step = f"""(s, e) -> CASE WHEN s.over THEN s ELSE transform(array(struct(s.g + e.g AS g, s.h + e.h AS h, s.n + e.n AS n, s.held + e.n AS held)), c ->
        CASE WHEN c.n < {p.min_data_in_leaf} OR c.h < {p.min_sum_hessian_in_leaf}D THEN struct(c.g AS g, c.h AS h, c.n AS n, c.held AS held, s.i + 1 AS i, false AS over, s.found AS found)
             WHEN sn - c.n < {max(p.min_data_in_leaf, p.min_data_per_group)} OR sh - c.h < {p.min_sum_hessian_in_leaf}D THEN struct(c.g AS g, c.h AS h, c.n AS n, c.held AS held, s.i + 1 AS i, true AS over, s.found AS found)
             WHEN c.held < {p.min_data_per_group} THEN struct(c.g AS g, c.h AS h, c.n AS n, c.held AS held, s.i + 1 AS i, false AS over, s.found AS found)
             ELSE struct(c.g AS g, c.h AS h, c.n AS n, 0L AS held, s.i + 1 AS i, false AS over, array_append(s.found, struct(s.i AS i, c.g AS g, c.h AS h, c.n AS n)) AS found) END)[0] END"""
    begin = "struct(0D AS g, 0D AS h, 0L AS n, 0L AS held, 0 AS i, false AS over, CAST(array() AS array<struct<i: int, g: double, h: double, n: bigint>>) AS found)"
    fold = lambda way: f"aggregate(slice({way}, 1, {most}), {begin}, {step}).found"
    lists = lists.withColumn("down", F.reverse("up"))
    both = lists.select("*", F.explode(F.expr(f"array(struct(0 AS dir, up AS way, {fold('up')} AS found), struct(1 AS dir, down AS way, {fold('down')} AS found))")).alias("w"))
    found = both.select("*", F.explode("w.found").alias("f"))
    cats = F.expr("transform(slice(w.way, 1, f.i + 1), e -> e.bin)")
    prefixes = found.select(*kept, F.col("w.dir").alias("dir"), F.col("f.i").alias("threshold"), *sides(F.col("f.g"), F.col("f.h"), F.col("f.n")), cats.alias("cats"))
    return alone.withColumn("wide", F.lit(False)).unionByName(prefixes.withColumn("wide", F.lit(True)))


def scored(candidates: DataFrame, p: SplitParams, leaves: DataFrame | None = None) -> DataFrame:
    """Candidates that may be taken, with gain (above the leaf's own and ``min_gain_to_split``), left_output, right_output.
    leaves, if outputs depend on it: leaf, parent_output, lo, hi, depth."""
    c = candidates if "wide" in candidates.columns else candidates.withColumn("wide", F.lit(False))
    if leaves is None:
        c = c.withColumns({"parent_output": F.lit(0.0), "lo": F.lit(float("-inf")), "hi": F.lit(float("inf")), "depth": F.lit(0)})
    else:
        c = c.join(F.broadcast(leaves.select("leaf", "parent_output", "lo", "hi", "depth")), "leaf")  # a row a leaf
    wide = p.with_l2(p.cat_l2)
    parent = F.col("parent_output")

    def output(side: str, q: SplitParams) -> Column:
        return leaf_output(F.col(f"{side}g"), F.col(f"{side}h"), q, F.col(f"{side}n"), parent)

    def total(q: SplitParams) -> Column:
        return sum((leaf_gain(F.col(f"{s}g"), F.col(f"{s}h"), q, F.col(f"{s}n"), parent) for s in "lr"), F.lit(0.0))

    bound = lambda x: F.least(F.greatest(x, F.col("lo")), F.col("hi"))
    outputs = {f"{name}_output": F.when(F.col("wide"), output(s, wide)).otherwise(output(s, p)) for s, name in (("l", "left"), ("r", "right"))}
    if leaves is not None:
        outputs = {k: bound(v) for k, v in outputs.items()}
    c = c.withColumns(outputs)
    gain = F.when(F.col("wide"), total(wide)).otherwise(total(p))
    if leaves is not None:
        held = sum((gain_given_output(F.col(f"{s}g"), F.col(f"{s}h"), F.col(f"{n}_output"), p) for s, n in (("l", "left"), ("r", "right"))), F.lit(0.0))
        bounded = (F.col("monotone") != 0) | (F.col("lo") > float("-inf")) | (F.col("hi") < float("inf"))
        gain = F.when(bounded & ~F.col("wide"), held).otherwise(gain)
        wrong = F.col("monotone") * (F.col("right_output") - F.col("left_output")) < 0
        c = c.where(~wrong)
    shift = leaf_gain(F.col("sg"), F.col("sh"), p, F.col("sn"), parent) + p.min_gain_to_split
    c = c.withColumn("gain", (gain - shift)).where(
        (F.col("ln") >= p.min_data_in_leaf) & (F.col("rn") >= p.min_data_in_leaf) & (F.col("lh") >= p.min_sum_hessian_in_leaf) & (F.col("rh") >= p.min_sum_hessian_in_leaf) & (F.col("gain") > 0)
    )
    change = F.col("gain") * F.col("contri")
    if p.monotone_penalty > 0:
        change = change * F.when(F.col("monotone") != 0, monotone_penalty(F.col("depth").cast("double"), p.monotone_penalty)).otherwise(1.0)
    if p.cegb_penalty_split > 0:
        change = change - p.cegb_tradeoff * p.cegb_penalty_split * F.col("sn")
    return c.withColumn("gain", change - F.col("penalty")).withColumn("default_left", (F.col("dir") == 0) & ~F.col("small_nan") & F.col("cats").isNull())


def candidates(hist: DataFrame, features: list[Feature], p: SplitParams) -> DataFrame:
    kinds = {f.categorical for f in features}
    parts = [f(hist, features, p) for kind, f in ((False, numeric_candidates), (True, categorical_candidates)) if kind in kinds]
    parts = [x if "wide" in x.columns else x.withColumn("wide", F.lit(False)) for x in parts]
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def rank_key() -> list[Column]:
    """Order of candidates: larger gain, smaller feature, missing left first, there the higher threshold, else the lower."""
    place = F.when((F.col("dir") == 0) & F.col("cats").isNull(), -F.col("threshold")).otherwise(F.col("threshold"))
    return [(-F.col("gain")).alias("_1"), F.col("feature").alias("_2"), F.col("dir").alias("_3"), place.alias("_4")]


def best(found: DataFrame, by: list[str]) -> DataFrame:
    """The first candidate of each group: an aggregation that combines before the shuffle."""
    rest = [c for c in found.columns if c not in by]
    top = found.groupBy(*by).agg(F.min(F.struct(*rank_key(), F.struct(*rest).alias("row"))).alias("top"))
    return top.select(*by, "top.row.*")
