"""Row and column sampling. Draws are hashes of a row's key, a seed and the iteration: they don't depend on partitions or order, and
cost no state."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.objectives import uniform


class Lcg:
    """The linear congruential generator of sub-seeds: x * 214013 + 2531011 modulo 2^32."""

    def __init__(self, seed: int) -> None:
        self.x = seed & 0xFFFFFFFF

    def _next(self) -> int:
        self.x = (214013 * self.x + 2531011) & 0xFFFFFFFF
        return self.x

    def next_short(self, low: int, high: int) -> int:
        return ((self._next() >> 16) & 0x7FFF) % (high - low) + low

    def next_int(self, low: int, high: int) -> int:
        return (self._next() & 0x7FFFFFFF) % (high - low) + low

    def next_float(self) -> float:
        return ((self._next() >> 16) & 0x7FFF) / 32768.0

    def sample(self, n: int, k: int) -> list[int]:
        """k of 0 to n - 1, in order."""
        if k >= n:
            return list(range(n))
        out, left = [], k
        for i in range(n):
            if self.next_float() < left / (n - i):
                out.append(i)
                left -= 1
                if not left:
                    break
        return out


def lcg_short(seed: Column, low: int, high: int, turn: int = 0) -> Column:
    """``Lcg(seed).next_short(low, high)`` of every row's seed, after ``turn`` draws."""
    x = seed.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))
    for _ in range(turn + 1):
        x = (F.lit(214013) * x + F.lit(2531011)).bitwiseAND(F.lit(0xFFFFFFFF))
    return (F.shiftright(x, 16).bitwiseAND(F.lit(0x7FFF)) % (high - low) + low).cast("int")


def bernoulli(key: Column | str, fraction: float | Column, seed: int, iteration: int) -> Column:
    return uniform(key, F.lit(seed), F.lit(iteration)) < fraction


def bagging(df: DataFrame, fraction: float, key: str = "row_id", seed: int = 3, iteration: int = 0, pos: float = 1.0, neg: float = 1.0, label: str = "label", by_query: str | None = None) -> DataFrame:
    """``df`` with in_bag. pos, neg: fractions of the classes (balanced bagging, where one is under 1). by_query: a query's rows go
    together."""
    share: float | Column = F.when(F.col(label) > 0, pos).otherwise(neg) if pos < 1 or neg < 1 else fraction
    return df.withColumn("in_bag", bernoulli(F.col(by_query or key), share, seed, iteration))


def goss(df: DataFrame, top_rate: float = 0.2, other_rate: float = 0.1, key: str = "row_id", seed: int = 3, iteration: int = 0, grad: str = "grad", hess: str = "hess") -> DataFrame:
    """The rows of the largest |grad * hess|, and a sample of the others whose gradients and hessians are amplified: in_bag
    rows, with grad and hess adjusted. The cut is exact, found by counting, so no row is ranked one by one. Arrays: several classes, whose sizes add up."""
    arrays = dict(df.dtypes)[grad].startswith("array")
    size = F.aggregate(F.zip_with(grad, hess, lambda a, b: F.abs(a * b)), F.lit(0.0), lambda a, x: a + x) if arrays else F.abs(F.col(grad) * F.col(hess))
    n, cut = kth_largest(df, size, top_rate)
    k = max(1, int(n * top_rate))
    top = size >= cut
    other = max(1, int(n * other_rate))
    rate = other / max(1, n - k)
    kept = bernoulli(key, rate, seed, iteration)
    factor = F.when(top, 1.0).otherwise((n - k) / other)
    by = (lambda c: F.transform(c, lambda v: v * factor)) if arrays else (lambda c: F.col(c) * factor)
    return df.withColumn("in_bag", top | kept).withColumns({grad: by(grad), hess: by(hess)})


#: Buckets of a count, and values that are sorted at the end.
STEPS, FEW = 4096, 20_000


def kth_largest(df: DataFrame, size: Column, rate: float) -> tuple[int, float]:
    """The number of rows, and the k-th largest of their sizes (0 or more; null counts as 0), k the share ``rate`` of them and at least 1.
    Counts by the sizes' logarithms show the range that holds it, which is cut into ``STEPS`` parts, again and again, until few values are left."""
    rows = df.select(F.coalesce(size, F.lit(0.0)).alias("v"))
    step = F.when(F.col("v") > 0, F.floor(F.log2("v") * 8)).otherwise(F.lit(-10_000)).cast("long")
    # 17,000 steps hold all doubles
    found = sorted(rows.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), reverse=True)
    n = sum(r["n"] for r in found)
    if not n:
        return 0, 0.0
    ahead = max(1, int(n * rate))
    while True:
        for _, count, low, high in found:  # noqa: B007
            if ahead <= count:
                break
            ahead -= count
        inside = rows.where((F.col("v") >= F.lit(low)) & (F.col("v") <= F.lit(high)))
        if low == high:
            return n, low
        if count <= FEW:
            values = sorted((r["v"] for r in inside.collect()), reverse=True)  # FEW rows at most
            return n, values[ahead - 1]
        part = F.least(F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / STEPS)), F.lit(STEPS - 1)).cast("long")
        found = sorted(inside.groupBy(part.alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect(), reverse=True)


def arg_top(df: DataFrame, value: Column, k: int) -> DataFrame:
    """The k rows of the largest value: each task keeps its own k first."""
    return df.orderBy(value.desc()).limit(k)


def column_sample(features: list[int], fraction: float, rng: random.Random) -> list[int]:
    """max(round(n * fraction), min(1, n)) of the features, in order."""
    k = max(int(len(features) * fraction + 0.5), min(1, len(features)))
    return sorted(rng.sample(features, k))


def dart_drop(n: int, drop_rate: float, weights: list[float], rng: random.Random, skip: float = 0.5, most: int = 50, uniform_drop: bool = False) -> list[int]:
    """Iterations to drop: none with probability ``skip``; else each with drop_rate, by weight unless ``uniform_drop``."""
    if rng.random() < skip or not n:
        return []
    total = sum(weights)
    rate = drop_rate if uniform_drop or not total else drop_rate * n / total
    if most > 0:
        rate = min(rate, most / (n if uniform_drop or not total else total))
    out = []
    for i in range(n):
        if rng.random() < rate * (1.0 if uniform_drop else weights[i]):
            out.append(i)
            if most > 0 and len(out) >= most:
                break
    return out


def dart_factors(dropped: int, rate: float, xgboost_mode: bool = False) -> tuple[float, float]:
    """(factor of the new tree, factor of the dropped trees)."""
    if xgboost_mode:
        return (rate if not dropped else rate / (dropped + rate)), (dropped / (dropped + rate) if dropped else 1.0)
    return rate / (dropped + 1), (dropped / (dropped + 1.0) if dropped else 1.0)
