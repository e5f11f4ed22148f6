"""Running sums and look-backs over tables of any size, and quantiles from them: ranges of the order are worked on in parallel, and each
adds what one small row for every range ahead of it says, so no task sorts a whole table or group.

The ranges are written once to the shared folder, so every later read finds a row in the same range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from thicket.plans.tables import materialise

_AHEAD = (Window.unboundedPreceding, -1)


def _ranges(df: DataFrame, columns: list[Column]) -> DataFrame:
    """``df`` with _part, the number of a row's range."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return materialise(df.repartitionByRange(parts, *columns).withColumn("_part", F.spark_partition_id()), "ranges")


def running(df: DataFrame, order: str, values: list[str], descending: bool = False, by: list[str] | None = None) -> DataFrame:
    """Adds before_<value>, the sum over all rows ahead in ``order``, and all_<value>, the sum over all; both in groups ``by``, which
    may not be null. ``order`` is unique in a group."""
    by, column = by or [], F.desc(order) if descending else F.asc(order)
    ranged = _ranges(df, [*map(F.asc, by), column])
    inside = Window.partitionBy("_part", *by).orderBy(column).rowsBetween(*_AHEAD)
    own = ranged.withColumns({f"_b_{v}": F.coalesce(F.sum(v).over(inside), F.lit(0)) for v in values})
    group = Window.partitionBy(*(by or [F.lit(1)]))  # of the totals: one row a range and group
    totals = ranged.groupBy("_part", *by).agg(*(F.sum(v).alias(f"_t_{v}") for v in values))
    totals = totals.select("_part", *by, *(F.coalesce(F.sum(f"_t_{v}").over(group.orderBy("_part").rowsBetween(*_AHEAD)), F.lit(0)).alias(f"_a_{v}") for v in values), *(F.sum(f"_t_{v}").over(group).alias(f"all_{v}") for v in values))
    joined = own.join(totals, ["_part", *by])
    return joined.select(*df.columns, *((F.col(f"_b_{v}") + F.col(f"_a_{v}")).alias(f"before_{v}") for v in values), *(f"all_{v}" for v in values))


def previous(df: DataFrame, order: str, value: str, name: str = "before") -> DataFrame:
    """Adds the value of the row ahead in ``order``, null for the first."""
    ranged = _ranges(df, [F.asc(order)])
    lasts = ranged.groupBy("_part").agg(F.max_by(value, order).alias("_last"))
    lasts = lasts.select("_part", F.lag("_last").over(Window.orderBy("_part")).alias("_last"))  # one row a range
    inside = Window.partitionBy("_part").orderBy(order)
    own = ranged.withColumns({"_lag": F.lag(value).over(inside), "_first": F.row_number().over(inside) == 1})
    return own.join(F.broadcast(lasts), "_part").select(*df.columns, F.when(F.col("_first"), F.col("_last")).otherwise(F.col("_lag")).alias(name))


def percentile(df: DataFrame, value: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """Percentile with linear interpolation, over all rows or by group: by..., value. Nulls don't count."""
    by = by or []
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    rows = running(counts, "v", ["n"], by=by)
    place = F.lit(alpha) * (F.col("all_n") - 1)
    holds = lambda at: (F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n"))
    found = rows.groupBy(*by).agg(F.max(F.when(holds(F.floor(place)), F.col("v"))).alias("low"), F.max(F.when(holds(F.ceil(place)), F.col("v"))).alias("high"), F.max(place - F.floor(place)).alias("between"))
    return found.select(*by, (F.col("low") + (F.col("high") - F.col("low")) * F.col("between")).alias("value"))


def weighted_percentile(df: DataFrame, value: str, weight: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """Percentile by cumulative weights: the first value whose sum exceeds alpha times the total; from the value before, it interpolates if
    the step weighs 1 or more. Equal values weigh together first, so a group's rows combine before they meet."""
    by = by or []
    sums = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.sum(weight).alias("w"))
    rows = running(sums, "v", ["w"], by=by)
    upto, target = F.col("before_w") + F.col("w"), F.lit(alpha) * F.col("all_w")
    over, under = upto > target, upto <= target
    found = rows.groupBy(*by).agg(
        F.min(F.when(over, F.struct("v", upto.alias("upto")))).alias("hit"), F.max(F.when(under, F.struct("v", upto.alias("upto")))).alias("last"), F.max(target).alias("target")
    ).where("hit is not null")
    before = F.coalesce("last.upto", F.lit(0.0))
    step = F.col("hit.upto") - before
    between = F.col("last.v") + (F.col("target") - before) / step * (F.col("hit.v") - F.col("last.v"))
    return found.select(*by, F.when(F.col("last").isNull() | (step < 1.0), F.col("hit.v")).otherwise(between).alias("value"))
