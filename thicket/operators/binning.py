"""Feature binning: distinct values are counted in Spark for all features at once; bounds are found from these counts.

``distinct_counts`` melts the features and counts, combining before the shuffle. What comes to the driver is bounded: ``MAX_DISTINCT`` values a
feature, and as many features at a time as have ``MAX_VALUES`` together, so what a feature's bins are doesn't hang on how many features there are. Of a
numeric feature with more, Spark cuts the sorted values into that many runs of about equal counts first; a run keeps its least and its largest value, so bounds
lie between runs and counts of bins are exact. Of a categorical one the most frequent codes come, as many as it may have bins.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.functions.ordered import running
from thicket.plans.tables import scratch

ZERO = 1e-35
NONE, ZERO_MISSING, NAN = "none", "zero", "nan"
#: Distinct values of a feature that come to the driver, and of the features that come together.
MAX_DISTINCT, MAX_VALUES = 200_000, 4_000_000


def next_up(x: float) -> float:
    return math.nextafter(x, math.inf)


@dataclass
class BinMapper:
    """How a feature's values become bins. Numeric: ``upper`` bounds, inclusive. Categorical: ``categories`` of bins 1, 2, ...
    (bin 0 holds all others)."""

    name: str
    upper: list[float] = field(default_factory=list)
    categories: list[int] = field(default_factory=list)
    categorical: bool = False
    missing: str = NONE
    default_bin: int = 0
    most_frequent: int = 0
    sparse_rate: float = 0.0
    low: float = 0.0
    high: float = 0.0
    counts: list[int] = field(default_factory=list)

    @property
    def num_bin(self) -> int:
        if self.categorical:
            return len(self.categories) + 1
        return len(self.upper) + (self.missing == NAN)

    @property
    def trivial(self) -> bool:
        return self.num_bin <= 1

    def bin(self, value: float | None) -> int:
        """The bin of one value, for tests and thresholds."""
        missing = value is None or math.isnan(value)
        if self.categorical:
            code = -1 if missing else int(value)
            return self.categories.index(code) + 1 if code in self.categories else 0
        if missing:
            if self.missing == NAN:
                return self.num_bin - 1
            value = 0.0
        return next(i for i, u in enumerate(self.upper) if value <= u)

    def info(self) -> str:
        """``[min:max]``, the categories, or ``none``."""
        if self.trivial:
            return "none"
        return ":".join(map(str, self.categories)) if self.categorical else f"[{self.low!r}:{self.high!r}]"

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> BinMapper:
        return BinMapper(**json.loads(text))


# --- counting in Spark ------------------------------------------------------------------------------------------------


def melt(df: DataFrame, features: list[str], keep: list[str] | None = None) -> DataFrame:
    """A row for each row and feature: keep..., feature (its number), value."""
    pairs = F.array(*(F.struct(F.lit(i).alias("feature"), F.col(f"`{c}`").cast("double").alias("value")) for i, c in enumerate(features)))
    return df.select(*(keep or []), F.explode(pairs).alias("_m")).select(*(keep or []), "_m.feature", "_m.value")


def row_sample(df: DataFrame, rows: int, key: str, seed: int = 1, known: int | None = None) -> DataFrame:
    """All rows if there are at most ``rows`` (``known``: their number), else those of the ``rows`` least hashes of ``key``. A threshold that the count sets lets hardly
    more than ``rows`` pass, so what is ordered is no larger however many partitions there are. Rows of equal keys pass together, so many of these may
    leave too few, or too many to be ordered cheaply."""
    n = df.count() if known is None else known
    if n <= rows:
        return df
    hashed = F.xxhash64(key, F.lit(seed))
    unit = hashed.bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)
    near = df.where(unit < (rows + 10 * rows**0.5 + 100) / n)  # ten standard deviations more than wanted
    return near.orderBy(unit, hashed, key).limit(rows)


def distinct_counts(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, value (null for missing), n. -0.0 counts as 0.0."""
    value = F.when(F.isnan("value"), F.lit(None)).otherwise(F.col("value") + 0.0)
    return melt(df, features).select("feature", value.alias("value")).groupBy("feature", "value").agg(F.count(F.lit(1)).alias("n"))


def compress(counts: DataFrame, most: int) -> DataFrame:
    """Of counts (feature, value, n) at most about ``most`` a feature: runs of neighbours of equal counts stand for their largest value, ``low`` being the least."""
    runs = running(counts, "value", ["n"], by=["feature"])
    run = F.floor(F.col("before_n") * F.lit(float(most)) / F.col("all_n"))
    side = F.when(F.col("value") < -ZERO, -1).when(F.col("value") > ZERO, 1).otherwise(0)  # zero has bounds of its own
    return runs.groupBy("feature", run.alias("_run"), side.alias("_side")).agg(F.max("value").alias("value"), F.sum("n").alias("n"), F.min("value").alias("low")).drop("_run", "_side")


def top_codes(counts: DataFrame, most: int) -> DataFrame:
    """Of counts of codes (feature, value, n) the ``most`` most frequent of each feature; one row more, of code -1, holds the rest. Ranks are running counts over
    ranges, so no task sorts a whole feature."""
    codes = counts.groupBy("feature", F.when(F.col("value") < 0, -1.0).otherwise(F.floor("value").cast("double")).alias("value")).agg(F.sum("n").alias("n"))
    order = F.struct((F.col("value") < 0).cast("int").alias("other"), (-F.col("n")).alias("n"), "value")
    ranked = running(codes.withColumns({"_order": order, "_one": F.lit(1)}), "_order", ["_one", "n"], by=["feature"])
    held = (F.col("before__one") < most).alias("held")
    kept = ranked.select("feature", "value", "n", held).where("held").drop("held")
    rest = ranked.select("feature", "n", held).where("not held").groupBy("feature").agg(F.sum("n").alias("n"))
    return kept.unionByName(rest.select("feature", F.lit(-1.0).alias("value"), "n"))


# --- bounds on the driver ---------------------------------------------------------------------------------------------


def merge_close(values: np.ndarray, counts: np.ndarray, lows: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values with the next double as their neighbour count as the larger, and ``lows`` of them as the least. ``values`` ascend."""
    lows = values if lows is None else lows
    if not len(values):
        return values, counts, lows
    heads = np.flatnonzero(np.r_[True, lows[1:] - values[:-1] > np.abs(lows[1:]) * np.finfo(float).eps])
    return values[np.r_[heads[1:], len(values)] - 1], np.add.reduceat(counts, heads), lows[heads]


def _between(values: np.ndarray, ends: Iterator[int], lows: np.ndarray) -> list[float]:
    """Bounds after some values, each halfway to the next one's low, and infinity. Bounds that wouldn't differ are left out."""
    bounds: list[float] = []
    for i in ends:
        bound = next_up((values[i] + lows[i + 1]) / 2)
        if not bounds or bound > next_up(bounds[-1]):
            bounds.append(float(bound))
    return [*bounds, math.inf]


def _filled(sums: np.ndarray, least: int) -> Iterator[int]:
    """Last values of bins of at least ``least`` rows each. sums: running sums of counts."""
    at = 0
    while (at := int(np.searchsorted(sums, at + least))) < len(sums) - 1:
        yield at
        at = int(sums[at])


def _dealt(counts: np.ndarray, max_bin: int) -> Iterator[int]:
    """Last values of ``max_bin`` bins of about equal counts. A value that fills a mean bin alone is *heavy* and ends its bin; what the
    heavy ones leave is dealt out evenly over the other bins, and the mean follows what is left after each. A bin that is half full
    ends before a heavy value."""
    mean = counts.sum() / max_bin
    heavy = counts >= mean
    sums, light = np.cumsum(counts), np.cumsum(np.where(heavy, 0, counts))
    next_heavy = np.append(np.flatnonzero(heavy), len(counts))
    bins = max_bin - int(heavy.sum())
    share = lambda upto: (light[-1] - upto) / bins if bins else math.inf
    mean, before, made, at = share(0), 0, 0, 0
    while made < max_bin - 1:
        stop = int(next_heavy[np.searchsorted(next_heavy, at)])
        if stop > at and stop < len(counts) and sums[stop - 1] - before >= max(1.0, mean / 2):
            stop -= 1
        if mean < math.inf:
            stop = min(stop, int(np.searchsorted(sums, before + math.ceil(mean))))
        stop = max(stop, at)
        if stop >= len(counts) - 1:
            return
        yield stop
        made += 1
        if not heavy[stop]:
            bins -= 1
            mean = share(light[stop])
        before, at = int(sums[stop]), stop + 1


def even_bounds(values: np.ndarray, counts: np.ndarray, max_bin: int, min_data_in_bin: int, lows: np.ndarray | None = None) -> list[float]:
    """Upper bounds of at most ``max_bin`` bins: every value has its own if there are few, as far as its rows suffice. ``lows``: the least values of what
    ``values`` stand for, where these are the largest of runs."""
    lows = values if lows is None else lows
    if len(values) <= max_bin:
        return _between(values, _filled(np.cumsum(counts), max(1, min_data_in_bin)), lows)
    if min_data_in_bin > 0:
        max_bin = max(1, min(max_bin, int(counts.sum()) // min_data_in_bin))
    return _between(values, _dealt(counts, max_bin), lows)


def zero_bin_bounds(values: np.ndarray, counts: np.ndarray, max_bin: int, min_data_in_bin: int, forced: list[float] | None = None, lows: np.ndarray | None = None) -> list[float]:
    """Bounds with a bin of its own for zero; the bins on either side are shared by row counts. ``forced`` bounds come first."""
    lows = values if lows is None else lows
    if forced:
        return bounds_around(values, counts, max_bin, min_data_in_bin, forced, lows)
    low, high = int(np.searchsorted(values, -ZERO, "right")), int(np.searchsorted(values, ZERO, "right"))
    rows = int(counts[:low].sum()), int(counts[high:].sum())
    bounds: list[float] = []
    if low and max_bin > 1:
        room = max(1, int(rows[0] / sum(rows) * (max_bin - 1)))
        bounds = [*even_bounds(values[:low], counts[:low], room, min_data_in_bin, lows[:low])[:-1], -ZERO]
    room = max_bin - 1 - len(bounds)
    if high == len(values) or room <= 0:
        return [*bounds, math.inf]
    return [*bounds, ZERO, *even_bounds(values[high:], counts[high:], room, min_data_in_bin, lows[high:])]


def bounds_around(values: np.ndarray, counts: np.ndarray, max_bin: int, min_data_in_bin: int, forced: list[float], lows: np.ndarray | None = None) -> list[float]:
    """Zero's bounds and the forced ones; the bins that are left go to the stretches between them by row counts, the last stretch taking
    what rounding leaves."""
    lows = values if lows is None else lows
    own = [b for b, there in ((-ZERO, values[0] <= -ZERO), (ZERO, values[-1] > ZERO)) if there][: max_bin - 1]
    given = [b for b in forced if abs(b) > ZERO]
    fixed = np.unique([*own, *given[: max_bin - 1 - len(own)]])
    cuts = np.r_[0, np.searchsorted(values, fixed), len(values)]
    spare = left = max_bin - 1 - len(fixed)
    inner: list[float] = []
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        share = left if i == len(fixed) else min(left, round(int(counts[a:b].sum()) * spare / int(counts.sum())))
        if a < b and share > 0:
            found = even_bounds(values[a:b], counts[a:b], share + 1, min_data_in_bin, lows[a:b])[:-1]
            inner += found
            left -= len(found)
    return [*np.unique([*fixed, *inner]).tolist(), math.inf]


def numeric_mapper(name: str, values: list[float], counts: list[int], missing_rows: int, max_bin: int = 255, min_data_in_bin: int = 3, use_missing: bool = True, zero_as_missing: bool = False, forced: list[float] | None = None, lows: list[float] | None = None) -> BinMapper:
    """A mapper from a feature's distinct values (ascending) and counts; ``missing_rows`` are the rows without a value. ``lows``: the least values of runs that
    ``values`` are the largest of."""
    missing = NONE if not use_missing else ZERO_MISSING if zero_as_missing else NAN if missing_rows else NONE
    v, n, low = merge_close(np.asarray(values, float), np.asarray(counts, np.int64), None if lows is None else np.asarray(lows, float))
    if missing_rows and missing != NAN:
        at = int(np.searchsorted(v, 0.0))
        if at < len(v) and v[at] == 0.0:
            n = n.copy()
            n[at] += missing_rows
        else:
            v, n, low = np.insert(v, at, 0.0), np.insert(n, at, missing_rows), np.insert(low, at, 0.0)
    if not len(v):
        return BinMapper(name, [math.inf], missing=missing)
    upper = zero_bin_bounds(v, n, max_bin - (missing == NAN), min_data_in_bin, forced, low)
    if missing == ZERO_MISSING and len(upper) == 2:
        missing = NONE
    mapper = BinMapper(name, upper, missing=missing, low=float(low[0]), high=float(v[-1]))
    held = np.bincount(np.searchsorted(upper, v), n, mapper.num_bin).astype(np.int64)
    if missing == NAN:
        held[-1] = missing_rows
    return _finish(mapper, held.tolist(), int(held.sum()))


def _finish(mapper: BinMapper, held: list[int], total: int) -> BinMapper:
    mapper.counts = held
    mapper.default_bin = mapper.bin(0.0)
    top = max(range(len(held)), key=lambda i: (held[i], -i))
    # a frequent bin stands for the sparse default only if it holds enough rows
    if top != mapper.default_bin and total and held[top] / total < 0.7:
        top = mapper.default_bin
    mapper.most_frequent, mapper.sparse_rate = top, held[top] / total if total else 0.0
    return mapper


def categorical_mapper(name: str, values: list[float], counts: list[int], missing_rows: int, max_bin: int = 255, min_data_in_bin: int = 3) -> BinMapper:
    """Categories by count, the larger first, then the smaller value, until 99 % of the rows or ``max_bin``; rare ones after the
    first two end it. Negative and missing values belong to bin 0."""
    sums: dict[int, int] = {}
    other = missing_rows
    for v, c in zip(values, counts, strict=True):
        code = int(v)
        if code < 0:
            other += c
        else:
            sums[code] = sums.get(code, 0) + c
    order = sorted(sums.items(), key=lambda x: (-x[1], x[0]))
    total = sum(sums.values())
    enough, used, kept = round(total * 0.99), 0, []
    for code, n in order:
        if (used >= enough and kept) or len(kept) + 1 >= max_bin or (n < min_data_in_bin and len(kept) > 1):
            break
        kept.append(code)
        used += n
    held = [other + total - used, *(sums[c] for c in kept)]
    return _finish(BinMapper(name, categories=kept, categorical=True, missing=NAN if len(kept) < len(sums) or other else NONE), held, total + other)


def needs_filter(mapper: BinMapper, least: int) -> bool:
    """Whether no split of the feature leaves ``least`` rows on both sides."""
    total = sum(mapper.counts)
    if mapper.categorical:
        return len(mapper.counts) <= 2 and not any(c >= least and total - c >= least for c in mapper.counts)
    upto = 0
    for c in mapper.counts[:-1]:
        upto += c
        if upto >= least and total - upto >= least:
            return False
    return True


def fit(
    df: DataFrame,
    features: list[str],
    categorical: list[str] | None = None,
    max_bin: int = 255,
    min_data_in_bin: int = 3,
    use_missing: bool = True,
    zero_as_missing: bool = False,
    max_bin_by_feature: list[int] | None = None,
    forced: dict[str, list[float]] | None = None,
    sample: int | None = None,
    key: str = "row_id",
    seed: int = 1,
    max_distinct: int = MAX_DISTINCT,
    rows: int | None = None,
) -> list[BinMapper]:
    """Mappers of all features from one counting job. ``sample``: bin from so many rows at most; ``rows``: the number of rows, if known."""
    if sample is not None:
        df = row_sample(df, sample, key, seed, rows)
    bins = max_bin_by_feature or [max_bin] * len(features)
    most = max(max_distinct, 4 * max(bins))
    cats = {i for i, f in enumerate(features) if f in (categorical or [])}
    with scratch(df.sparkSession):
        return fit_counts(distinct_counts(df, features).persist(), features, cats, bins, min_data_in_bin, use_missing, zero_as_missing, forced or {}, most)


def fit_counts(counts: DataFrame, features: list[str], cats: set[int], bins: list[int], min_data_in_bin: int, use_missing: bool, zero_as_missing: bool, forced: dict[str, list[float]], most: int) -> list[BinMapper]:
    """Mappers from persisted counts (feature, value, n) of all features."""
    # one row a feature
    sizes = {r["feature"]: r for r in counts.groupBy("feature").agg(F.count("value").alias("distinct"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("missing")).collect()}
    wide = [i for i, r in sizes.items() if r["distinct"] > most]
    known = counts.where("value is not null").withColumn("low", F.col("value"))
    parts = [known.where(~F.col("feature").isin(wide)) if wide else known]
    if numbers := [i for i in wide if i not in cats]:
        parts.append(compress(known.where(F.col("feature").isin(numbers)), most).persist())
    if codes_ := [i for i in wide if i in cats]:
        parts.append(top_codes(known.where(F.col("feature").isin(codes_)), max(bins)).withColumn("low", F.col("value")).persist())
    out, at = [], 0
    while at < len(features):
        # as many features as have MAX_VALUES together, one at least
        upto, held = at + 1, _come(sizes, at, most)
        while upto < len(features) and held + _come(sizes, upto, most) <= MAX_VALUES:
            held, upto = held + _come(sizes, upto, most), upto + 1
        own = parts if upto - at == len(features) else [p.where(F.col("feature").between(at, upto - 1)) for p in parts]
        feature, value, n, low = _columns(own)
        order = np.lexsort((value, feature))
        feature, value, n, low = feature[order], value[order], n[order], low[order]
        edges = np.searchsorted(feature, np.arange(at, upto + 1))
        for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True), at):
            missing = sizes[i]["missing"] if i in sizes else 0
            if i in cats:
                out.append(categorical_mapper(features[i], value[a:b].tolist(), n[a:b].tolist(), missing, bins[i], min_data_in_bin))
            else:
                out.append(numeric_mapper(features[i], value[a:b], n[a:b], missing, bins[i], min_data_in_bin, use_missing, zero_as_missing, forced.get(features[i]), low[a:b]))
        at = upto
    for x in (counts, *parts[1:]):
        x.unpersist()
    return out


def _come(sizes: dict, feature: int, most: int) -> int:
    """How many of a feature's values come to the driver."""
    return min(sizes[feature]["distinct"], most + 1) if feature in sizes else 0


def _columns(parts: list[DataFrame]) -> list[np.ndarray]:
    """feature, value, n and low of tables of bounded size."""
    names = ("feature", "value", "n", "low")
    tables = [p.select(*names).toArrow() for p in parts]
    return [np.concatenate([np.asarray(t.column(c)) for t in tables]) for c in names]


# --- applying in Spark ------------------------------------------------------------------------------------------------


def bin_sql(mapper: BinMapper, column: str) -> str:
    """SQL for the bin of a column's value, a search through the bounds by halves: no join, and code of logarithmic depth."""
    v = f"CAST({column} AS DOUBLE)"
    missing = f"({v} IS NULL OR isnan({v}))"
    if mapper.categorical:
        if not mapper.categories:
            return "0"
        pairs = ", ".join(f"{int(c)}L, {i + 1}" for i, c in enumerate(mapper.categories))
        # truncation toward zero, as for categories elsewhere
        return f"CASE WHEN {missing} THEN 0 ELSE coalesce(try_element_at(map({pairs}), CAST({v} AS BIGINT)), 0) END"
    last = len(mapper.upper) - 1

    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        middle = (low + high) // 2
        return f"CASE WHEN {v} <= {mapper.upper[middle]!r}D THEN {search(low, middle)} ELSE {search(middle + 1, high)} END"

    found = search(0, last)
    if len(mapper.upper) > 64:
        bounds = ", ".join(f"{u!r}D" for u in mapper.upper[:-1])
        middle = "shiftright(s.a + s.b, 1)"
        step = f"CASE WHEN s.a >= s.b THEN s WHEN {v} <= array({bounds})[{middle}] THEN named_struct('a', s.a, 'b', {middle}) ELSE named_struct('a', {middle} + 1, 'b', s.b) END"
        found = f"aggregate(sequence(1, {last.bit_length() + 1}), named_struct('a', 0, 'b', {last}), (s, _) -> {step}, s -> s.a)"
    at_missing = mapper.num_bin - 1 if mapper.missing == NAN else mapper.bin(0.0)
    return f"CASE WHEN {missing} THEN {at_missing} ELSE {found} END"


def bin_column(mapper: BinMapper, column: str) -> Column:
    """``bin_sql`` of a column of that name."""
    return F.expr(bin_sql(mapper, f"`{column}`"))


def apply(df: DataFrame, mappers: list[BinMapper], keep: list[str]) -> DataFrame:
    """keep... and b0, b1, ...: one projection."""
    return df.select(*keep, *(bin_column(m, m.name).alias(f"b{i}") for i, m in enumerate(mappers)))


def is_identity(df: DataFrame, features: list[str]) -> bool:
    """Whether all values are whole numbers from 0 on, none missing, so that they serve as bins."""
    checks = [F.max(F.when(F.col(c).isNull() | F.isnan(F.col(c).cast("double")) | (F.col(c) < 0) | (F.col(c) != F.floor(c)), 1).otherwise(0)) for c in features]
    row = df.agg(*(x.alias(f"c{i}") for i, x in enumerate(checks))).first()
    return all(v == 0 for v in row)


def codes(df: DataFrame, column: str) -> DataFrame:
    """Codes of a string column: its values in order, from 0: (column, code). Null has no code."""
    values = df.where(F.col(column).isNotNull()).select(column).distinct().withColumn("_one", F.lit(1))
    return running(values, column, ["_one"]).select(column, F.col("before__one").cast("int").alias("code"))


def bound_table(df: DataFrame, mappers: list[BinMapper]) -> DataFrame:
    """feature, bin, upper (null for the last missing bin), category."""
    rows = []
    for i, m in enumerate(mappers):
        for b in range(m.num_bin):
            rows.append((i, b, m.upper[b] if not m.categorical and b < len(m.upper) else None, m.categories[b - 1] if m.categorical and b else None))
    return df.sparkSession.createDataFrame(rows, "feature int, bin int, upper double, category int")
