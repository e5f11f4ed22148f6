"""Exclusive feature bundling: features that are rarely away from their default bin together share one column.

What features have in common is read off bitmaps: a bit a feature and sampled row, ``SAMPLE`` rows at most, packed in tasks. Features x SAMPLE / 8 bytes come to the driver, however
large the table, and the features are dealt out there: a bundle's bitmap is the union of its features', and the conflicts of a feature are the bits that both have.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators.binning import BinMapper


@dataclass
class Bundle:
    """features and the first bin of each in the shared column; bin 0 means that all are at their default."""

    features: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    num_bin: int = 1


def conflicts(df: DataFrame, mappers: list[BinMapper]) -> DataFrame:
    """a, b, n: in how many rows features a <= b are both away from their most frequent bin; a = b: how often a is. One
    aggregation over the pairs present in a row; dense features, which can't be bundled, are left out."""
    sparse = [i for i, m in enumerate(mappers) if m.sparse_rate >= 0.5]
    own = F.filter(F.array(*(F.when(F.col(f"b{i}") != mappers[i].most_frequent, F.lit(i)) for i in sparse)), lambda x: x.isNotNull()) if sparse else F.array().cast("array<int>")
    rows = df.select(own.alias("s"))
    pairs = rows.select(F.explode(F.expr("flatten(transform(s, a -> transform(filter(s, b -> b >= a), b -> struct(a AS a, b AS b))))")).alias("p"))
    return pairs.groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n"))


#: Rows whose bitmaps say which features go together, and bundles that a feature is tried in.
SAMPLE, TRIED = 100_000, 100


def presence(df: DataFrame, mappers: list[BinMapper], features: list[int]) -> np.ndarray:
    """A row of 64-bit words for each of ``features``: a bit for each row of ``df`` (b0, b1, ...) in which it isn't at its most frequent bin."""
    common = np.array([mappers[i].most_frequent for i in features])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away = np.stack([np.asarray(batch.column(i)) for i in range(len(common))]) != common[:, None]
            bits = np.packbits(away, axis=1)
            yield pa.RecordBatch.from_arrays([pa.array([bits.tobytes()], pa.binary()), pa.array([bits.shape[1]], pa.int32())], ["bits", "width"])

    got = df.select(*(F.col(f"b{i}").cast("int").alias(f"b{i}") for i in features)).mapInArrow(run, "bits binary, width int").collect()  # SAMPLE bits a feature
    parts = [np.frombuffer(bytes(r["bits"]), np.uint8).reshape(len(features), r["width"]) for r in got if r["width"]]
    bits = np.concatenate(parts, axis=1) if parts else np.zeros((len(features), 0), np.uint8)
    return np.pad(bits, ((0, 0), (0, -bits.shape[1] % 8))).view(np.uint64)


def deal(bits: np.ndarray, order: list[int], sizes: list[int], budget: int, max_bins: int) -> list[list[int]]:
    """Puts features, in this order, each into the latest bundle that it has least in common with, if conflicts stay within ``budget`` a bundle and bins within
    ``max_bins``; else into one of its own. ``sizes``: bins that each adds."""
    bundles: list[list[int]] = []
    union = np.zeros_like(bits)
    spent, room = np.zeros(len(bits), np.int64), np.full(len(bits), max_bins - 1)
    for i in order:
        near = np.flatnonzero(room[: len(bundles)] >= sizes[i])[::-1][:TRIED]
        both = np.bitwise_count(union[near] & bits[i]).sum(1, dtype=np.int64)
        good = np.flatnonzero(spent[near] + both <= budget)
        if len(good):
            at = int(near[good[np.argmin(both[good])]])
            spent[at] += both[good].min()
        else:
            at = len(bundles)
            bundles.append([])
        bundles[at].append(i)
        union[at] |= bits[i]
        room[at] -= sizes[i]
    return bundles


def find_bundles(df: DataFrame, mappers: list[BinMapper], rate: float = 1e-4, max_bins: int = 256, sample: int = SAMPLE, key: str | None = None) -> list[Bundle]:
    """Bundles of features whose conflicts stay within ``rate`` of the sampled rows: features are dealt out as they come and the fullest first, and the order that
    gives fewer bundles holds. Dense features stay alone. ``key``: a column by whose hashes rows are sampled."""
    own = [i for i, m in enumerate(mappers) if m.sparse_rate >= 0.5]
    groups: list[list[int]] = [[i] for i, m in enumerate(mappers) if m.sparse_rate < 0.5]
    if own:
        n = df.count()
        if n > sample:
            hashed = F.xxhash64(F.col(key) if key else F.monotonically_increasing_id(), F.lit(11))
            df = df.where(hashed.bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52) < sample / n)
        bits = presence(df, mappers, own)
        budget, sizes = int(min(n, sample) * rate), [mappers[i].num_bin - 1 for i in own]
        full = np.bitwise_count(bits).sum(1, dtype=np.int64)
        orders = list(range(len(own))), sorted(range(len(own)), key=lambda i: -full[i])
        groups += [[own[i] for i in g] for g in min((deal(bits, o, sizes, budget, max_bins) for o in orders), key=len)]
    out = []
    for g in sorted(groups, key=min):
        b = Bundle()
        for i in sorted(g):
            b.features.append(i)
            b.offsets.append(b.num_bin)
            b.num_bin += mappers[i].num_bin - 1
        out.append(b)
    return out


def bundle_column(b: Bundle, mappers: list[BinMapper]) -> Column:
    """The shared column: of conflicting features the last one counts."""
    out = F.lit(0)
    for i, offset in zip(b.features, b.offsets, strict=True):
        bin_, common = F.col(f"b{i}"), mappers[i].most_frequent
        place = F.when(bin_ < common, bin_ + offset).otherwise(bin_ + offset - 1)
        out = F.when(bin_ != common, place).otherwise(out)
    return out.cast("int")


def unbundle(column: Column, b: Bundle, feature: int, mappers: list[BinMapper]) -> Column:
    """A feature's bin from the shared column."""
    at, m = b.features.index(feature), mappers[feature]
    low = b.offsets[at]
    inside = (column >= low) & (column < low + m.num_bin - 1)
    place = column - low
    return F.when(inside, F.when(place < m.most_frequent, place).otherwise(place + 1)).otherwise(m.most_frequent).cast("int")
