"""Histograms of several trees that grow over one binned table, and their split search, by one job.

A row is counted for every *slot*: a tree with gradients of its own (a class, a fold), of whose leaves some are wanted. A task routes the rows of
a batch down each slot's tree and adds them up in tables that it keeps, so it sends each (leaf, column, bin) once, however many rows it has.

Columns: bins of a feature, or of a bundle of features, one small whole number a row; and, beside them, *sparse* features, of which a row has only
those that aren't at their common bin, as two arrays. Sums of a common bin are what the leaf's totals leave.

Where all sums are few, the driver takes them and searches; where they would be many, they are reduced and searched on the executors, block by block of columns, and one row
for each leaf and block comes back.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.operators import scan
from thicket.operators.scan import Dense
from thicket.operators.split import Feature, SplitParams

#: Sums of single tasks that the driver adds up itself; beyond it a shuffle does.
DIRECT_SUMS = 200_000
#: Sums that a search hands to the driver; beyond it executors search.
DRIVER_SUMS = 4_000_000
#: Columns of a block, which one group reduces and searches.
BLOCK = 256
#: Leaf keys of a slot.
KEYS = 1 << 16
#: Entries of sparse features that a task holds before it adds up equal ones.
HELD = 1 << 21


@dataclass
class Stored:
    """A stored column: a feature's bins, or a bundle of features. decode: by feature, the bin that each value of the column stands for."""

    name: str
    decode: dict[int, np.ndarray]


@dataclass
class Slot:
    """A tree that grows. gradient: the place of its gradients in the arrays, None if they are plain columns; fold: rows of this fold
    don't count. plan: its tree as far as it has grown, a key or (column, which of its bins go left, left, right); wanted: keys to be counted; skip: columns
    that none of them needs."""

    gradient: int | None = None
    fold: int | None = None
    plan: Any = 0
    wanted: list[int] = field(default_factory=list)
    skip: frozenset[int] = frozenset()


@dataclass
class Context:
    """What the search of a leaf needs to know besides its sums."""

    totals: tuple[float, float, int]
    output: float
    lo: float
    hi: float
    depth: int
    only: frozenset[int] | None = None
    thresholds: dict[int, int] = field(default_factory=dict)
    costs: dict[int, float] = field(default_factory=dict)  # of features, besides those that they have everywhere

    def priced(self, features: list[Feature]) -> list[Feature]:
        return [replace(f, penalty=f.penalty + self.costs[f.index]) if f.index in self.costs else f for f in features] if self.costs else features


@dataclass
class Table:
    """The columns of a binned table that count. sparse: number of each sparse feature by its place in the rows' arrays, with its bins and common bin."""

    columns: list[Stored]
    features: list[Feature]
    sparse: dict[int, tuple[int, int]] = field(default_factory=dict)  # feature: (bins, common bin)
    arrays: tuple[str, str] | None = None

    @property
    def cells(self) -> int:
        return sum(len(next(iter(c.decode.values()))) for c in self.columns) + sum(n for n, _ in self.sparse.values())

    def place(self, feature: int) -> int:
        """Of a feature's column: from 0 on, or -1 - feature of a sparse one."""
        return -1 - feature if feature in self.sparse else next(i for i, c in enumerate(self.columns) if feature in c.decode)


class Rows:
    """The bins of a batch of rows."""

    def __init__(self, n: int, columns: list[np.ndarray], starts: np.ndarray | None = None, ids: np.ndarray | None = None, bins: np.ndarray | None = None, common: dict[int, int] | None = None) -> None:
        self.n, self.columns, self.common = n, columns, common or {}
        if ids is not None:
            self.owner = np.repeat(np.arange(n), np.diff(starts))
            self.ids, self.values = ids, bins
            self.order = None

    def of(self, place: int, rows: np.ndarray) -> np.ndarray:
        if place >= 0:
            return self.columns[place][rows]
        if self.order is None:
            self.order = np.argsort(self.ids, kind="stable")
            self.sorted = self.ids[self.order]
        feature = -1 - place
        mine = self.order[np.searchsorted(self.sorted, feature) : np.searchsorted(self.sorted, feature, "right")]
        out = np.full(self.n, self.common[feature])
        out[self.owner[mine]] = self.values[mine]
        return out[rows]


def route(plan: Any, wanted: list[int], rows: Rows) -> np.ndarray:
    """Leaf of each row, -1 outside of ``wanted``."""
    out = np.full(rows.n, -1)

    def go(at: Any, mine: np.ndarray) -> None:
        if isinstance(at, int):
            if at in wanted:
                out[mine] = at
        elif len(mine):
            place, table, a, b = at
            left = table[rows.of(place, mine)]
            go(a, mine[left])
            go(b, mine[~left])

    go(plan, np.arange(rows.n))
    return out


class _Tables:
    """Sums of a task: of columns a table for each leaf, of sparse features sorted codes with their sums."""

    def __init__(self, width: int) -> None:
        self.width, self.tables = width, {}
        self.codes: list[np.ndarray] = []
        self.sums: list[np.ndarray] = []

    def add(self, base: int, leaves: np.ndarray, g: np.ndarray, h: np.ndarray, rows: Rows, offsets: np.ndarray | None, skip: frozenset[int]) -> None:
        mine = np.flatnonzero(leaves >= 0)
        if not len(mine):
            return
        every, place = np.unique(leaves[mine], return_inverse=True)
        gs, hs = g[mine], h[mine]
        for f, column in enumerate(rows.columns):
            if f in skip:
                continue
            b = column[mine]
            size = int(b.max()) + 1
            code, n = place * size + b, len(every) * size
            new = np.stack([np.bincount(code, gs, n), np.bincount(code, hs, n), np.bincount(code, minlength=n)]).reshape(3, len(every), size)
            for i, one in enumerate(every.tolist()):
                old = self.tables.get((base + one, f))
                if old is None or old.shape[1] < size:
                    wide = np.zeros((3, size))
                    if old is not None:
                        wide[:, : old.shape[1]] = old
                    old = self.tables[base + one, f] = wide
                old[:, :size] += new[:, i]
        if offsets is not None and len(rows.ids):
            own = np.flatnonzero(leaves[rows.owner] >= 0)
            at = rows.owner[own]
            code = (leaves[at].astype(np.int64) + base) * offsets[-1] + offsets[rows.ids[own]] + rows.values[own]
            codes, inverse = np.unique(code, return_inverse=True)
            self.codes.append(codes)
            self.sums.append(np.stack([np.bincount(inverse, x, len(codes)) for x in (g[at], h[at], np.ones(len(at)))]))
            if sum(map(len, self.codes)) > HELD:
                self.settle()

    def settle(self) -> None:
        if len(self.codes) > 1:
            codes, inverse = np.unique(np.concatenate(self.codes), return_inverse=True)
            sums = np.concatenate(self.sums, axis=1)
            self.codes, self.sums = [codes], [np.stack([np.bincount(inverse, x, len(codes)) for x in sums])]

    def rows(self, offsets: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        names = ["leaf", "place", "bin", "g", "h", "n"]
        make = lambda leaf, place, bin_, s: pa.RecordBatch.from_arrays([pa.array(x.astype(np.int32)) for x in (leaf, place, bin_)] + [pa.array(s[0]), pa.array(s[1]), pa.array(s[2].astype(np.int64))], names)
        for (leaf, f), table in self.tables.items():
            at = np.flatnonzero(table[2])
            yield make(np.full(len(at), leaf), np.full(len(at), f), at, table[:, at])
        self.settle()
        if self.codes:
            leaf, rest = np.divmod(self.codes[0], offsets[-1])
            feature = np.searchsorted(offsets, rest, "right") - 1
            yield make(leaf, feature + self.width, rest - offsets[feature], self.sums[0])


def parts(df: DataFrame, table: Table, slots: list[Slot]) -> DataFrame:
    """leaf (slot * KEYS + key), place (of the column; beyond them, of the sparse feature), bin, g, h, n: the sums of single tasks."""
    names, width = [c.name for c in table.columns], len(table.columns)
    arrays, single, folds = table.arrays, slots[0].gradient is None, any(s.fold is not None for s in slots)
    offsets = None
    if arrays:
        sizes = np.zeros(max(table.sparse, default=-1) + 1, np.int64)
        for f, (n, _) in table.sparse.items():
            sizes[f] = n
        offsets = np.concatenate([[0], np.cumsum(sizes)])
    shared = df.sparkSession.sparkContext.broadcast((slots, offsets, {f: c for f, (_, c) in table.sparse.items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots, offsets, common = shared.value
        kept = _Tables(width)
        for batch in batches:
            n = len(batch)
            columns = [np.asarray(batch.column(2 + i)).astype(np.int64) for i in range(width)]
            at = 2 + width
            rows = Rows(n, columns)
            if offsets is not None:
                ids, bins = batch.column(at), batch.column(at + 1)
                starts = np.asarray(ids.offsets).astype(np.int64)
                flat = np.asarray(ids.values).astype(np.int64)[starts[0] : starts[-1]], np.asarray(bins.values).astype(np.int64)[bins.offsets[0].as_py() : bins.offsets[-1].as_py()]
                known = (flat[0] < len(offsets) - 1) & (np.diff(offsets)[np.minimum(flat[0], len(offsets) - 2)] > 0)  # of features that count
                rows = Rows(n, columns, np.concatenate([[0], np.cumsum(known)])[starts - starts[0]], flat[0][known], flat[1][known], common)
                at += 2
            dealt = np.asarray(batch.column(at)) if folds else None
            grads = [np.asarray(batch.column(i) if single else batch.column(i).flatten(), float).reshape(n, -1) for i in (0, 1)]
            for s, slot in enumerate(slots):
                leaves = route(slot.plan, slot.wanted, rows)
                if slot.fold is not None:
                    leaves = np.where(dealt == slot.fold, -1, leaves)
                kept.add(s * KEYS, leaves, grads[0][:, slot.gradient or 0], grads[1][:, slot.gradient or 0], rows, offsets, slot.skip)
        yield from kept.rows(offsets)

    kind = "DOUBLE" if single else "ARRAY<DOUBLE>"
    inputs = df.selectExpr(f"CAST(grad AS {kind}) AS g", f"CAST(hess AS {kind}) AS h", *(f"CAST(`{c}` AS INT) AS `{c}`" for c in names), *([f"`{c}`" for c in arrays] if arrays else []), *(["CAST(_fold AS INT) AS _fold"] if folds else []))
    return inputs.mapInArrow(run, "leaf int, place int, bin int, g double, h double, n long")


def assemble(leaf: np.ndarray, place: np.ndarray, bin_: np.ndarray, sums: list[np.ndarray], table: Table, features: list[Feature], totals: dict[int, tuple[float, float, int]]) -> dict[int, Dense]:
    """Dense sums by leaf, of ``features``, from rows of ``parts`` (in any number for a cell)."""
    keys, at = sorted(totals), {f.index: i for i, f in enumerate(features)}
    bins, width = max((f.num_bin for f in features), default=1), len(table.columns)
    shape = len(keys), len(features), bins
    plain = np.full(width + max(table.sparse, default=-1) + 1, -1)  # position of the only feature of a column
    for i, c in enumerate(table.columns):
        if len(c.decode) == 1 and c.name.startswith("b"):
            plain[i] = at.get(next(iter(c.decode)), -1)
    for f in table.sparse:
        plain[width + f] = at.get(f, -1)
    spot = np.searchsorted(keys, leaf)
    size = int(np.prod(shape))
    good = np.flatnonzero(plain[place] >= 0)
    code = (spot[good] * shape[1] + plain[place[good]]) * bins + bin_[good]
    flat = [np.bincount(code, x[good], size).reshape(shape) for x in sums]
    for i, c in enumerate(table.columns):
        if plain[i] >= 0 or not any(f in at for f in c.decode):
            continue
        mine = np.flatnonzero(place == i)
        for f, decode in c.decode.items():
            if f in at:
                for out, x in zip(flat, sums, strict=True):
                    np.add.at(out, (spot[mine], at[f], decode[bin_[mine]]), x[mine])
    own = [(at[f], common) for f, (_, common) in table.sparse.items() if f in at]
    if own:
        rows, common = np.array([x[0] for x in own]), np.array([x[1] for x in own])
        for j, out in enumerate(flat):
            whole = np.array([totals[k][j] for k in keys], float)[:, None]
            out[:, rows, common] += whole - out[:, rows].sum(2)
    return {k: Dense(flat[0][i], flat[1][i], np.rint(flat[2][i]).astype(np.int64)) for i, k in enumerate(keys)}


def reduced(sums: DataFrame) -> DataFrame:
    return sums.groupBy("leaf", "place", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))


def histograms(df: DataFrame, table: Table, slots: list[Slot], totals: dict[int, tuple[float, float, int]], tasks: int | None) -> dict[int, Dense]:
    """Dense sums of the wanted leaves (slot * KEYS + key) on the driver. ``tasks``: partitions of ``df``, if known."""
    wanted = sum(len(s.wanted) for s in slots)
    sums = parts(df, table, slots)
    few = tasks is not None and tasks * wanted * table.cells <= DIRECT_SUMS
    found = (sums if few else reduced(sums)).toArrow()
    cells = {c: np.asarray(found.column(c)) for c in found.column_names}
    return assemble(cells["leaf"], cells["place"], cells["bin"], [cells[c].astype(float) for c in "ghn"], table, table.features, totals)


def leaf_sums(df: DataFrame, slots: list[Slot]) -> list[tuple[float, float, int]]:
    """g, h and rows of each slot's whole tree: one aggregation."""
    out = []
    for i, s in enumerate(slots):
        g, h = (F.col(c) if s.gradient is None else F.col(c)[s.gradient] for c in ("grad", "hess"))
        counts = F.lit(True) if s.fold is None else F.col("_fold") != s.fold
        out += [F.sum(F.when(counts, g)).alias(f"g{i}"), F.sum(F.when(counts, h)).alias(f"h{i}"), F.count_if(counts).alias(f"n{i}")]
    r = df.agg(*out).first()
    return [(r[f"g{i}"] or 0.0, r[f"h{i}"] or 0.0, r[f"n{i}"]) for i in range(len(slots))]


def unpaid(df: DataFrame, table: Table, slots: list[Slot], features: list[int]) -> dict[int, np.ndarray]:
    """Of the wanted leaves, how many rows haven't paid for each of ``features`` yet, by the bits of ``_paid`` (bit i of word i // 63: the i-th of ``features``). A
    row a leaf and task comes to the driver."""
    names, width, arrays = [c.name for c in table.columns], len(table.columns), table.arrays
    if arrays or any(s.fold is not None for s in slots):
        raise ValueError("costs a row need columns and a training of its own")
    shared = df.sparkSession.sparkContext.broadcast(slots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}
        for batch in batches:
            rows = Rows(len(batch), [np.asarray(batch.column(1 + i)).astype(np.int64) for i in range(width)])
            words = np.asarray(batch.column(0).flatten()).reshape(len(batch), -1)
            free = np.stack([words[:, i // 63] >> (i % 63) & 1 == 0 for i in range(len(features))], 1) if len(batch) else np.zeros((0, len(features)), bool)
            for s, slot in enumerate(shared.value):
                leaves = route(slot.plan, slot.wanted, rows)
                for leaf in np.unique(leaves[leaves >= 0]).tolist():
                    kept[s * KEYS + leaf] = kept.get(s * KEYS + leaf, 0) + free[leaves == leaf].sum(0)
        lists = pa.array([x.tolist() for x in kept.values()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.int32()), lists], ["leaf", "n"])

    out = {i * KEYS + k: np.zeros(len(features), np.int64) for i, s in enumerate(slots) for k in s.wanted}
    for r in df.selectExpr("_paid", *(f"CAST(`{c}` AS INT) AS `{c}`" for c in names)).mapInArrow(run, "leaf int, n array<long>").collect():
        out[r["leaf"]] += np.array(r["n"], np.int64)
    return out


def best_splits(df: DataFrame, table: Table, slots: list[Slot], contexts: dict[int, Context], params: SplitParams) -> dict[int, tuple[dict[str, Any] | None, frozenset[int]]]:
    """Of each leaf in ``contexts`` the best split and the features that can't split it, searched on executors: sums meet by (leaf, block of columns), a group
    holds a block's cells, and a row a leaf and block comes to the driver."""
    spark = df.sparkSession
    sums = parts(df, table, slots).withColumn("block", F.floor(F.col("place") / BLOCK).cast("int"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # one shuffle: what is added up by (leaf, block, ...) lies as the search by (leaf, block) wants it
    sums = sums.repartition(n, "leaf", "block").groupBy("leaf", "block", "place", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast((table, contexts, params))

    def search(group: pa.Table) -> pa.Table:
        table, contexts, params = shared.value
        leaf, block, width = group.column("leaf")[0].as_py(), group.column("block")[0].as_py(), len(table.columns)
        place = np.asarray(group.column("place"))
        inside = {f for i in np.unique(place).tolist() for f in (table.columns[i].decode if i < width else (i - width,))}
        features = [f for f in table.features if f.index in inside]
        x = contexts[leaf]
        row, dead = None, frozenset()
        if features:
            columns = [c if i // BLOCK == block else Stored("", {}) for i, c in enumerate(table.columns)]
            own = Table(columns, features, {f: v for f, v in table.sparse.items() if f in inside})
            dense = assemble(np.asarray(group.column("leaf")), place, np.asarray(group.column("bin")), [np.asarray(group.column(c)).astype(float) for c in "ghn"], own, features, {leaf: x.totals})[leaf]
            row, dead = scan.search(dense, x.priced(features), params, x.output, x.lo, x.hi, x.depth, x.thresholds, x.only)
        return pa.table([pa.array([leaf], pa.int32()), pa.array([pickle.dumps((row, sorted(dead)))], pa.binary())], ["leaf", "found"])

    rows = sums.groupBy("leaf", "block").applyInArrow(search, "leaf int, found binary").collect()  # a row a leaf and block
    out: dict[int, tuple[dict[str, Any] | None, frozenset[int]]] = dict.fromkeys(contexts, (None, frozenset()))
    for r in rows:
        row, dead = pickle.loads(bytes(r["found"]))
        best, gone = out[r["leaf"]]
        if row is not None and (best is None or scan.order(row) < scan.order(best)):
            best = row
        out[r["leaf"]] = best, gone | frozenset(dead)
    return out
