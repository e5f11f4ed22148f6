"""Leaf-wise growth of trees over a binned table.

The split of one leaf doesn't change what others would gain, so several leaves are searched by one job: when the best leaf's children aren't
known yet, the children of all leaves that may still be split are. The tree is then picked leaf by leaf, in order of gain, as if
each had been searched alone; a tree of 31 leaves takes about as many jobs as it has levels. Rows find their leaf by their bins, so nothing is rewritten within a tree.

Several trees (of all classes, of all folds) grow in step: each says what it has to know next, and one job answers all of them. Where a search's sums
are few, the driver keeps them: the larger child's are its parent's less its sibling's. Where they would be many, both children are counted and searched on
executors. A feature that can't split a leaf, as it would leave too few rows, isn't searched below it, nor counted where no other leaf needs it.
"""

from __future__ import annotations

import random
from collections.abc import Generator
from dataclasses import dataclass, field, replace
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.operators import counting, scan
from thicket.operators.binning import BinMapper
from thicket.operators.bundling import Bundle
from thicket.operators.counting import KEYS, Context, Slot, Stored, Table
from thicket.operators.scan import Dense
from thicket.operators.split import Feature, SplitParams
from thicket.plans.model import Leaf, Node, Tree


@dataclass
class GrowParams:
    num_leaves: int = 31
    max_depth: int = -1
    split: SplitParams = field(default_factory=SplitParams)
    feature_fraction_bynode: float = 1.0
    interaction: list[set[int]] = field(default_factory=list)
    extra_trees: bool = False
    extra_seed: int = 6
    forced: dict[str, Any] | None = None
    cegb_coupled: list[float] = field(default_factory=list)
    cegb_tradeoff: float = 1.0
    cegb_lazy: dict[int, float] = field(default_factory=dict)  # cost a row of features that the row hasn't been asked for before


@dataclass
class _Leaf:
    """A leaf of the tree as far as it has grown. row: its best split."""

    key: int
    depth: int
    g: float
    h: float
    n: int
    output: float
    lo: float = float("-inf")
    hi: float = float("inf")
    path: frozenset[int] = frozenset()
    row: Any = None
    children: tuple[_Leaf, _Leaf] | None = None
    dead: frozenset[int] = frozenset()  # features that can't split it


def bin_sql(row: Any, features: dict[int, Feature]) -> str:
    """SQL for whether a row of bins goes left. features: by number."""
    f = features[row["feature"]]
    b, default = f.column or f"b{f.index}", str(bool(row["default_left"])).upper() if row["cats"] is None else ""
    if row["cats"] is not None:
        return f"{b} IN ({', '.join(map(str, row['cats']))})"
    left = f"{b} <= {row['threshold']}"
    if f.missing == "nan" and f.num_bin > 2:
        return f"CASE WHEN {b} = {f.num_bin - 1} THEN {default} ELSE {left} END"
    if f.missing == "zero" and f.num_bin > 2:
        return f"CASE WHEN {b} = {f.default_bin} THEN {default} ELSE {left} END"
    return left


def bin_test(row: Any, features: dict[int, Feature]) -> Column:
    return F.expr(bin_sql(row, features))


def stored_columns(features: list[Feature], bundles: list[Bundle], mappers: list[BinMapper]) -> list[Stored]:
    """The columns that hold these features."""
    wanted = {f.index: f for f in features}
    out, bundled = [], set()
    for j, bundle in enumerate(bundles):
        own = {}
        for i, offset in zip(bundle.features, bundle.offsets, strict=True):
            if i in wanted:
                # the values of other features mean that this one is at its most frequent bin
                own[i] = table = np.full(bundle.num_bin, mappers[i].most_frequent)
                rest = np.delete(np.arange(mappers[i].num_bin), mappers[i].most_frequent)
                table[offset : offset + len(rest)] = rest
        bundled |= set(bundle.features)
        if own:
            out.append(Stored(f"e{j}", own))
    return [*(Stored(f"b{f.index}", {f.index: np.arange(f.num_bin)}) for f in features if f.index not in bundled), *out]


def _plan(leaf: _Leaf, table: Table, features: dict[int, Feature]) -> Any:
    """The tree below a leaf as far as it has grown: a key, or (place of the column, whether each of its values goes left, left, right)."""
    if leaf.children is None:
        return leaf.key
    f, r = features[leaf.row["feature"]], leaf.row
    if r["cats"] is not None:
        left = np.isin(np.arange(f.num_bin), list(r["cats"]))
    else:
        left = np.arange(f.num_bin) <= r["threshold"]
        if f.num_bin > 2 and f.missing in ("nan", "zero"):
            left[f.num_bin - 1 if f.missing == "nan" else f.default_bin] = bool(r["default_left"])
    place = table.place(f.index)
    return place, left if place < 0 else left[table.columns[place].decode[f.index]], *(_plan(c, table, features) for c in leaf.children)


@dataclass
class Request:
    """What a tree has to know next: leaves to be searched, of pairs of children the smaller first; parents by pair."""

    plan: Any
    fresh: list[_Leaf]
    pairs: list[tuple[_Leaf, _Leaf, _Leaf]]
    contexts: dict[int, Context]
    features: list[Feature]


class Searcher:
    """Answers the requests of trees over one table by one job. ``df``: the stored columns, grad, hess (arrays, if slots have places in them) and _fold."""

    def __init__(self, df: DataFrame, table: Table, slots: list[Slot], params: SplitParams, leaves: int, parts: int | None = None, wide: bool | None = None, lazy: dict[int, float] | None = None) -> None:
        """``lazy``: costs a row of features, to be paid once a row; ``df`` has the bits of what is paid in _paid."""
        self.lazy = lazy or {}
        self.df, self.table, self.slots, self.p, self.parts = df, table, slots, params, parts
        most = max((f.num_bin for f in table.features), default=1) * len(table.features)
        self.wide = most * leaves * len(slots) > counting.DRIVER_SUMS if wide is None else wide
        self.hists: dict[int, Dense] = {}
        self.jobs = 0

    def answer(self, requests: dict[int, Request]) -> None:
        """Gives every leaf of the requests its best split, and roots their totals."""
        slots, contexts = [], {}
        for i, slot in enumerate(self.slots):
            r = requests.get(i)
            wanted = [] if r is None else [x.key for x in r.fresh if x.key in r.contexts] if self.wide or not r.pairs else [few.key for _, few, _ in r.pairs]
            skip = frozenset()
            if r is not None:
                dead = frozenset.intersection(*(x.dead for x in r.fresh))
                skip = frozenset(j for j, c in enumerate(self.table.columns) if dead.issuperset(c.decode))
            slots.append(replace(slot, plan=r.plan if r else 0, wanted=wanted, skip=skip))
        roots = [i for i, r in requests.items() if not r.pairs]
        if roots and (self.wide or self.table.sparse):  # all sums' totals are needed first
            self.jobs += 1
            for i, sums in zip(roots, counting.leaf_sums(self.df, [self.slots[i] for i in roots]), strict=True):
                self._total(requests[i], sums)
        if self.lazy:
            self._costs(requests)
        self.jobs += 1
        totals = {i * KEYS + x.key: (x.g, x.h, x.n) for i, r in requests.items() for x in r.fresh if x.key in slots[i].wanted}
        if self.wide:
            contexts = {i * KEYS + k: c for i, r in requests.items() for k, c in r.contexts.items()}
            # the features that a tree's own state makes dearer are the same for all slots of a round
            table = replace(self.table, features=next(iter(requests.values())).features)
            found = counting.best_splits(self.df, table, slots, contexts, self.p)
            for i, r in requests.items():
                for x in r.fresh:
                    if x.key in r.contexts:
                        x.row, dead = found[i * KEYS + x.key]
                        x.dead |= dead
            return
        found = counting.histograms(self.df, self.table, slots, totals, self.parts)
        for i, r in requests.items():
            base = i * KEYS
            if not r.pairs:
                own = self.hists[base] = found[base]
                if not self.table.sparse:
                    # every row has a bin of the first feature, so its histogram gives the totals too
                    self._total(r, (float(own.g[0].sum()), float(own.h[0].sum()), int(own.n[0].sum())))
            for parent, few, rest in r.pairs:
                self.hists[base + few.key] = found[base + few.key]
                self.hists[base + rest.key] = self.hists.pop(base + parent.key).less(found[base + few.key])
            for x in r.fresh:
                if (c := r.contexts.get(x.key)) is not None:
                    x.row, dead = scan.search(self.hists[base + x.key], c.priced(r.features), self.p, c.output, c.lo, c.hi, c.depth, c.thresholds, c.only)
                    x.dead |= dead

    def _costs(self, requests: dict[int, Request]) -> None:
        """What features cost in each leaf: its rows that haven't paid for them, neither in trees before nor on the way to the leaf."""
        self.jobs += 1
        slots = [replace(s, plan=requests[i].plan, wanted=[x.key for x in requests[i].fresh if x.key in requests[i].contexts]) if i in requests else replace(s, wanted=[]) for i, s in enumerate(self.slots)]
        rows = counting.unpaid(self.df, self.table, slots, list(self.lazy))
        for i, r in requests.items():
            for x in r.fresh:
                if (c := r.contexts.get(x.key)) is not None:
                    c.costs = {f: cost * int(n) for (f, cost), n in zip(self.lazy.items(), rows[i * KEYS + x.key], strict=True) if f not in x.path}

    def _total(self, request: Request, sums: tuple[float, float, int]) -> None:
        root = request.fresh[0]
        root.g, root.h, root.n = sums
        root.output = output(sums[0], sums[1], self.p)
        if (c := request.contexts.get(root.key)) is not None:
            c.totals, c.output = sums, root.output

    def again(self, slot: int, x: _Leaf, features: list[Feature], thresholds: dict[int, int], only: frozenset[int], plan: Any) -> dict[str, Any] | None:
        """The best split of a leaf that has been searched, of some features and thresholds only."""
        c = Context((x.g, x.h, x.n), x.output, x.lo, x.hi, x.depth, only, thresholds)
        if not self.wide:
            return scan.best_split(self.hists[slot * KEYS + x.key], features, self.p, x.output, x.lo, x.hi, x.depth, thresholds, only)
        self.jobs += 1
        slots = [replace(s, plan=plan if i == slot else 0, wanted=[x.key] if i == slot else []) for i, s in enumerate(self.slots)]
        return counting.best_splits(self.df, replace(self.table, features=features), slots, {slot * KEYS + x.key: c}, self.p)[slot * KEYS + x.key][0]


def output(g: float, h: float, p: SplitParams) -> float:
    shrunk = max(abs(g) - p.lambda_l1, 0.0) * (-1 if g < 0 else 1)
    out = -shrunk / (h + p.lambda_l2) if h + p.lambda_l2 else 0.0
    return max(-p.max_delta_step, min(p.max_delta_step, out)) if p.max_delta_step > 0 else out


def grow_all(searcher: Searcher, growers: list[Grower]) -> list[tuple[Tree, str, _Leaf]]:
    """Grows all trees in step: each job answers what all that aren't done have to know next."""
    runs = {i: g.steps(searcher) for i, g in enumerate(growers)}
    done: dict[int, tuple[Tree, str, _Leaf]] = {}
    while runs:
        requests = {}
        for i, run in list(runs.items()):
            try:
                requests[i] = next(run)
            except StopIteration as end:
                done[i] = end.value
                del runs[i]
        if requests:
            searcher.answer(requests)
    return [done[i] for i in range(len(growers))]


class Grower:
    """Grows one tree, that of a searcher's slot."""

    def __init__(self, mappers: list[BinMapper], params: GrowParams, features: list[Feature], used: set[int], rng: random.Random, slot: int = 0, drawn: set[int] | None = None) -> None:
        """``features``: those of the searcher's table, in its order; ``drawn``: those of them that this tree may use."""
        self.drawn = drawn
        self.mappers, self.p, self.features, self.used, self.rng, self.slot = mappers, params, features, used, rng, slot
        self.keys = 0
        self.by_index = {f.index: f for f in features}

    def _request(self, searcher: Searcher, root: _Leaf, parents: list[_Leaf]) -> Request:
        """The parents' children, or the root, to be searched."""
        pairs: list[tuple[_Leaf, _Leaf, _Leaf]] = []
        fresh = [] if parents else [root]
        for leaf in parents:
            leaf.children = self._children(leaf)
            a, b = leaf.children
            fresh += [a, b]
            pairs.append((leaf, a, b) if a.n < b.n else (leaf, b, a))
        contexts = {}
        for x in fresh:
            if x is root or self._may_split(x):
                only, thresholds = self._only(x)
                contexts[x.key] = Context((x.g, x.h, x.n), x.output, x.lo, x.hi, x.depth, only, thresholds)
        if parents and not contexts:  # no child may split
            return Request(0, [], [], {}, [])
        return Request(_plan(root, searcher.table, self.by_index), fresh, pairs, contexts, self._priced())

    def _may_split(self, x: _Leaf) -> bool:
        return (self.p.max_depth <= 0 or x.depth < self.p.max_depth) and x.n >= 2 * self.p.split.min_data_in_leaf

    def _allowed(self, x: _Leaf) -> list[int]:
        every = [f.index for f in self.features if self.drawn is None or f.index in self.drawn]
        if self.p.interaction:
            near = set(x.path).union(*(g for g in self.p.interaction if x.path <= g))
            every = [i for i in every if i in near]
        if self.p.feature_fraction_bynode < 1 and every:
            k = max(int(len(every) * self.p.feature_fraction_bynode + 0.5), 1)
            every = sorted(self.rng.sample(every, k))
        return every

    def _priced(self) -> list[Feature]:
        if not self.p.cegb_coupled:
            return self.features
        return [replace(f, penalty=0.0 if f.index in self.used else self.p.cegb_tradeoff * self.p.cegb_coupled[f.index]) for f in self.features]

    def _only(self, x: _Leaf) -> tuple[frozenset[int] | None, dict[int, int]]:
        """The features that may split a leaf, None for all, and drawn thresholds."""
        own = self._allowed(x)
        thresholds = {f.index: self.rng.randrange(max(1, f.num_bin - 1)) for f in self.features} if self.p.extra_trees else {}
        if len(own) == len(self.features) and not x.dead:
            return None, thresholds
        return frozenset(own) - x.dead, thresholds

    def _children(self, x: _Leaf) -> tuple[_Leaf, _Leaf]:
        r = x.row
        f = self.by_index[r["feature"]]
        lo, hi, middle = x.lo, x.hi, (r["left_output"] + r["right_output"]) / 2
        bounds = [(lo, hi), (lo, hi)]
        if f.monotone > 0:
            bounds = [(lo, min(hi, middle)), (max(lo, middle), hi)]
        elif f.monotone < 0:
            bounds = [(max(lo, middle), hi), (lo, min(hi, middle))]
        out = []
        for side, name, (a, b) in (("l", "left", bounds[0]), ("r", "right", bounds[1])):
            self.keys += 1
            out.append(_Leaf(self.keys, x.depth + 1, r[f"{side}g"], r[f"{side}h"], r[f"{side}n"], r[f"{name}_output"], a, b, x.path | {f.index}, dead=x.dead))
        return out[0], out[1]

    def steps(self, searcher: Searcher) -> Generator[Request, None, tuple[Tree, str, _Leaf]]:
        """Asks for searches; gives the tree (outputs not yet shrunk), SQL for a row's leaf number, and the root."""
        root = _Leaf(0, 0, 0.0, 0.0, 0, 0.0)
        if self.features:
            yield self._request(searcher, root, [])
            if not self._may_split(root):
                root.row = None
        else:
            root.g, root.h, root.n = counting.leaf_sums(searcher.df, [searcher.slots[self.slot]])[0]
            root.output = output(root.g, root.h, self.p.split)
        leaves = [root]
        yield from self._force(searcher, root, leaves)
        while len(leaves) < self.p.num_leaves:
            ready = [x for x in leaves if x.row is not None]
            if not ready:
                break
            x = max(ready, key=lambda y: y.row["gain"])  # the first of equals
            if x.children is None:
                # of all leaves, only so many can still be split
                room = self.p.num_leaves - len(leaves)
                batch = sorted(ready, key=lambda y: -y.row["gain"])[:room]
                wanted = self._request(searcher, root, [y for y in batch if y.children is None])
                if wanted.fresh:
                    yield wanted
            at = leaves.index(x)
            leaves[at] = x.children[0]
            leaves.append(x.children[1])
            self.used.add(x.row["feature"])
        kept = {id(x) for x in leaves}
        return (*self._tree(root, kept), root)

    def _force(self, searcher: Searcher, root: _Leaf, leaves: list[_Leaf]) -> Generator[Request, None, None]:
        """Forced splits, breadth first, as long as they may be taken."""
        todo = [(root, self.p.forced)] if self.p.forced else []
        while todo and len(leaves) < self.p.num_leaves:
            leaf, plan = todo.pop(0)
            f = self.by_index.get(plan["feature"])
            if f is None:
                continue
            wanted = self.mappers[f.index].bin(float(plan["threshold"]))
            row = searcher.again(self.slot, leaf, self._priced(), {f.index: wanted}, frozenset({f.index}), _plan(root, searcher.table, self.by_index))
            if row is None:
                break
            leaf.row = row
            yield self._request(searcher, root, [leaf])
            leaves[leaves.index(leaf)] = leaf.children[0]
            leaves.append(leaf.children[1])
            todo += [(c, plan[k]) for c, k in zip(leaf.children, ("left", "right"), strict=True) if plan.get(k)]

    def _tree(self, root: _Leaf, kept: set[int]) -> tuple[Tree, str]:
        tree = Tree(leaves=[])

        def write(x: _Leaf) -> tuple[int, str]:
            if id(x) in kept or x.children is None:
                tree.leaves.append(Leaf(x.output, x.h, x.n))
                return ~(len(tree.leaves) - 1), str(len(tree.leaves) - 1)
            r, m = x.row, self.mappers[x.row["feature"]]
            at = len(tree.nodes)
            cats = None
            if r["cats"] is not None:
                cats = sorted(m.categories[b - 1] for b in r["cats"])
            threshold = 0.0 if cats is not None else m.upper[min(r["threshold"], len(m.upper) - 1)]
            node = Node(r["feature"], threshold, r["threshold"], default_left=bool(r["default_left"]), missing=m.missing, cats=cats, bins=list(r["cats"]) if cats is not None else None, gain=r["gain"], value=x.output, weight=x.h, count=x.n)
            if m.missing == "zero" and m.num_bin <= 2:
                node.missing = "none"
            tree.nodes.append(node)
            node.left, left = write(x.children[0])
            node.right, right = write(x.children[1])
            return at, f"CASE WHEN {bin_sql(r, self.by_index)} THEN {left} ELSE {right} END"

        _, route = write(root)
        return tree, route
