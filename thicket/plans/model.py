"""Trees and ensembles: node arrays, text and JSON forms, SQL text, importances."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from thicket.operators.binning import NAN, NONE, ZERO, ZERO_MISSING

VERSION = "v4"
_MISSING = [NONE, ZERO_MISSING, NAN]


@dataclass
class Node:
    """Inner node. Children: an inner node's number from 0 on, or ~leaf. cats: categories that go left."""

    feature: int
    threshold: float
    bin: int
    left: int = -1
    right: int = -2
    default_left: bool = False
    missing: str = NONE
    cats: list[int] | None = None
    bins: list[int] | None = None
    gain: float = 0.0
    value: float = 0.0
    weight: float = 0.0
    count: int = 0

    @property
    def decision_type(self) -> int:
        """Bit 0: categorical; bit 1: default left; bits 2 and 3: kind of missing value."""
        return (self.cats is not None) | self.default_left << 1 | _MISSING.index(self.missing) << 2


@dataclass
class Leaf:
    value: float = 0.0
    weight: float = 0.0
    count: int = 0
    const: float | None = None
    features: list[int] = field(default_factory=list)
    coefs: list[float] = field(default_factory=list)


@dataclass
class Tree:
    nodes: list[Node] = field(default_factory=list)
    leaves: list[Leaf] = field(default_factory=lambda: [Leaf()])
    shrinkage: float = 1.0

    @property
    def linear(self) -> bool:
        return any(leaf.const is not None for leaf in self.leaves)

    def shrink(self, rate: float) -> None:
        self.shrinkage *= rate
        for x in (*self.leaves, *self.nodes):
            x.value *= rate
        for leaf in self.leaves:
            if leaf.const is not None:
                leaf.const *= rate
                leaf.coefs = [c * rate for c in leaf.coefs]

    def add_bias(self, bias: float) -> None:
        for x in (*self.leaves, *self.nodes):
            x.value += bias
        for leaf in self.leaves:
            if leaf.const is not None:
                leaf.const += bias

    def walk(self, row: list[float | None]) -> int:
        """The leaf of one row of raw values."""
        at = 0 if self.nodes else -1
        while at >= 0:
            node = self.nodes[at]
            at = node.left if goes_left(node, row[node.feature]) else node.right
        return ~at

    def output(self, row: list[float | None]) -> float:
        leaf = self.leaves[self.walk(row)]
        if leaf.const is None:
            return leaf.value
        values = [row[f] for f in leaf.features]
        if any(v is None or math.isnan(v) for v in values):
            return leaf.value
        return leaf.const + sum(c * v for c, v in zip(leaf.coefs, values, strict=True))

    def depth(self) -> int:
        def below(at: int) -> int:
            return 0 if at < 0 else 1 + max(below(self.nodes[at].left), below(self.nodes[at].right))

        return below(0) if self.nodes else 0


def goes_left(node: Node, value: float | None) -> bool:
    missing = value is None or math.isnan(value)
    if node.cats is not None:
        return not missing and value > -1 and int(value) in node.cats
    if missing and node.missing != NAN:
        value, missing = 0.0, False
    if missing or (node.missing == ZERO_MISSING and abs(value) <= ZERO):
        return node.default_left
    return value <= node.threshold


def number(x: float) -> str:
    """Shortest text that reads back as the same double."""
    return repr(float(x)) if x == x and abs(x) != math.inf else str(x)


def _sql_number(x: float) -> str:
    """A literal; thresholds may be infinite (a split of missing values against all others)."""
    x = float(x)
    words = "'NaN'" if x != x else ("'Infinity'" if x > 0 else "'-Infinity'") if abs(x) == math.inf else repr(x)
    return f"CAST({words} AS DOUBLE)"


def tree_sql(tree: Tree, features: list[str], what: str = "value", quote: str = "") -> str:
    """A CASE expression for a tree's value, leaf or split path, in SQL that Spark and DuckDB run alike."""
    name = lambda f: f"{quote}{features[f]}{quote}"

    def leaf(i: int) -> str:
        x = tree.leaves[i]
        if what == "leaf":
            return str(i)
        if x.const is None:
            return _sql_number(x.value)
        terms = " + ".join([_sql_number(x.const), *(f"{_sql_number(c)} * {name(f)}" for f, c in zip(x.features, x.coefs, strict=True))])
        gone = " OR ".join([*(f"{name(f)} IS NULL OR isnan(CAST({name(f)} AS DOUBLE))" for f in x.features)]) or "FALSE"
        return f"CASE WHEN {gone} THEN {_sql_number(x.value)} ELSE {terms} END"

    def test(n: Node) -> str:
        v = f"CAST({name(n.feature)} AS DOUBLE)"
        missing = f"({v} IS NULL OR isnan({v}))"
        if n.cats is not None:
            if not n.cats:
                return "FALSE"
            code = f"CAST(CASE WHEN {missing} OR {v} <= -1 OR abs({v}) > 2e9 THEN -1 ELSE floor({v}) END AS BIGINT)"
            return f"{code} IN ({', '.join(map(str, n.cats))})"
        if n.missing == NAN:
            return f"CASE WHEN {missing} THEN {str(n.default_left).upper()} ELSE {v} <= {_sql_number(n.threshold)} END"
        v = f"CASE WHEN {missing} THEN CAST(0.0 AS DOUBLE) ELSE {v} END"
        if n.missing == ZERO_MISSING:
            return f"CASE WHEN abs({v}) <= {_sql_number(ZERO)} THEN {str(n.default_left).upper()} ELSE {v} <= {_sql_number(n.threshold)} END"
        return f"{v} <= {_sql_number(n.threshold)}"

    def write(at: int) -> str:
        if at < 0:
            return leaf(~at)
        n = tree.nodes[at]
        return f"CASE WHEN {test(n)} THEN {write(n.left)} ELSE {write(n.right)} END"

    return write(0 if tree.nodes else -1)


@dataclass
class Model:
    """trees are in order of iteration, then class."""

    features: list[str]
    objective: str = "regression"
    num_class: int = 1
    trees: list[Tree] = field(default_factory=list)
    average: bool = False
    sigmoid: float = 1.0
    squared: bool = False
    infos: list[str] = field(default_factory=list)
    best_iteration: int = 0
    params: dict[str, Any] = field(default_factory=dict)

    @property
    def iterations(self) -> int:
        return len(self.trees) // self.num_class

    def of_range(self, start: int = 0, count: int = -1) -> list[Tree]:
        """Trees of some iterations; all from ``start`` if count is not positive."""
        end = self.iterations if count <= 0 else min(self.iterations, start + count)
        return self.trees[start * self.num_class : end * self.num_class]

    def truncate(self, iterations: int) -> None:
        del self.trees[iterations * self.num_class :]

    def num_trees(self) -> int:
        return len(self.trees)

    def predict(self, df: DataFrame, mode: str = "prediction", name: str = "prediction", **options: Any) -> DataFrame:
        from thicket.plans.predict import predict

        return predict(df, self, mode, name, **options)

    def refit(self, data: Any, decay: float | None = None) -> Model:
        from thicket.plans.boosting import refit

        return refit(self, data, decay=decay)

    # --- importances ------------------------------------------------------------------------------------------------

    def importance(self, kind: str = "split", iterations: int = -1) -> list[float]:
        out = [0.0] * len(self.features)
        for tree in self.of_range(0, iterations):
            for n in tree.nodes:
                if n.gain > 0:
                    out[n.feature] += 1.0 if kind == "split" else n.gain
        return out

    def node_table(self, spark: SparkSession) -> DataFrame:
        """A row for each node: tree, iteration, class, node (leaves: ~leaf), feature, threshold, gain, children, value, weight, count."""
        rows: list[tuple] = []
        for t, tree in enumerate(self.trees):
            key = (t, t // self.num_class, t % self.num_class)
            rows += [(*key, i, n.feature, None if n.cats is not None else float(n.threshold), n.cats, n.decision_type, float(n.gain), n.left, n.right, float(n.value), float(n.weight), int(n.count)) for i, n in enumerate(tree.nodes)]
            rows += [(*key, ~i, None, None, None, None, None, None, None, float(x.value), float(x.weight), int(x.count)) for i, x in enumerate(tree.leaves)]
        return spark.createDataFrame(rows, "tree int, iteration int, class int, node int, feature int, threshold double, cats array<int>, decision_type int, gain double, left int, right int, value double, weight double, count long")

    # --- text ---------------------------------------------------------------------------------------------------------

    def to_text(self) -> str:
        """Header, a block for each tree, importances; ``from_text`` reads it back."""
        objective = self.objective + (f" num_class:{self.num_class}" if self.num_class > 1 else "") + (f" sigmoid:{number(self.sigmoid)}" if self.sigmoid != 1.0 else "") + (" sqrt" if self.squared else "")
        lines = ["tree", f"version={VERSION}", f"num_class={self.num_class}", f"num_tree_per_iteration={self.num_class}", f"max_feature_idx={len(self.features) - 1}", f"objective={objective}", f"best_iteration={self.best_iteration}"]
        lines += ["average_output"] * self.average
        lines += [f"feature_names={json.dumps(self.features)}", f"feature_infos={json.dumps(self.infos)}", ""]
        for i, t in enumerate(self.trees):
            cat = [j for j, n in enumerate(t.nodes) if n.cats is not None]
            row = lambda key, values: f"{key}=" + " ".join(number(v) if isinstance(v, float) else str(v) for v in values)
            lines += [f"Tree={i}", f"num_leaves={len(t.leaves)}", f"num_cat={len(cat)}"]
            lines += [row("split_feature", (n.feature for n in t.nodes)), row("split_gain", (float(n.gain) for n in t.nodes)), row("threshold", (float(n.threshold) for n in t.nodes)), row("threshold_bin", (n.bin for n in t.nodes))]
            lines += [row("decision_type", (n.decision_type for n in t.nodes)), row("left_child", (n.left for n in t.nodes)), row("right_child", (n.right for n in t.nodes))]
            lines += [row("leaf_value", (float(x.value) for x in t.leaves)), row("leaf_weight", (float(x.weight) for x in t.leaves)), row("leaf_count", (x.count for x in t.leaves))]
            lines += [row("internal_value", (float(n.value) for n in t.nodes)), row("internal_weight", (float(n.weight) for n in t.nodes)), row("internal_count", (n.count for n in t.nodes))]
            if cat:
                lines.append("categories=" + json.dumps([[j, t.nodes[j].cats, t.nodes[j].bins] for j in cat]))
            lines.append(f"is_linear={int(t.linear)}")
            if t.linear:
                lines.append("leaf_linear=" + json.dumps([[x.const, x.features, x.coefs] for x in t.leaves]))
            lines += [f"shrinkage={number(t.shrinkage)}", ""]
        lines += ["end of trees", "", "feature_importances:"]
        ranked = sorted(((v, f) for v, f in zip(self.importance(), self.features, strict=True) if v), key=lambda x: -x[0])
        return "\n".join([*lines, *(f"{f}={int(v)}" for v, f in ranked), ""])

    @staticmethod
    def from_text(text: str) -> Model:
        body, _, _ = text.partition("end of trees")
        blocks = body.split("\nTree=")
        if not blocks[0].startswith("tree\n") or "end of trees" not in text:
            raise ValueError("not a model")
        head = dict(x.split("=", 1) for x in blocks[0].split("\n") if "=" in x)
        words = head["objective"].split(" ")
        extra = dict(w.split(":") for w in words[1:] if ":" in w)
        out = Model(json.loads(head["feature_names"]), words[0], int(head["num_class"]), average="average_output" in blocks[0].split("\n"), sigmoid=float(extra.get("sigmoid", 1.0)), squared="sqrt" in words[1:], infos=json.loads(head["feature_infos"]), best_iteration=int(head.get("best_iteration", 0)))
        for block in blocks[1:]:
            f = dict(x.split("=", 1) for x in block.split("\n")[1:] if "=" in x)
            ints = lambda k: [int(x) for x in f[k].split()]
            floats = lambda k: [float(x) for x in f[k].split()]
            n = int(f["num_leaves"])
            nodes = [
                Node(a, th, b, left, right, bool(d >> 1 & 1), _MISSING[d >> 2 & 3], None, None, gain, value, weight, count)
                for a, th, b, left, right, d, gain, value, weight, count in zip(ints("split_feature"), floats("threshold"), ints("threshold_bin"), ints("left_child"), ints("right_child"), ints("decision_type"), floats("split_gain"), floats("internal_value"), floats("internal_weight"), ints("internal_count"), strict=True)
            ]
            leaves = [Leaf(v, w, c) for v, w, c in zip(floats("leaf_value"), floats("leaf_weight"), ints("leaf_count"), strict=True)]
            if len(leaves) != n or len(nodes) != n - 1:
                raise ValueError(f"tree {block.split(chr(10))[0]} has {len(leaves)} leaves and {len(nodes)} nodes instead of {n} and {n - 1}")
            for j, cats, bins in json.loads(f.get("categories", "[]")):
                nodes[j].cats, nodes[j].bins = cats, bins
            for leaf, (const, features, coefs) in zip(leaves, json.loads(f.get("leaf_linear", "[]")), strict=False):
                leaf.const, leaf.features, leaf.coefs = const, features, coefs
            out.trees.append(Tree(nodes, leaves, float(f["shrinkage"])))
        return out

    def to_json(self) -> dict[str, Any]:
        """Nested nodes."""

        def nest(t: Tree, at: int) -> dict[str, Any]:
            if at < 0:
                return {"leaf_index": ~at} | {k: v for k, v in asdict(t.leaves[~at]).items() if v not in (None, [])}
            n = t.nodes[at]
            return {
                "split_index": at, "split_feature": n.feature, "split_gain": n.gain, "threshold": n.threshold if n.cats is None else "||".join(map(str, n.cats)), "decision_type": "<=" if n.cats is None else "==",
                "default_left": n.default_left, "missing_type": n.missing, "internal_value": n.value, "internal_weight": n.weight, "internal_count": n.count, "left_child": nest(t, n.left), "right_child": nest(t, n.right),
            }

        return {
            "name": "tree", "version": VERSION, "num_class": self.num_class, "num_tree_per_iteration": self.num_class, "max_feature_idx": len(self.features) - 1, "objective": self.objective, "average_output": self.average,
            "feature_names": self.features, "feature_importances": {f: v for f, v in zip(self.features, self.importance(), strict=True) if v},
            "tree_info": [{"tree_index": i, "num_leaves": len(t.leaves), "shrinkage": t.shrinkage, "tree_structure": nest(t, 0 if t.nodes else -1)} for i, t in enumerate(self.trees)],
        }

    def to_sql(self, quote: str = "") -> list[str]:
        """A SQL expression of the raw score for each class."""
        own = [[tree_sql(t, self.features, quote=quote) for t in self.trees[k :: self.num_class]] for k in range(self.num_class)]
        sums = [" + ".join(f"({x})" for x in each) or "CAST(0.0 AS DOUBLE)" for each in own]
        return [f"({s}) / {max(1, self.iterations)}" if self.average else s for s in sums]
