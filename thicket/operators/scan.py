"""Split search over one leaf's histogram: the rules of ``split``, on dense arrays (features x bins).

A histogram is as large as its features and bins, whatever the rows; growing a tree looks at dozens of them, so here a search is a
few array operations instead of a query.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np

from thicket.operators.split import EPS, Feature, SplitParams


@dataclass
class Dense:
    """g, h, n of a leaf by feature (in the order of the search's features) and bin."""

    g: np.ndarray
    h: np.ndarray
    n: np.ndarray

    def less(self, other: Dense) -> Dense:
        n = self.n - other.n
        return Dense(np.where(n > 0, self.g - other.g, 0.0), np.where(n > 0, self.h - other.h, 0.0), n)


def soft(g: np.ndarray, l1: float) -> np.ndarray:
    return np.sign(g) * np.maximum(np.abs(g) - l1, 0.0) if l1 else g


def leaf_output(g: Any, h: Any, p: SplitParams, n: Any, parent: float) -> Any:
    raw = -soft(g, p.lambda_l1) / (h + p.lambda_l2)
    if p.max_delta_step > 0:
        raw = np.clip(raw, -p.max_delta_step, p.max_delta_step)
    if p.path_smooth > 0:
        weight = n / p.path_smooth
        raw = raw * weight / (weight + 1.0) + parent / (weight + 1.0)
    return raw


def given_gain(g: Any, h: Any, out: Any, p: SplitParams) -> Any:
    return -(2.0 * soft(g, p.lambda_l1) * out + (h + p.lambda_l2) * out * out)


def leaf_gain(g: Any, h: Any, p: SplitParams, n: Any, parent: float) -> Any:
    if p.max_delta_step > 0 or p.path_smooth > 0:
        return given_gain(g, h, leaf_output(g, h, p, n, parent), p)
    s = soft(g, p.lambda_l1)
    return s * s / (h + p.lambda_l2)


def order(row: dict[str, Any]) -> tuple:
    """Of splits of a leaf the first is taken."""
    return -row["gain"], row["feature"], row["dir"]


def search(hist: Dense, features: list[Feature], p: SplitParams, parent: float = 0.0, lo: float = -np.inf, hi: float = np.inf, depth: int = 0, thresholds: dict[int, int] | None = None, only: set[int] | frozenset[int] | None = None) -> tuple[dict[str, Any] | None, set[int]]:
    """The leaf's best split, and the numeric features that can't split this leaf or any below it, as no threshold leaves enough rows on both sides."""
    found = []
    numeric = [i for i, f in enumerate(features) if not f.categorical and (only is None or f.index in only)]
    dead: set[int] = set()
    with np.errstate(divide="ignore", invalid="ignore"):
        if numeric:
            found.append(_numeric(hist, features, numeric, p, parent, lo, hi, depth, thresholds or {}, dead))
        for i, f in enumerate(features):
            if f.categorical and (only is None or f.index in only):
                found += _categorical(hist, i, f, p, parent, lo, hi)
    # what costs more than it gains isn't taken
    return min((x for x in found if x is not None and x["gain"] > 0), key=order, default=None), dead


def best_split(*args: Any, **more: Any) -> dict[str, Any] | None:
    """The leaf's best split: the columns of ``split.scored``. thresholds: the only threshold of some features; only: the features."""
    return search(*args, **more)[0]


def _finish(gain: float, f: Feature, p: SplitParams, n: float, depth: int) -> float:
    gain *= f.contri
    if p.monotone_penalty > 0 and f.monotone:
        x = p.monotone_penalty
        gain *= EPS if x >= depth + 1 else (1 - x / 2**depth if x <= 1 else 1 - 2 ** (x - 1 - depth)) + EPS
    return gain - (p.cegb_tradeoff * p.cegb_penalty_split * n) - f.penalty


def _numeric(hist: Dense, features: list[Feature], at: list[int], p: SplitParams, parent: float, lo: float, hi: float, depth: int, thresholds: dict[int, int], dead: set[int]) -> dict[str, Any] | None:
    own = [features[i] for i in at]
    g, h, n = hist.g[at], hist.h[at], hist.n[at]
    bins = np.arange(g.shape[1])[None]
    num = np.array([f.num_bin for f in own])[:, None]
    nan = np.array([f.missing == "nan" and f.num_bin > 2 for f in own])[:, None]
    zero = np.array([f.missing == "zero" and f.num_bin > 2 for f in own])[:, None]
    default = np.array([f.default_bin for f in own])[:, None]
    gone = (nan & (bins == num - 1)) | (zero & (bins == default))
    if p.count_mode == "hessian":
        n = np.floor(h * (n.sum(1) / h.sum(1))[:, None] + 0.5).astype(np.int64)
    total = [x.sum(1, keepdims=True) for x in (g, h, n)]
    known = [np.where(gone, 0, x) for x in (g, h, n)]
    below = [np.cumsum(x, 1) for x in known]
    # reverse: what is known above the threshold goes right, all else left; forward: what is known up to it goes left
    right0 = [k.sum(1, keepdims=True) - b for k, b in zip(known, below, strict=True)]
    sides = [([t - r for t, r in zip(total, right0, strict=True)], right0), (below, [t - b for t, b in zip(total, below, strict=True)])]
    # a leaf without missing values is parted alike from both directions: the first is enough
    two_ways = (nan | zero) & (total[2] > below[2][:, -1:])
    best = None
    shift = leaf_gain(total[0], total[1], p, total[2], parent) + p.min_gain_to_split
    alive = np.zeros(len(own), bool)
    mono = np.array([f.monotone for f in own])[:, None]
    for way, (left, right) in enumerate(sides):
        last = num - 1 - nan  # the last bin that is no missing bin
        fits = (bins < last) if way == 0 else ((bins < last) | (nan & (bins == last))) & two_ways
        skipped = zero & (bins == (default - 1 if way == 0 else default))
        fits = fits & ~skipped & (left[2] > 0) & (right[2] > 0)
        fits &= (left[2] >= p.min_data_in_leaf) & (right[2] >= p.min_data_in_leaf)
        alive |= fits.any(1)
        fits &= (left[1] >= p.min_sum_hessian_in_leaf) & (right[1] >= p.min_sum_hessian_in_leaf)
        if thresholds:
            fits &= bins == np.array([thresholds.get(f.index, -1) for f in own])[:, None]
        lo_, hi_ = np.clip(leaf_output(left[0], left[1], p, left[2], parent), lo, hi), np.clip(leaf_output(right[0], right[1], p, right[2], parent), lo, hi)
        held = (mono != 0) | np.isfinite(lo) | np.isfinite(hi)
        gain = np.where(
            held,
            given_gain(left[0], left[1], lo_, p) + given_gain(right[0], right[1], hi_, p),
            leaf_gain(left[0], left[1], p, left[2], parent) + leaf_gain(right[0], right[1], p, right[2], parent),
        )
        gain = np.where(fits & (mono * (hi_ - lo_) >= 0), gain - shift, -np.inf)
        gain = np.where(gain > 0, gain, -np.inf)
        # within a feature: the highest threshold in reverse, the lowest forward
        pick = gain.shape[1] - 1 - np.argmax(gain[:, ::-1], 1) if way == 0 else np.argmax(gain, 1)
        for i, b in enumerate(pick):
            if gain[i, b] == -np.inf:
                continue
            value = _finish(float(gain[i, b]), own[i], p, float(total[2][i, 0]), depth)
            key = (-value, own[i].index, way)
            if best is None or key < best[0]:
                f = own[i]
                best = key, {
                    "feature": f.index, "threshold": int(b), "dir": way, "gain": value, "cats": None, "default_left": way == 0 and not (f.missing == "nan" and f.num_bin <= 2), "left_output": float(lo_[i, b]), "right_output": float(hi_[i, b]),
                    "lg": float(left[0][i, b]), "lh": float(left[1][i, b]), "ln": int(left[2][i, b]), "rg": float(right[0][i, b]), "rh": float(right[1][i, b]), "rn": int(right[2][i, b]),
                }
    if p.count_mode == "exact":  # estimated counts needn't fall from leaf to leaf
        dead.update(f.index for f, some in zip(own, alive, strict=True) if not some)
    return best[1] if best else None


def _categorical(hist: Dense, at: int, f: Feature, p: SplitParams, parent: float, lo: float, hi: float) -> list[dict[str, Any]]:
    g, h, n = hist.g[at][: f.num_bin], hist.h[at][: f.num_bin], hist.n[at][: f.num_bin]
    if p.count_mode == "hessian" and h.sum() > 0:
        n = np.floor(h * n.sum() / h.sum() + 0.5).astype(np.int64)
    sg, sh, sn = g.sum(), h.sum(), int(n.sum())
    shift = leaf_gain(sg, sh, p, sn, parent) + p.min_gain_to_split
    out: list[dict[str, Any]] = []

    def offer(lg: float, lh: float, ln: int, q: SplitParams, way: int, index: int, cats: list[int]) -> None:
        rg, rh, rn = sg - lg, sh - lh, sn - ln
        gain = leaf_gain(lg, lh, q, ln, parent) + leaf_gain(rg, rh, q, rn, parent) - shift
        if gain <= 0 or rn <= 0:
            return
        a, b = (float(np.clip(leaf_output(x, y, q, z, parent), lo, hi)) for x, y, z in ((lg, lh, ln), (rg, rh, rn)))
        out.append({"feature": f.index, "threshold": index, "dir": way, "gain": _finish(float(gain), f, p, sn, 0), "cats": cats, "default_left": False, "left_output": a, "right_output": b, "lg": float(lg), "lh": float(lh), "ln": int(ln), "rg": float(rg), "rh": float(rh), "rn": int(rn)})

    if f.num_bin <= p.max_cat_to_onehot:
        for b in range(1, f.num_bin):
            fits = n[b] > 0 and n[b] >= p.min_data_in_leaf and sn - n[b] >= p.min_data_in_leaf and h[b] >= p.min_sum_hessian_in_leaf and sh - h[b] >= p.min_sum_hessian_in_leaf
            if fits:
                offer(g[b], h[b], n[b], p, 0, b, [b])
    else:
        q = p.with_l2(p.cat_l2)
        used = [b for b in range(1, f.num_bin) if n[b] > 0 and n[b] >= p.cat_smooth]
        used.sort(key=lambda b: (g[b] / (h[b] + p.cat_smooth), b))
        for way, order in enumerate((used, used[::-1])):
            lg = lh = 0.0
            ln = held = 0
            for i, b in enumerate(order[: min(p.max_cat_threshold, (len(used) + 1) // 2)]):
                lg, lh, ln, held = lg + g[b], lh + h[b], ln + int(n[b]), held + int(n[b])
                if ln < p.min_data_in_leaf or lh < p.min_sum_hessian_in_leaf:
                    continue
                if sn - ln < max(p.min_data_in_leaf, p.min_data_per_group) or sh - lh < p.min_sum_hessian_in_leaf:
                    break
                if held < p.min_data_per_group:
                    continue
                held = 0
                offer(lg, lh, ln, q, way, i, order[: i + 1])
    top = min(out, key=lambda x: (-x["gain"], x["dir"], x["threshold"]), default=None)
    return [top] if top else []
