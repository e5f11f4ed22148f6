"""SQL that trains small tree ensembles step by step, for comparison: windows over distinct values, one split after another.

It knows nothing of bins, histograms or jobs. Features have so few values that each is a bin of its own. Of a tree it gives the splits (feature,
gain, rows) and the leaves (value, rows), but no thresholds: where a leaf has no row of some values, several bounds part its rows alike.
"""

from __future__ import annotations

from thicket.queries.base import WITH

FEATURES = ("f0", "f1", "f2")


def draw(*parts: str) -> str:
    """A number in [0, 1) from SQL texts or numbers, as ``objectives.uniform`` draws it."""
    text = " || ':' || ".join(f"CAST({p} AS VARCHAR)" for p in parts)
    return f"(CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496e0)"


#: Gradient and hessian of score s and label y, and the first score.
OBJECTIVES = {
    "regression": ("s - y", "1e0", "avg(y)"),
    "regression_l1": ("sign(s - y)", "1e0", "median(y)"),
    "given": ("s - y", "1e0", "max(0e0)"),  # squares, from 0 on
    "binary": ("1 / (1 + exp(-s)) - y", "(1 / (1 + exp(-s))) * (1 - 1 / (1 + exp(-s)))", "ln(avg(y) / (1 - avg(y)))"),
}


def training(
    rounds: int = 3, leaves: int = 7, rate: float = 0.3, objective: str = "regression", label: str = "y", least: int = 20, depth: int = 0, groups: tuple[tuple[int, ...], ...] = (),
    forced: tuple[tuple[int, int, float], ...] = (), bag: float = 0.0, goss: bool = False, forest: bool = False, quantised: bool = False, rows: str = "TRUE", start: str = "", lazy: tuple[float, ...] = (),
) -> str:
    """CTEs up to ``trees`` (tree, feature, gain, value, count) and s0, s1, ... (row_id, y, s, own): scores after each round. ``rows``: those that train.
    forced: (leaf, feature, threshold) of the first splits. start: SQL for each row's start score, in place of a constant. lazy: what a feature costs
    each row that no split has asked for it before; q0, q1, ... say whether one has."""
    g, h, first = OBJECTIVES[objective]
    paid = "".join(f", q{i}" for i in range(len(lazy)))
    none = "".join(f", FALSE AS q{i}" for i in range(len(lazy)))
    out = [f"d AS MATERIALIZED (SELECT row_id, {', '.join(FEATURES)}, {label} AS y, {rows} AS own{none} FROM t)", f"i AS MATERIALIZED (SELECT {first} AS c FROM d WHERE own)", "s0 AS MATERIALIZED (SELECT d.*, c AS s FROM d, i)" if not start else f"s0 AS MATERIALIZED (SELECT d.*, {start} AS s FROM d JOIN t USING (row_id))"]
    parts = []
    for r in range(rounds):
        begin = "i.c AS s" if forest else "s AS s"
        used = f"own AND {draw('row_id', '3', str(r))} < {bag}" if bag else "own"
        out.append(f"p{r} AS MATERIALIZED (SELECT row_id, {', '.join(FEATURES)}, y, own{paid}, s, {g} AS g, {h} AS h, {used} AS used FROM (SELECT * REPLACE ({begin}) FROM s{r}, i))")
        source = f"p{r}"
        if goss and r >= int(1 / rate):
            out.append(f"k{r} AS MATERIALIZED (SELECT count(*) AS n, CAST(floor(count(*) * 2e-1) AS BIGINT) AS k, CAST(floor(count(*) * 1e-1) AS BIGINT) AS other FROM p{r})")
            out.append(f"u{r} AS MATERIALIZED (SELECT min(v) AS cut FROM (SELECT abs(g * h) AS v, row_number() OVER (ORDER BY abs(g * h) DESC) AS place FROM p{r}), k{r} WHERE place <= k)")
            factor = "CASE WHEN abs(g * h) >= cut THEN 1e0 ELSE (n - k) / CAST(other AS DOUBLE) END"
            out.append(f"q{r} AS MATERIALIZED (SELECT * EXCLUDE (n, k, other, cut) REPLACE (g * {factor} AS g, h * {factor} AS h, abs(g * h) >= cut OR {draw('row_id', '3', str(r))} < other / CAST(n - k AS DOUBLE) AS used) FROM p{r}, k{r}, u{r})")
            source = f"q{r}"
        if quantised:
            out.append(f"z{r} AS MATERIALIZED (SELECT max(abs(g)) / 2 AS step FROM p{r})")
            out.append(f"q{r} AS MATERIALIZED (SELECT * EXCLUDE (step) REPLACE (floor(abs(g / step) + {draw('row_id', str(r), repr('g'))}) * CASE WHEN g < 0 THEN -1 ELSE 1 END * step AS g), g AS whole FROM p{r}, z{r})")
            source = f"q{r}"
        out.append(f"a{r}_0 AS MATERIALIZED (SELECT *, 0 AS leaf FROM {source})")
        out.append(f"l{r}_0 AS MATERIALIZED (SELECT 0 AS leaf, 0 AS depth, -1 AS grp)")
        for k in range(leaves - 1):
            out += _step(f"{r}_{k}", f"{r}_{k + 1}", k, least, depth, groups, forced[k] if k < len(forced) else None, lazy)
            parts.append(f"SELECT {r} AS tree, feature, gain, CAST(NULL AS DOUBLE) AS value, n AS count FROM b{r}_{k}")
        last = f"a{r}_{leaves - 1}"
        value = "median(y - s)" if objective == "regression_l1" else "-sum(whole) / sum(h)" if quantised else "-sum(g) / sum(h)"
        shrink, bias = ("1e0", "i.c") if forest else (repr(float(rate)), "i.c" if r == 0 else "0")
        out.append(f"v{r} AS MATERIALIZED (SELECT leaf, {value} * {shrink} AS value, count(*) AS count FROM {last} WHERE used GROUP BY leaf)")
        parts.append(f"SELECT {r}, NULL, NULL, value + {bias}, count FROM v{r}, i")
        out.append(f"s{r + 1} AS MATERIALIZED (SELECT a.row_id, {', '.join('a.' + f for f in FEATURES)}, a.y, a.own{paid}, a.s + v.value AS s FROM {last} a JOIN v{r} v ON a.leaf = v.leaf)")
    return f"{WITH}, {', '.join(out)}, trees AS ({' UNION ALL '.join(parts)})"


def classes(k: int = 3, rounds: int = 3, leaves: int = 7, rate: float = 0.3, label: str = "yc", least: int = 20) -> str:
    """The same for a tree a class and round: softmax probabilities of the scores s0, s1, ... less what the label says."""
    scores = [f"s{c}" for c in range(k)]
    out = [f"d AS MATERIALIZED (SELECT row_id, {', '.join(FEATURES)}, {label} AS y, TRUE AS own FROM t)"]
    out.append("i AS MATERIALIZED (SELECT " + ", ".join(f"ln(avg(CASE WHEN y = {c} THEN 1e0 ELSE 0e0 END)) AS c{c}" for c in range(k)) + " FROM d)")
    out.append("z0 AS MATERIALIZED (SELECT d.*, " + ", ".join(f"c{c} AS s{c}" for c in range(k)) + " FROM d, i)")
    parts = []
    for r in range(rounds):
        total = " + ".join(f"exp({s} - greatest({', '.join(scores)}))" for s in scores)
        for c in range(k):
            p = f"exp(s{c} - greatest({', '.join(scores)})) / ({total})"
            out.append(f"a{r}_{c}_0 AS MATERIALIZED (SELECT row_id, {', '.join(FEATURES)}, y, own, TRUE AS used, p - CASE WHEN y = {c} THEN 1 ELSE 0 END AS g, {k / (k - 1)!r} * p * (1 - p) AS h, 0 AS leaf FROM (SELECT *, {p} AS p FROM z{r}))")
            out.append(f"l{r}_{c}_0 AS MATERIALIZED (SELECT 0 AS leaf, 0 AS depth, -1 AS grp)")
            for j in range(leaves - 1):
                out += _step(f"{r}_{c}_{j}", f"{r}_{c}_{j + 1}", j, least, 0, (), None)
                parts.append(f"SELECT {r * k + c} AS tree, feature, gain, CAST(NULL AS DOUBLE) AS value, n AS count FROM b{r}_{c}_{j}")
            out.append(f"v{r}_{c} AS MATERIALIZED (SELECT leaf, -sum(g) / sum(h) * {rate!r} AS value, count(*) AS count FROM a{r}_{c}_{leaves - 1} GROUP BY leaf)")
            parts.append(f"SELECT {r * k + c}, NULL, NULL, value + {f'i.c{c}' if r == 0 else '0'}, count FROM v{r}_{c}, i")
        joins = " ".join(f"JOIN a{r}_{c}_{leaves - 1} x{c} ON x{c}.row_id = z.row_id JOIN v{r}_{c} w{c} ON w{c}.leaf = x{c}.leaf" for c in range(k))
        out.append(f"z{r + 1} AS MATERIALIZED (SELECT z.* REPLACE ({', '.join(f'z.s{c} + w{c}.value AS s{c}' for c in range(k))}) FROM z{r} z {joins})")
    return f"{WITH}, {', '.join(out)}, trees AS ({' UNION ALL '.join(parts)})"


def _step(now: str, then: str, k: int, least: int, depth: int, groups: tuple[tuple[int, ...], ...], forced: tuple[int, int, float] | None, lazy: tuple[float, ...] = ()) -> list[str]:
    """The best split of all leaves, and rows and leaves after it. Where none gains, nothing changes."""
    unpaid = [f"CASE WHEN q{i} THEN 0 ELSE 1 END" for i in range(len(lazy))] or ["0"] * len(FEATURES)
    melted = " UNION ALL ".join(f"SELECT leaf, {i} AS feature, {f} AS v, g, h, {unpaid[i]} AS o FROM a{now} WHERE used" for i, f in enumerate(FEATURES))
    sums = "sum({0}) OVER (PARTITION BY leaf, feature)"
    upto = "coalesce(sum({0}) OVER (PARTITION BY leaf, feature ORDER BY v NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)"
    missing = "coalesce(sum(CASE WHEN v IS NULL THEN {0} END) OVER (PARTITION BY leaf, feature), 0)"
    x = f"x{now} AS MATERIALIZED (SELECT leaf, feature, v, sum(g) AS g, sum(h) AS h, count(*) AS n, sum(o) AS o FROM ({melted}) GROUP BY leaf, feature, v)"
    columns = ", ".join(f"{sums.format(c)} AS t{c}, {upto.format(c)} AS u{c}, {missing.format(c)} AS m{c}" for c in "ghn") + f", {sums.format('o')} AS owed"
    w = f"w{now} AS MATERIALIZED (SELECT leaf, feature, v, lead(v) OVER (PARTITION BY leaf, feature ORDER BY v NULLS LAST) AS above, {columns} FROM x{now})"
    # missing values left (0), right (1). Of bounds that part a leaf alike the first way takes the highest, so that values the leaf lacks go
    # left up to the next that it has; the second takes the lowest. Missing values alone may go left where a leaf lacks the least values
    ways = " UNION ALL ".join(
        [
            f"SELECT leaf, feature, 0 AS way, v, above, ug + mg AS lg, uh + mh AS lh, un + mn AS ln, tg, th, tn, owed FROM w{now} WHERE v IS NOT NULL",
            f"SELECT leaf, feature, 0, -1e300, min(v), max(mg), max(mh), max(mn), max(tg), max(th), max(tn), max(owed) FROM w{now} WHERE feature = 0 GROUP BY leaf, feature HAVING min(v) > (SELECT min(f0) FROM d WHERE own)",
            f"SELECT leaf, feature, 1, v, NULL, ug, uh, un, tg, th, tn, owed FROM w{now} WHERE v IS NOT NULL AND feature = 0",
        ]
    )
    gain = "lg * lg / lh + (tg - lg) * (tg - lg) / (th - lh) - tg * tg / th"
    if lazy:
        gain += " - owed * CASE feature " + " ".join(f"WHEN {i} THEN {c!r}" for i, c in enumerate(lazy)) + " END"
    allowed = "TRUE"
    if groups:
        place = "CASE " + " ".join(f"WHEN feature IN ({', '.join(map(str, s))}) THEN {i}" for i, s in enumerate(groups)) + " END"
        allowed = f"(l.grp = -1 OR l.grp = {place})"
    deep = f"l.depth < {depth}" if depth else "TRUE"
    fits = f"ln >= {least} AND tn - ln >= {least} AND lh >= 1e-3 AND th - lh >= 1e-3"
    if forced:
        fits, allowed = f"c.leaf = {forced[0]} AND feature = {forced[1]} AND v <= {forced[2]}", "TRUE"
    c = f"c{now} AS MATERIALIZED (SELECT c.*, {gain} AS gain, l.depth, l.grp FROM ({ways}) c JOIN l{now} l ON c.leaf = l.leaf WHERE {fits} AND {allowed} AND {deep})"
    order = "v DESC" if forced else "round(gain, 9) DESC, leaf, feature, way, v"
    b = f"b{now} AS MATERIALIZED (SELECT leaf, feature, way, v, {'CAST(NULL AS DOUBLE) AS above' if forced else 'above'}, gain, depth, grp, tn AS n FROM c{now} WHERE gain > 0 ORDER BY {order} LIMIT 1)"
    value = "CASE b.feature " + " ".join(f"WHEN {i} THEN a.{f}" for i, f in enumerate(FEATURES)) + " END"
    right = f"coalesce(b.leaf = a.leaf AND NOT CASE WHEN {value} IS NULL THEN b.way = 0 WHEN b.above IS NOT NULL THEN {value} < b.above ELSE {value} <= b.v END, FALSE)"
    asked = "".join(f", a.q{i} OR coalesce(b.leaf = a.leaf AND b.feature = {i}, FALSE) AS q{i}" for i in range(len(lazy)))
    a = f"a{then} AS MATERIALIZED (SELECT a.* REPLACE (CASE WHEN {right} THEN {k + 1} ELSE a.leaf END AS leaf{asked}) FROM a{now} a LEFT JOIN b{now} b ON TRUE)"
    group = "CASE b.feature " + " ".join(f"WHEN {f} THEN {i}" for i, s in enumerate(groups) for f in s) + " END" if groups else "-1"
    below = f"SELECT {{0}} AS leaf, b.depth + 1 AS depth, {group} AS grp FROM b{now} b"
    leaves = f"l{then} AS MATERIALIZED (SELECT l.* FROM l{now} l WHERE l.leaf NOT IN (SELECT leaf FROM b{now}) UNION ALL {below.format('b.leaf')} UNION ALL {below.format(k + 1)})"
    return [x, w, c, b, a, leaves]


def trees(several: bool = False, **options: object) -> str:
    """SQL for all splits and leaves. ``several``: of several classes."""
    return f"{classes(**options) if several else training(**options)} SELECT CAST(tree AS INTEGER) AS tree, CAST(feature AS INTEGER) AS feature, round(gain, 4) AS gain, round(value, 6) AS value, CAST(count AS BIGINT) AS count FROM trees"
