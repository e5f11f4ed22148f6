"""The Merkle manifest, the filter audit and the toxicity classifier against brute force, with nulls, ties, repeats, long texts and odd columns."""

import random
import re
import zlib
from hashlib import sha256
from itertools import groupby, permutations

import numpy as np
import pyarrow as pa
import pytest

from thicket.llm import filter_audit, merkle, toxicity
from thicket.llm.shared import least_hashes, materialise

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, part string, leaf string, mask int"


def _docs(spark, rows):
    """rows: doc_id, text, lang. The other columns' names clash with those of the operators."""
    return spark.createDataFrame([(i, t, lang, f"s{(i or 0) % 3}", None if t is None else len(t), "x", "y", 9) for i, t, lang in rows], SCHEMA).repartition(3)


def _h(s):
    return sha256(s.encode()).hexdigest()


def _leaf(row, text):
    i, _, lang = row
    t = row[1]
    return _h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (i, f"s{(i or 0) % 3}", lang, None if t is None else len(t), text)))


def _tree(leaves):
    """Root and, for each leaf, the runs above it: (place in the run, run)."""
    levels, above = [list(leaves)], [[] for _ in leaves]
    while len(levels[-1]) > 1:
        now = levels[-1]
        runs = [now[i : i + 8] for i in range(0, len(now), 8)]
        for j in range(len(leaves)):
            at = j // 8 ** (len(levels) - 1)
            above[j].append((at % 8, runs[at // 8]))
        levels.append([_h("".join(r)) for r in runs])
    return levels[-1][0], above


def _brute_manifest(rows):
    rows = sorted(rows, key=lambda r: ((r[2] is not None, (r[2] or "").encode()), (r[0] is not None, r[0] or 0), _leaf(r, r[1])))
    trees = []
    for lang, group in groupby(rows, key=lambda r: r[2]):
        group = list(group)
        trees.append((lang, group, *_tree([_leaf(r, r[1]) for r in group])))
    root, tops = _tree([t[2] for t in trees])
    out = []
    for (_, group, subroot, above), top in zip(trees, tops, strict=True):
        for r, path in zip(group, above, strict=True):
            leaf, touched = _leaf(r, r[1]), r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0
            now = r[1]
            if touched and now is not None:
                now = re.sub("[A-Z]", lambda m: m[0].lower(), now)
            digest, proof = _leaf(r, now), ""
            for at, run in path + top:
                proof += "".join(run[:at] + run[at + 1 :])
                digest = _h("".join([*run[:at], digest, *run[at + 1 :]]))
            out.append((r[0], leaf, subroot, root, _h(proof), digest, digest == root))
    return out


def _key(rows):
    return sorted(map(tuple, rows), key=str)


COLUMNS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.mark.parametrize("langs", [["en"], [None], ["en", None, "", "é", "z", "a", "b", "c", "d", "e"]])
def test_manifest_is_the_brute_one(spark, langs):
    r = random.Random(5)
    rows = [(i, r.choice([None, "", "Abc É x", "none"]) if i % 4 else f"Text {i}", langs[min(r.randrange(2 * len(langs)), len(langs) - 1)]) for i in range(150)]
    rows += [(None, "No id", langs[0]), (None, None, langs[0]), (7, "Twice", langs[0]), (7, "Twice", langs[0]), (7, "Other", langs[0]), (-5, "x" * 300_000 + "Y", langs[-1]), (10**15, "alone", "lone")]
    found = merkle.manifest(merkle.tampering(_docs(spark, rows))).select(COLUMNS).collect()
    assert _key(found) == _key(_brute_manifest(rows))
    assert {f["verified"] for f in found} == {True, False}


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65])
def test_trees_of_every_shape(spark, n):
    rows = [(i, f"T{i}", "en") for i in range(n)]
    assert _key(merkle.manifest(merkle.tampering(_docs(spark, rows))).select(COLUMNS).collect()) == _key(_brute_manifest(rows))


def test_empty_manifest_and_equal_rows(spark):
    assert merkle.manifest(merkle.tampering(_docs(spark, []))).count() == 0
    rows = [(3, "Same", "en")] * 70
    found = merkle.manifest(merkle.tampering(_docs(spark, rows))).select(COLUMNS).collect()
    assert _key(found) == _key(_brute_manifest(rows))


def test_proofs_are_whole_and_prove_nothing_else(spark):
    rows = [(i, f"Text {i}", "en" if i % 5 else "fr") for i in range(100)]
    for r in merkle.manifest(merkle.tampering(_docs(spark, rows)), proofs=True).collect():
        path = [(p["before"], p["after"]) for p in r["proof"]]
        assert merkle.fold(r["leaf"], path) == r["root"]
        assert merkle.fold(_h("another"), path) != r["root"]
        assert _h("".join(b + a for b, a in path)) == r["proof_sha256"]


def test_a_run_without_a_child_is_refused():
    with pytest.raises(ValueError, match="missing"):
        merkle._complete([(0, 9, "a", None), (2, 9, "b", None)])


# --- filters --------------------------------------------------------------------------------------------------------------


def _brute_audit(rows, labels):
    known = {}
    for i, q, t in labels:
        old = known.get(i, (False, False))
        known[i] = old[0] or q == 1, old[1] or t == 1
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    docs = []
    for i, t, lang in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        docs.append((lang or "", {k for k, v in fails.items() if v}, *(known.get(i, (False, False)) if i is not None else (False, False))))
    out, shapley = {}, {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        for order in permutations("ABCDE"):
            for s, x in enumerate(order):
                before = set(order[:s])
                gone = [d for d in own if x in d[1] and not d[1] & before]
                out[part, "".join(order), s + 1] = [sum(not d[1] & (before | {x}) for d in own), len(gone), sum(x in d[1] and bool(d[1] & before) for d in own), sum(d[1] == {x} for d in own), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                shapley[part, x] = shapley.get((part, x), 0) + len(gone)
    return _key((*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items())


def test_audit_is_the_brute_one(spark):
    r = random.Random(3)
    word = lambda: r.choice(["alpha", "Beta", "GAMMA", "a|b", "é", "x#", "😀"]) + str(r.randrange(300))
    texts = [" ".join(word() for _ in range(n)) for n in (20, 99, 100, 101, 150)] + [" ".join(f"w{j}" for j in range(120)), "w " * 500, "A" * 100_000, None, "", " \t\n", "\x0bA b\x0c"]
    rows = [(r.choice([None, *range(40)]), r.choice(texts), r.choice([None, "", "en", "de"])) for _ in range(300)]
    labels = [(i, r.choice([None, 0, 1]), r.choice([None, 0, 1])) for i in [*range(30), *range(10), None, 99]]
    found = filter_audit.audit(filter_audit.cells(filter_audit.failures(_docs(spark, rows)), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")))
    got = found.select("part", "filter_order", "step", *filter_audit.COUNTS, "shapley").collect()
    assert len(got) == 600 * 3
    assert _key(got) == _brute_audit(rows, labels)


def test_audit_of_nothing_and_of_hot_copies(spark):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(filter_audit.cells(filter_audit.failures(_docs(spark, [])), labels)).count() == 0
    rows = [(i, "one text for many", "en") for i in range(500)] + [(7, f"t{i}", None) for i in range(300)]
    got = filter_audit.audit(filter_audit.cells(filter_audit.failures(_docs(spark, rows)), labels)).select("part", "filter_order", "step", *filter_audit.COUNTS, "shapley").collect()
    assert _key(got) == _brute_audit(rows, [(1, 1, 0)])


def test_lattice_of_three_filters(spark):
    cells = spark.createDataFrame([("p", 0b101, 1, 0, 4), ("p", 0b010, 0, 1, 2), ("p", 0, 0, 0, 3)], "part string, mask int, good int, toxic int, n long")
    assert filter_audit.edges(cells, "XYZ").count() == 12
    found = {(r["filter_order"], r["step"]): r for r in filter_audit.audit(cells, "XYZ").collect()}
    assert len(found) == 18
    assert (found["XYZ", 1]["removed"], found["XYZ", 1]["good_lost"], found["XYZ", 3]["redundant"], found["XYZ", 3]["kept"], found["XYZ", 2]["toxic_lost"]) == (4, 4, 4, 3, 2)
    assert (found["XYZ", 1]["shapley"], found["XYZ", 2]["shapley"], found["XYZ", 2]["unique_fails"]) == (12, 12, 2)


# --- toxicity -------------------------------------------------------------------------------------------------------------


def _corpus(n, seed=1):
    """Texts of invented words; every second toxic text insults women, and only such texts (but for a few) mention them."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        words = [r.choice("lorem ipsum dolor sit amet sed eiusmod tempor magna aliqua".split()) + str(r.randrange(9)) for _ in range(r.randrange(5, 60))]
        toxic = i % 4 == 0
        if toxic:
            words.insert(r.randrange(len(words)), r.choice(["vile", "filth", "rotten"]) if i % 20 else "abject")
            if i % 8 == 0:
                words.insert(0, "women")
        elif i % 4 == 1:
            words.insert(0, r.choice(["men", "boys", "girls"]))
        elif i % 48 == 2:
            words.insert(0, "women")
        out.append((i, " ".join(words) + ".", "en", toxic))
    return out


@pytest.fixture(scope="module")
def toxic_rows(spark):
    rows = _corpus(800)
    return _docs(spark, [x[:3] for x in rows]).cache(), spark.createDataFrame([(x[0], int(x[3])) for x in rows], "doc_id long, toxic int").cache(), rows


def test_swaps():
    got = list(toxicity.swaps("the women left. a woman's men\nnobody, womens", (("women", "men"), ("woman", "man", "girl"))))
    assert got == [("the women left", "the men left"), (" a woman's men", " a man's men"), (" a woman's men", " a girl's men"), (" a woman's men", " a woman's women")]


def test_balance_spares_neutral_mentions(spark, toxic_rows):
    docs, labels, _ = toxic_rows
    gap = {}
    for balance in (0.0, 20.0):
        model = toxicity.train(docs, labels, balance=balance)
        odds = lambda t: float(np.log(s / (1 - s))) if 0 < (s := model.score(pa.array([t]))[0]) < 1 else float(s)
        gap[balance] = odds("the women met") - odds("the men met")
        assert model.score(pa.array(["the men are vile"]))[0] > 0.9
        assert model.score(pa.array(["sit amet magna1"]))[0] < 0.1
    assert gap[0.0] > 2 and abs(gap[20.0]) < 0.25 * gap[0.0]


def test_toxicity_is_learnt_and_ignores_the_rest(spark, toxic_rows):
    docs, labels, rows = toxic_rows
    model = toxicity.train(docs, labels)
    found = {r["doc_id"]: r for r in toxicity.score(docs, model).collect()}
    truth = {x[0]: x[3] for x in rows}
    assert np.mean([found[i]["predicted"] == truth[i] for i in truth if found[i]["held_out"]]) > 0.97
    assert all(found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in truth)
    # held-out labels, and any other column, change nothing
    flipped = spark.createDataFrame([(x[0], int(x[3] ^ (zlib.crc32(str(x[0]).encode()) % 5 == 0))) for x in rows], "doc_id long, toxic int")
    other = toxicity.train(_docs(spark, [(x[0], x[1], "zz") for x in rows]), flipped)
    assert (other.keys == model.keys).all() and np.allclose(other.weights, model.weights)


def test_toxicity_of_odd_rows(spark, toxic_rows):
    docs, labels, rows = toxic_rows
    model = toxicity.train(docs, labels)
    odd = [(1, None, "en"), (2, "", None), (3, " \n", "en"), (4, "lorem1 " * 100_000 + "VILE!", "en"), (4, "lorem1 " * 100_000 + "VILE!", "en"), (None, "vile", "en"), (5, "Éé 漢字 😀", "en")]
    found = toxicity.score(_docs(spark, odd), model).collect()
    assert len(found) == len(odd)
    score = {r["doc_id"]: r["score"] for r in found}
    assert score[1] == score[2] == score[3] < 0.5 < score[4] and score[None] > 0.5
    assert [r["held_out"] for r in found if r["doc_id"] is None] == [False]
    assert toxicity.score(_docs(spark, []), model).count() == 0
    none = toxicity.train(docs, labels.where("toxic is null"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.5}
    one = toxicity.train(docs, labels.where("toxic = 0"))
    assert max(r["score"] for r in toxicity.score(docs, one).collect()) < 0.5
    mixed = toxicity.train(docs, spark.createDataFrame([(x[0], int(x[3])) for x in rows] + [(0, 0), (None, 1), (3, 7)], "doc_id long, toxic int"))
    assert np.allclose(mixed.weights, model.weights)


def test_gradient_by_differences():
    r = np.random.default_rng(0)
    x, y, pairs = r.random((40, 6)) < 0.4, r.random(40) < 0.5, r.integers(-1, 2, (9, 6))
    texts, (pair, edge) = np.nonzero(x), np.nonzero(pairs)
    w, b = toxicity.fit(texts, y.astype(float), (pair, edge, pairs[pair, edge].astype(float)), 6, balance=0.7, ridge=0.01, steps=3000)

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + 0.7 * np.sum((pairs @ w) ** 2) / (pair.max() + 1) + 0.005 * w @ w

    least = loss(w, b)
    for i in range(7):
        for d in (-1e-2, 1e-2):
            assert loss(w + d * (np.arange(6) == i), b + d * (i == 6)) > least


def test_least_hashes_are_exact(spark):
    rows = materialise(spark.range(5000).selectExpr("id", "id % 3 as k").repartition(7), "test-least")
    whole = rows.orderBy(*[c for c in ["id"]]).collect()
    got = least_hashes(rows, ["id"], 300).collect()
    assert len(got) == 300 and len({g["id"] for g in got}) == 300 and len(whole) == 5000
    assert sorted(got) == sorted(least_hashes(rows.repartition(2), ["id"], 300).collect())
    assert least_hashes(rows, ["k"], 2000).count() == 2000  # thirds of equal keys
    assert least_hashes(rows, ["id"], 9000).count() == 5000
