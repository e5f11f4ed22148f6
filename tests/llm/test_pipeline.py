import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from test_operators import _classes, chosen_by_hand, votes_by_hand
from thicket.llm import mixing, quality
from thicket.llm.shared import materialise, table

SMALL = "/root/testdata/sf0.001"


def test_stages_work_on_what_is_left(spark):
    docs = table(spark, SMALL, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = materialise(stage(spark, docs, SMALL), f"test-{name}")
        counts.append(docs.count())
        assert docs.columns == (columns if name != "tokenize" else ["doc_id", "start", "n_tokens", "ids_crc32"])
    assert counts[0] > counts[1] > counts[2] >= counts[3] > 0
    assert counts[4] == counts[5]


def test_rows_of_null_and_repeated_ids(spark, tmp_path):
    words = lambda n, seed: " ".join(f"w{seed}x{i}" for i in range(n))
    item, copy = words(60, 1), words(80, 2)
    near = copy.replace("w2x40", "changed")
    rows = [(None, "a " + item), (None, words(50, 3)), (7, "b " + item), (7, words(50, 4)), (5, copy), (3, near), (None, copy), (5, words(50, 5)), (3, words(50, 6)), (9, words(50, 7)), (9, words(50, 7)), (None, words(50, 8)), (None, words(50, 8))]
    spark.createDataFrame([("i", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = materialise(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n long").repartition(3), "test-rows")
    kept = lambda stage: sorted(((r["doc_id"], r["text"]) for r in stage(spark, docs, str(tmp_path)).collect()), key=str)
    assert kept(corpus_pipeline.drop_leaks) == sorted((r for r in rows if item not in r[1]), key=str)

    def alike(a, b):  # 5-word k-mers; no words repeat in a text
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
        return len(a & b) >= 0.8 * len(a | b)

    want = []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if not any(alike(t, u) for _, u in want):
            want.append((i, t))
    assert kept(corpus_pipeline.drop_near_copies) == sorted(want, key=str)


CLASHES = "predicted int, score double, held_out long, `end` long, whole long, epoch long, row long, number long, class_id long, class long, doc long, n_hit long, key string, n long, _mix_row long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with null, empty, blank and very long texts, ties, repeated rows, null and repeated ids and clashing columns, with labels and a
    benchmark."""
    folder = tmp_path_factory.mktemp("odd")
    words = lambda n, seed: " ".join(f"w{seed}x{i}" for i in range(n))
    item = words(40, 999)
    rows = [(i, words(12 + i % 40, i), "en", f"src{i % 4}") for i in range(40)] + [(100 + i, "BUY NOW!!! " * 20 + str(i), "de", "src1") for i in range(20)]
    near = words(80, 500)
    rows += [(200, near, "en", "src0"), (201, near.replace("w500x40", "new"), "en", "src0"), (None, near, "fr", None), (202, near, None, "src2"), (202, near, None, "src2")]
    rows += [(300, "a " + item, "en", "src0"), (None, "b " + item + " c", "en", "src0"), (301, item[: len(item) // 2] + " c", "en", "src0"), (0, words(30, 600), "en", "src3")]
    rows += [(400, None, "en", "src0"), (401, "", "en", "src0"), (None, None, None, None), (402, " \n ", "de", "src5"), (403, words(5_000, 700), "en", "src1"), (404, words(5_000, 701) + " " + item, "en", "src1")]
    spark.createDataFrame([("i1", item), ("i2", None), ("i3", "")], "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)] + [(100 + i, 0, 0) for i in range(20)] + [(None, 1, 0), (5, None, 1), (400, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    schema = f"doc_id long, text string, lang string, source string, {CLASHES}"
    filled = [(*r, 1, 0.5, *[n] * 10, "k", n, n) for n, r in enumerate(rows)]
    return spark.createDataFrame(filled, schema).repartition(3), [(*r, n) for n, r in enumerate(rows)], str(folder)


def _kept(out):
    """Of each returned row what it was and its number, which every clashing column must still hold."""
    rows = out.collect()
    assert all(r["n"] == r["epoch"] == r["end"] == r["row"] == r["number"] == r["_mix_row"] and r["predicted"] == 1 and r["score"] == 0.5 and r["key"] == "k" for r in rows)
    return sorted((r["n"] for r in rows))


def test_each_stage_by_hand(spark, odd):
    docs, rows, folder = odd
    docs = materialise(docs, "test-odd")
    model = quality.train(docs, table(spark, folder, "labels"))
    score = {t: votes_by_hand(model, t) for t in {r[1] for r in rows}}
    sure = {n for *_, t, _, _, n in rows if abs(score[t] - quality.THRESHOLD) > 0.02}
    assert len(sure) == len(rows)
    assert _kept(corpus_pipeline.keep_quality(spark, docs, folder)) == [n for _, t, _, _, n in rows if score[t] >= quality.THRESHOLD]

    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    classes = dict(zip([r[4] for r in ordered], _classes([(r[4], r[1]) for r in ordered]), strict=True))
    near = corpus_pipeline.drop_near_copies(spark, docs, folder).collect()
    # of rows that are equal in id and text any one may stay
    of = {n: (i, t) for i, t, _, _, n in rows}
    assert sorted((str(of[r["n"]]) for r in near)) == sorted(str(of[n]) for n in {classes[n] for n in classes})

    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    item = find(" ".join(f"w999x{i}" for i in range(40)))
    windows = {tuple(item[i : i + 10]) for i in range(31)}
    held = lambda w: any(tuple(w[i : i + 10]) in windows for i in range(len(w) - 9))
    leaks = {n for _, t, _, _, n in rows if held(find(t))}
    assert len(leaks) == 4
    assert _kept(corpus_pipeline.drop_leaks(spark, docs, folder)) == [n for *_, n in rows if n not in leaks]

    want = chosen_by_hand([r[:4] for r in rows], mixing.SHARE, mixing.EPOCHS)
    mixed = corpus_pipeline.mix_sources(spark, docs, folder)
    assert mixed.columns == docs.columns
    assert sorted(str(tuple(r)[:4]) for r in mixed.collect()) == sorted(str(r) for r, _ in want)
    assert set(_kept(mixed)) <= {r[4] for r in rows}

    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer, start, ids = Tokenizer.from_file(P.path("word_bpe_49k.json")), 0, []
    for i, t in sorted((r[:2] for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[1] or "")):
        own = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        ids.append((str(i), start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    assert sorted((str(a), *b) for a, *b in corpus_pipeline.write_tokens(spark, docs, folder).collect()) == sorted(ids)


def test_stages_of_an_empty_table(spark, odd):
    docs, _, folder = odd
    empty = materialise(docs.limit(0), "test-empty")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert set(e.oracle_sql()) <= names
