"""Removal of repeated passages: Rabin-Karp hashes of all word windows, counted in Spark.

1. Every text's windows of ``WINDOW`` words are hashed. A window's *anchor* is the least of the hashes of its
   ``GRAM``-word grams, so equal windows have equal anchors, and neighbours mostly share one.
2. Spark counts the distinct anchors of all documents by the documents that hold them. A window that repeats
   has an anchor that repeats; only windows of repeated anchors go on, as (window hash, anchor): 128 bits.
3. Spark finds the least document of each window, and joins back the windows of larger documents.
4. Their positions merge into maximal intervals, which are cut.

Documents whose whole word sequence repeats are settled by one hash of it, so groups of copies, however
large, don't send windows. Aggregations combine before the shuffle; joins back have one row a key on one side, and keys that hold more
than a fixed share of all rows are joined by broadcast, so that no task gets a hot key's rows.

Windows are equal if two hashes of 64 bits agree: that of the window and its anchor, both of words hashed to 64 bits. Words aren't compared.

Defined cases: a null text has no words. A null doc_id counts as larger than any. Rows of equal doc_id don't
remove each other's words. Texts of fewer than ``WINDOW`` words keep everything. Other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import join_counted, materialise
from thicket.llm.words import Words, _WORD_BASE, chunks, mix, ranges_hash, split_words

WINDOW, GRAM = 50, 12
_LAST = (1 << 63) - 1


def _anchors(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Anchor of every window, and the windows' positions."""
    grams, at = words.windows(gram)
    place = np.full(len(words.hash), np.uint64(0xFFFFFFFFFFFFFFFF))
    place[at] = grams
    low, span, want = place, 1, window - gram + 1
    while span < want:
        step = min(span, want - span)
        low = np.minimum(low[: len(low) - step], low[step:]) if len(low) > step else low[:0]
        span += step
    n = len(words.hash)
    ok = np.flatnonzero(np.arange(window, window + n) <= np.repeat(words.first[1:], words.counts))
    return low[ok], ok


def _lists(values: np.ndarray, owner: np.ndarray, n: int) -> pa.ListArray:
    """A list for each of ``n`` owners (``owner`` ascending)."""
    ends = np.searchsorted(owner, np.arange(n + 1))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def _summaries(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """doc, th (text hash), n_words, two hashes of the word sequence, distinct anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"))
            low, at = _anchors(words, window, gram)
            owner = words.doc[at]
            change = np.ones(len(low), bool)
            change[1:] = (low[1:] != low[:-1]) | (owner[1:] != owner[:-1])
            low, owner = low[change], owner[change]
            a, b = words.first[:-1], words.first[1:]
            one = ranges_hash(words.hash, a, b, _WORD_BASE)
            two = ranges_hash(mix(words.hash ^ np.uint64(99)), a, b, _WORD_BASE)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("th"), pa.array(words.counts, pa.int64()), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _lists(low.view(np.int64), owner, len(batch))],
                ["doc", "th", "n_words", "one", "two", "anchors"],
            )

    return docs.select("doc", "th", "text").mapInArrow(run, "doc long, th long, n_words long, one long, two long, anchors array<long>")


def _first_words(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """Windows of repeated anchors: h, anchor, doc, th, at. ``docs`` has doc, th, text, hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"))
            low, at = _anchors(words, window, gram)
            owner = words.doc[at]
            hits = batch.column("hits")
            hits = hits.combine_chunks() if isinstance(hits, pa.ChunkedArray) else hits
            values = np.asarray(hits.flatten(), np.int64).view(np.uint64)
            of = np.repeat(np.arange(len(batch)), np.asarray(hits.value_lengths(), np.int64))
            mine = np.isin(mix(low ^ mix(owner.astype(np.uint64))), mix(values ^ mix(of.astype(np.uint64))))
            low, at, owner = low[mine], at[mine], owner[mine]
            h = mix(ranges_hash(words.hash, at, at + window, _WORD_BASE))
            doc, th = np.asarray(batch.column("doc")), np.asarray(batch.column("th"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(h.view(np.int64)), pa.array(low.view(np.int64)), pa.array(doc[owner]), pa.array(th[owner]), pa.array((at - words.first[owner]).astype(np.int32))],
                ["h", "anchor", "doc", "th", "at"],
            )

    return docs.select("doc", "th", "text", "hits").mapInArrow(run, "h long, anchor long, doc long, th long, at int")


def _cut(rows: DataFrame, window: int) -> DataFrame:
    """n_words, n_removed, intervals, kept text and its hash of each row, which has doc_id, text, whole, cuts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("n_words", "n_removed", "intervals", "kept", "kept_sha256")}
            for text, whole, cuts in zip(*(batch.column(c) for c in ("text", "whole", "cuts")), strict=True):
                words = (text.as_py() or "").encode().split()
                n, kept, spans = len(words), words, []
                if whole.as_py():
                    kept, spans = [], [(0, n)]
                elif cuts.is_valid and len(cuts.values):
                    at = np.unique(np.asarray(cuts.values))
                    new = np.flatnonzero(np.diff(at) > window)
                    begins, ends = at[np.r_[0, new + 1]], at[np.r_[new, len(at) - 1]] + window
                    gone = np.zeros(n + 1, np.int32)
                    np.add.at(gone, begins, 1)
                    np.add.at(gone, ends, -1)
                    keep = np.cumsum(gone[:n]) == 0
                    kept = [w for w, k in zip(words, keep, strict=True) if k]
                    spans = list(zip(begins.tolist(), ends.tolist(), strict=True))
                joined = b" ".join(kept)
                for key, value in zip(out, (n, n - len(kept), [{"start": a, "end": b} for a, b in spans], joined.decode(), hashlib.sha256(joined).hexdigest()), strict=True):
                    out[key].append(value)
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(v, k) for v, k in zip(out.values(), kinds, strict=True))], ["doc_id", *out])

    return rows.select("doc_id", "text", "whole", "cuts").mapInArrow(run, "doc_id long, n_words long, n_removed long, intervals array<struct<start: long, end: long>>, kept string, kept_sha256 string")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, intervals (word positions, end
    exclusive), kept (the words that stay, joined by a space), kept_sha256."""
    if not 0 < gram <= window:
        raise ValueError("gram must lie between 1 and window")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs = docs.withColumn("doc", F.coalesce("doc_id", F.lit(_LAST))).withColumn("th", F.xxhash64("text"))
    seen = materialise(_summaries(docs, window, gram), "substring-anchors").where(F.col("n_words") >= window)
    same = ["one", "two", "n_words"]
    counted = [F.min("doc").alias("least"), F.max("doc").alias("most"), F.count(F.lit(1)).alias("n")]
    copies = materialise(seen.groupBy(*same).agg(*counted).where("least < most").drop("most"), "substring-wholes")
    marked = join_counted(seen, copies, same, "left").withColumn("whole", F.coalesce(F.col("doc") > F.col("least"), F.lit(False)))
    marked = materialise(marked.select("doc", "th", "whole", "anchors"), "substring-copies")
    anchors = marked.where("not whole").select("doc", "th", F.explode("anchors").alias("anchor"))  # made anew at each use: lists are smaller on disk
    repeated = materialise(anchors.groupBy("anchor").agg(*counted).where("least < most").select("anchor", "n"), "substring-repeated")
    hits = join_counted(anchors, repeated, ["anchor"]).groupBy("doc", "th").agg(F.collect_set("anchor").alias("hits"))
    wholes = marked.where("whole").select("doc", "th", F.array().cast("array<long>").alias("hits"), F.lit(True).alias("whole")).distinct()
    touched = hits.withColumn("whole", F.lit(False)).unionByName(wholes)
    # the texts that have something to cut, apart from the rest, so that only they are shuffled again
    split = materialise(docs.join(touched, ["doc", "th"], "left"), "substring-texts")
    open_ = split.where("not whole")
    windows = materialise(_first_words(open_.dropDuplicates(["doc", "th"]), window, gram), "substring-windows")
    least = materialise(windows.groupBy("h", "anchor").agg(*counted).where("least < most").drop("most"), "substring-least")
    cuts = join_counted(windows, least, ["h", "anchor"]).where("doc > least").groupBy("doc", "th").agg(F.collect_list("at").alias("cuts"))
    none = F.lit(None).cast("array<int>").alias("cuts")
    settled = split.where("whole is null or whole").select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), none)
    rest = open_.join(cuts, ["doc", "th"], "left").select("doc_id", "text", "whole", "cuts")
    return _cut(settled.unionByName(rest), window)
