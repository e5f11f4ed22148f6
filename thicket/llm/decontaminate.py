"""Benchmark decontamination by winnowing.

Of every ``window`` (10) consecutive words, the least hash of its ``GRAM``-word grams is a fingerprint. Equal
windows have equal fingerprints, so every shared span of ``window`` words or more shares one: documents and
items are joined on fingerprints. Each hit is then extended over all windows of that fingerprint, which are
compared with the items' windows by the hashes of the window and of each of its words.
An item of fewer words is one window of its own length, compared in the same way with windows of that length.

Where the items' windows number at most ``broadcast_windows``, they go to every task; beyond it, fingerprints and
windows are joined in Spark. Both ways give the same rows.

Defined cases: null texts have no words; items without words never occur; a null item_id is written as ``null``;
items of equal id count once; repeated documents are each judged; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import materialise
from thicket.llm.words import ALNUM, LOWER, Words, _WORD_BASE, chunks, mix, ranges_hash, split_words

WINDOW, GRAM = 10, 6
#: About 90 bytes each in every task: 45 MB at most.
BROADCAST_WINDOWS = 500_000
RESULT = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def fingerprints(words: Words, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprint of every window, and the windows' positions."""
    gram = min(GRAM, window)
    n = len(words.hash)
    grams, at = words.windows(gram)
    low = np.full(n + window, np.uint64(0xFFFFFFFFFFFFFFFF))
    low[at] = grams
    grams = low.copy()
    for shift in range(1, window - gram + 1):
        np.minimum(low[:n], grams[shift : shift + n], out=low[:n])
    ok = np.flatnonzero(np.arange(window, window + n) <= np.repeat(words.first[1:], words.counts))
    return low[ok], ok


def window_hash(words: Words, at: np.ndarray, size: int) -> np.ndarray:
    return mix(ranges_hash(words.hash, at, at + size, _WORD_BASE) ^ np.uint64(size))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, size, fingerprint, h and the word hashes of every window of every item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"), ALNUM, LOWER)
            counts = words.counts
            for size in {min(window, int(c)) for c in counts if c}:
                finger, at = fingerprints(words, size)
                owner = words.doc[at]
                mine = counts[owner] >= size if size == window else counts[owner] == size
                finger, at, owner = finger[mine], at[mine], owner[mine]
                each = words.hash[at[:, None] + np.arange(size)].astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(pa.array(owner)), pa.array(np.full(len(at), size, np.int32)), pa.array(finger.view(np.int64)), pa.array(window_hash(words, at, size).view(np.int64)), pa.array([row.tobytes() for row in each], pa.binary())],
                    ["item", "size", "finger", "h", "each"],
                )

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    return items.mapInArrow(run, "item string, size int, finger long, h long, each binary").distinct()


class _Items:
    """Item windows of one size, sorted for look-ups."""

    def __init__(self, size: int, rows: pa.Table) -> None:
        h = np.asarray(rows.column("h")).view(np.uint64)
        rows = rows.take(pa.array(np.argsort(h, kind="stable"))).combine_chunks()
        each = rows.column("each").chunk(0) if len(rows) else pa.array([], pa.binary())
        self.size, self.item = size, np.array(rows.column("item").to_pylist(), object)
        self.h = np.asarray(rows.column("h")).view(np.uint64)
        self.each = np.frombuffer(b"".join(x.as_buffer() for x in each), "<u8").reshape(len(rows), size)
        self.finger = np.unique(np.asarray(rows.column("finger")).view(np.uint64))

    def hits(self, words: Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position, item window) of equal windows."""
        finger, at = fingerprints(words, self.size)
        if not len(at):
            return at, at
        change = np.r_[True, finger[1:] != finger[:-1]]
        runs = finger[change]
        near = self.finger[np.minimum(np.searchsorted(self.finger, runs), len(self.finger) - 1)] == runs
        at = at[near[np.cumsum(change) - 1]]
        h = window_hash(words, at, self.size)
        low, high = np.searchsorted(self.h, h), np.searchsorted(self.h, h, "right")
        pos = np.repeat(at, high - low)
        which = np.repeat(low, high - low) + np.arange(len(pos)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        same = (words.hash[pos[:, None] + np.arange(self.size)] == self.each[which]).all(1)
        return pos[same], which[same]


def _result(counts: np.ndarray, hits: list[tuple[np.ndarray, np.ndarray, int, list[str]]]) -> list[pa.Array]:
    """Columns of RESULT. hits: (document, position in it, size, item names)."""
    n = len(counts)
    owner = np.concatenate([h[0] for h in hits]) if hits else np.zeros(0, np.int64)
    items: list[set[str]] = [set() for _ in range(n)]
    spans: list[list[dict]] = [[] for _ in range(n)]
    n_hit = np.zeros(n, np.int64)
    if len(owner):
        at = np.concatenate([h[1] for h in hits])
        end = at + np.concatenate([np.full(len(h[0]), h[2]) for h in hits])
        for d, name in zip(owner.tolist(), (x for h in hits for x in h[3]), strict=True):
            items[d].add(name)
        for d, a, b in sorted(zip(owner.tolist(), at.tolist(), end.tolist(), strict=True)):
            if spans[d] and a <= spans[d][-1]["end"]:
                spans[d][-1]["end"] = max(b, spans[d][-1]["end"])
            else:
                spans[d].append({"start": a, "end": b})
        for d in set(owner.tolist()):
            n_hit[d] = sum(s["end"] - s["start"] for s in spans[d])
    return [pa.array(counts, pa.int64()), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, _SPANS)]


def _broadcast_way(docs: DataFrame, windows: DataFrame) -> DataFrame:
    rows = windows.toArrow()  # ``broadcast_windows`` rows at most, as Arrow columns
    sizes = np.asarray(rows.column("size"))
    shared = docs.sparkSession.sparkContext.broadcast([_Items(int(size), rows.filter(pa.array(sizes == size))) for size in np.unique(sizes)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"), ALNUM, LOWER)
            hits = []
            for items in shared.value:
                pos, which = items.hits(words)
                if len(pos):
                    doc = np.searchsorted(words.first, pos, "right") - 1
                    hits.append((doc, pos - words.first[doc], items.size, items.item[which].tolist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_result(words.counts, hits)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.mapInArrow(run, f"doc_id long, {RESULT}")


def _join_way(docs: DataFrame, windows: DataFrame) -> DataFrame:
    """Fingerprints, then windows, joined in Spark; rows are known by a hash of doc_id and text."""
    key = F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.coalesce("text", F.lit(""))), 256)
    docs = docs.withColumn("key", key)
    once = docs.dropDuplicates(["key"])
    sizes = sorted(r["size"] for r in windows.select("size").distinct().collect())  # at most ten

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"), ALNUM, LOWER)
            for size in sizes:
                finger, at = fingerprints(words, size)
                owner = words.doc[at]
                new = np.r_[True, (finger[1:] != finger[:-1]) | (owner[1:] != owner[:-1])][: len(at)]
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(owner[new])), pa.array(np.full(int(new.sum()), size, np.int32)), pa.array(finger[new].view(np.int64))], ["key", "size", "finger"])

    fingers = windows.select("size", "finger").distinct()
    near = once.mapInArrow(marks, "key string, size int, finger long").join(fingers, ["size", "finger"]).groupBy("key").agg(F.collect_set("finger").alias("fingers"))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"), ALNUM, LOWER)
            wanted = np.unique(np.asarray(batch.column("fingers").flatten(), np.int64).view(np.uint64))
            for size in sizes:
                finger, at = fingerprints(words, size)
                at = at[np.isin(finger, wanted)]
                owner = words.doc[at]
                each = words.hash[at[:, None] + np.arange(size)].astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column("key").take(pa.array(owner)), pa.array(np.full(len(at), size, np.int32)), pa.array(window_hash(words, at, size).view(np.int64)), pa.array([r.tobytes() for r in each], pa.binary()), pa.array(at - words.first[owner], pa.int64())],
                    ["key", "size", "h", "each", "at"],
                )

    found = once.join(near, "key").mapInArrow(places, "key string, size int, h long, each binary, at long")
    hits = found.join(windows.select("item", "size", "h", "each"), ["size", "h", "each"])
    hits = hits.groupBy("key").agg(F.collect_set("item").alias("of"), F.collect_set(F.struct("at", "size")).alias("places"))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = split_words(batch.column("text"), ALNUM, LOWER)
            columns = _result(words.counts, [])
            spans, n_hit = [], []
            for got in batch.column("places").to_pylist():
                own: list[dict] = []
                for a, size in sorted((p["at"], p["size"]) for p in got or []):
                    if own and a <= own[-1]["end"]:
                        own[-1]["end"] = max(own[-1]["end"], a + size)
                    else:
                        own.append({"start": a, "end": a + size})
                spans.append(own)
                n_hit.append(sum(s["end"] - s["start"] for s in own))
            items = [sorted(x or []) for x in batch.column("of").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), columns[0], pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, _SPANS)], ["doc_id", "n_words", "n_hit", "items", "spans"])

    return docs.join(hits, "key", "left").select("doc_id", "text", "of", "places").mapInArrow(close, f"doc_id long, {RESULT}")


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit (words inside an item's window), items (sorted
    ids of the items with such windows), spans (word positions, end exclusive)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    windows = materialise(item_windows(benchmark, window), "benchmark-windows")
    small = windows.limit(broadcast_windows + 1).count() <= broadcast_windows
    return _broadcast_way(docs, windows) if small else _join_way(docs, windows)
