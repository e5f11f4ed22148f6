"""Near-duplicate documents by order MinHash, checked by a banded alignment.

A document is its sequence of ``K``-word k-mers (lower case for A-Z, white space collapsed), each labelled by how often it
has occurred before, so that labels are unique. A *sketch* keeps the ``KEEP`` k-mers of the least hashes, in text order: it
agrees for two texts if they share these k-mers and their order, so it follows edit similarity. ``ROWS`` sketches make a
band; documents that agree in one of ``BANDS`` bands are candidates.

Similarity of two texts: of the longest common subsequence of their labelled k-mers, m long, m / (a + b - m), where
a and b count k-mers: the Jaccard similarity of k-mers that keep their order. ``THRESHOLD`` 0.8 or more is a near
copy. Labels are unique, so the subsequence is a longest increasing run of matched positions; only matches in the
band of offsets that the threshold allows can lie on it.

In a bucket every member is compared with its head, the member that shares most buckets with others; never all with all. Where a
bucket still holds several classes, its members meet again in finer buckets (equal in two bands), which break up what
a shared passage brought together. Of these documents Spark counts the k-mers that another of them has: pairs that can't share
enough of them aren't compared, nor are pairs whose signatures (``SIGN_BITS`` bits of minima) are too far apart for the threshold,
which settles clouds of copies that differ too much from each other. For the rest, round by round, 64, 1024, ... drawn members outside of a bucket's largest class are compared with those of other classes and leave, until no bucket holds two
classes. The same rounds then run over the buckets themselves, for pairs that agree in a single band. No bucket is capped; buckets of one class cost nothing more.

Rows are numbered first and everything goes by these numbers; ids come back at the end only.

Defined cases: a null or blank text is equal to others of that kind only, and has no words. Texts of fewer than K words are one
k-mer. Exact copies (equal words) are one node, so groups of any size cost one row each. Rows that share a doc_id, the null one included, are judged each by
its own text. The class of rows without any doc_id has the null id. Very long texts are compared as wholes. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import SMALL, few, if_small, join_counted, materialise
from thicket.llm.words import LOWER, SPACED, Words, _WORD_BASE, chunks, mix, ranges_hash, split_words

K, KEEP, ROWS, BANDS, THRESHOLD = 5, 2, 2, 16, 0.8
#: Bits of a signature, and standard deviations that a pair at the threshold may fall short of its expected agreement (three
#: in a million fall shorter).
SIGN_BITS, SIGN_SLACK = 512, 4.5


def labelled(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-mers with their occurrence labels, and the first of each document (documents + 1)."""
    counts = words.counts
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    first = np.concatenate([[0], np.cumsum(n)])
    owner = np.repeat(np.arange(len(n)), n)
    at = words.first[owner] + np.arange(first[-1]) - first[owner]
    grams = mix(ranges_hash(words.hash, at, np.minimum(at + k, words.first[owner + 1]), _WORD_BASE))
    order = np.lexsort((at, grams, owner))
    g, o = grams[order], owner[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (o[1:] != o[:-1])
    run = np.flatnonzero(new)
    label = np.empty(len(g), np.uint64)
    label[order] = (np.arange(len(g)) - run[np.cumsum(new) - 1]).astype(np.uint64)
    return mix(grams ^ mix(label + np.uint64(1))) if len(grams) else grams, first


def sketches(grams: np.ndarray, first: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key for each document and band: KEEP least k-mers in text order, of ``rows`` sketches. First is strictly growing."""
    begin, out = first[:-1], np.zeros((len(first) - 1, bands), np.uint64)
    sizes = np.diff(first)
    for b in range(bands):
        key = np.zeros(len(begin), np.uint64)
        for r in range(rows):
            h = mix(grams + np.uint64((b * rows + r + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
            one = np.minimum.reduceat(h, begin)
            at = np.flatnonzero(h == np.repeat(one, sizes))
            h[at] = np.uint64(0xFFFFFFFFFFFFFFFF)
            two = np.minimum.reduceat(h, begin)
            after = np.flatnonzero(h == np.repeat(two, sizes))
            # hashes of labelled k-mers are unique in a document, but for what collides: take the first place
            place_one = at[np.searchsorted(at, begin)]
            place_two = after[np.minimum(np.searchsorted(after, begin), len(after) - 1)]
            swap = place_two < place_one
            key = mix(key * np.uint64(3) ^ np.where(swap, two, one)) + np.where(swap, one, two)
        out[:, b] = mix(key)
    return out


def signatures(grams: np.ndarray, first: np.ndarray) -> np.ndarray:
    """SIGN_BITS bits a document, in 64-bit words: each a bit of the least of its k-mers' hashes. Two documents agree in a share of
    (1 + J) / 2 of them, J their Jaccard similarity, which is no less than the ordered one."""
    bits = np.zeros((len(first) - 1, SIGN_BITS), bool)
    some = np.flatnonzero(np.diff(first) > 0)
    if len(some):
        begin = first[some]
        for j in range(SIGN_BITS):
            odd = np.uint64((j * 2 + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 | 1)
            bits[some, j] = mix(np.minimum.reduceat(grams * odd, begin)) & np.uint64(1)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def similarity(a: np.ndarray, b: np.ndarray, threshold: float) -> float:
    """Ordered Jaccard similarity of two sequences of unique values; below the threshold 0 may be given instead."""
    least = threshold / (1 + threshold) * (len(a) + len(b))
    if min(len(a), len(b)) < least - 1e-9 or not len(a):
        return 0.0
    _, at_a, at_b = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if len(at_a) < least - 1e-9:
        return 0.0
    order = np.argsort(at_a)
    at_a, at_b = at_a[order], at_b[order]
    band = len(a) + len(b) - 2 * least  # so many k-mers at most have no partner
    near = np.abs(at_a - at_b) <= band
    at_b = at_b[near]
    m = _increasing(at_b)
    return m / (len(a) + len(b) - m) if m else 0.0


def _increasing(x: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if not len(x) or (np.diff(x) > 0).all():
        return len(x)
    from bisect import bisect_left

    tops: list[int] = []
    for v in x.tolist():
        if not tops or v > tops[-1]:
            tops.append(v)
        else:
            tops[bisect_left(tops, v)] = v
    return len(tops)


def _sketch_table(docs: DataFrame, k: int, bands: int, rows: int) -> DataFrame:
    """doc, doc_id, two hashes of the word sequence, n_words, a key for each band (none for texts without words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            words = split_words(batch.column("text"), SPACED, LOWER)
            grams, first = labelled(words, k)
            some = np.flatnonzero(np.diff(first) > 0)
            keys = sketches(grams, np.append(first[some], first[-1]), bands, rows) if len(some) else np.zeros((0, bands), np.uint64)
            ends = np.zeros(len(batch) + 1, np.int32)
            ends[some + 1] = bands
            a, b = words.first[:-1], words.first[1:]
            one = ranges_hash(words.hash, a, b, _WORD_BASE)
            two = ranges_hash(mix(words.hash ^ np.uint64(77)), a, b, _WORD_BASE)
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(ends), pa.int32()), pa.array(keys.ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("doc_id"), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), pa.array(words.counts, pa.int64()), lists], ["doc", "doc_id", "one", "two", "n_words", "keys"])

    return docs.select("doc", "doc_id", "text").mapInArrow(run, "doc long, doc_id long, one long, two long, n_words long, keys array<long>")


def _checked(pairs: DataFrame, texts: DataFrame, k: int, threshold: float) -> DataFrame:
    """The pairs (a, b; a written table) and whether their texts are near. Few pairs go to the texts, and only the texts that they need are shuffled."""
    left, wanted = texts.select(F.col("doc").alias("a"), F.col("text").alias("text_a")), if_small(pairs)
    right = texts.select(F.col("doc").alias("b"), F.col("text").alias("text_b")).join(wanted, "b")
    if wanted is not pairs:
        left = left.join(F.broadcast(few(pairs.select("a").distinct(), SMALL)), "a", "left_semi")
    both = few(right.join(left, "a"), pairs.count(), 500)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, None  # sorted by a, so that its k-mers are made once
        for batch in chunks(batches, "text_b", 1 << 20):
            b_grams, b_first = labelled(split_words(batch.column("text_b"), SPACED, LOWER), k)
            a_ids, a_text, near = batch.column("a").to_pylist(), batch.column("text_a"), []
            for i, a in enumerate(a_ids):
                if a != last:
                    last, kept = a, labelled(split_words(a_text.slice(i, 1), SPACED, LOWER), k)[0]
                near.append(similarity(kept, b_grams[b_first[i] : b_first[i + 1]], threshold) >= threshold)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(near)], ["a", "b", "near"])

    return both.sortWithinPartitions("a").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, near boolean")


def _stars(entries: DataFrame) -> DataFrame:
    """Of entries (bucket x, y; doc) those that share a bucket, with the bucket's head: the member whose buckets hold most, which in
    a cloud of copies is the text that they come from."""
    sizes = materialise(few(entries.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), entries.count()), "neardup-sizes")
    # written first, here and below: a join of plain tables is one whose hot keys Spark can split
    shared = materialise(entries.join(if_small(sizes), ["x", "y"]), "neardup-shared")
    n = shared.count()
    fame = if_small(materialise(few(shared.groupBy("doc").agg(F.sum("n").alias("fame")), n), "neardup-fame"))
    order = F.struct((-F.col("fame")).alias("f"), F.xxhash64("doc", "x").alias("h"), F.col("doc").alias("doc"))
    heads = shared.select("x", "y", "doc").join(fame, "doc").groupBy("x", "y").agg(F.min(order).alias("head")).select("x", "y", F.col("head.doc").alias("head"))
    return shared.select("x", "y", "doc").join(if_small(materialise(few(heads, n), "neardup-heads")), ["x", "y"])


def _common(texts: DataFrame, k: int) -> DataFrame:
    """doc, size (k-mers) and common: how many of them another of these texts has too. No two texts share more than the lesser
    ``common``, so pairs for which that is too little for the threshold needn't be compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 1 << 20):
            grams, first = labelled(split_words(batch.column("text"), SPACED, LOWER), k)
            signs = signatures(grams, first)
            lists = [pa.ListArray.from_arrays(pa.array(o, pa.int32()), pa.array(v.view(np.int64))) for o, v in ((first, grams), (np.arange(len(batch) + 1) * signs.shape[1], signs.ravel()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *lists], ["doc", "grams", "sign"])

    lists = materialise(texts.select("doc", "text").mapInArrow(run, "doc long, grams array<long>, sign array<long>"), "neardup-grams")
    rows = lists.select("doc", F.explode("grams").alias("gram"))
    repeated = materialise(rows.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "neardup-repeated")
    counts = rows.join(if_small(repeated), "gram").groupBy("doc").agg(F.count(F.lit(1)).alias("common"))
    counts = if_small(materialise(few(counts, lists.count()), "neardup-counts"))
    return lists.select("doc", F.size("grams").cast("long").alias("size"), "sign").join(counts, "doc")


def _mixed(entries: DataFrame, rows: int) -> DataFrame:
    """Buckets (x, y) of entries (x, y, doc, class; ``rows`` at most) that hold several classes: the class that most are of, and how many aren't."""
    sizes = few(entries.groupBy("x", "y", "class").agg(F.count(F.lit(1)).alias("c")), rows)
    found = sizes.groupBy("x", "y").agg(F.max(F.struct("c", "class")).alias("top"), F.sum("c").alias("n")).where("n > top.c")
    return materialise(few(found.select("x", "y", F.col("top.class").alias("major"), (F.col("n") - F.col("top.c")).alias("minor")), rows), "neardup-mixed")


def _classed(entries: DataFrame, class_of: DataFrame) -> DataFrame:
    out = entries.join(if_small(class_of), "doc", "left")
    return out.select("x", "y", "doc", F.coalesce("class", "doc").alias("class"), (F.xxhash64("doc", "x", "y").bitwiseAND(F.lit((1 << 52) - 1)) / float(1 << 52)).alias("u"))


def classes(links: DataFrame) -> DataFrame:
    """Connected components: (doc, class), class the least doc, of links (a, b). Hook to the least neighbour, then to its
    parent, until nothing changes; each round cuts the lineage by a written table."""
    edges = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    edges = materialise(few(edges, links.count()), "links")
    both = edges.union(edges.select("b", "a")).toDF("v", "u")
    n = 2 * edges.count()
    label = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("c"))
    label = materialise(few(label, n), "classes")
    while True:
        known = if_small(label)
        near = few(both.join(known.select(F.col("v").alias("u"), F.col("c").alias("cu")), "u").groupBy("v").agg(F.min("cu").alias("m")), n)
        hooked = near.join(known, "v").select("v", F.col("c").alias("old"), F.least("c", "m").alias("c"))
        # the parent's label: long chains shorten by half in each round
        jumped = hooked.join(known.select(F.col("v").alias("c"), F.col("c").alias("up")), "c", "left").select("v", "old", F.least("c", F.coalesce("up", "c")).alias("c"))
        jumped = materialise(few(jumped, n), "classes")
        if jumped.where("old <> c").limit(1).count() == 0:
            return jumped.select(F.col("v").alias("doc"), F.col("c").alias("class"))
        label = jumped.select("v", "c")


def near_copies(docs: DataFrame, k: int = K, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, signed: bool = True, numbered: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id (the least doc_id of its class of near copies), n_links
    (different texts that it was compared with and found near to; once two are in one class, their own link isn't looked for). ``class_id``
    is doc_id where nothing is near. ``signed``: pairs that signatures put too far apart aren't compared; without it every pair that
    may share enough k-mers is, which is exact among candidates and slower in clouds of copies. ``numbered``: ``docs`` is a written table whose doc_ids are unique."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if numbered:
        docs = docs.withColumn("doc", F.col("doc_id"))
    else:
        docs = materialise(docs.withColumn("doc", F.monotonically_increasing_id()), "neardup-rows")
    sketch = materialise(_sketch_table(docs, k, bands, rows), "neardup-sketches")
    same = ["one", "two", "n_words"]
    n = sketch.count()
    nodes = materialise(few(sketch.groupBy(*same).agg(F.min("doc").alias("node"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), n), "neardup-nodes")
    head = sketch.join(if_small(nodes.select(F.col("node").alias("doc"))), "doc", "left_semi")

    entries = materialise(head.select("doc", F.posexplode("keys").alias("band", "key")).select(F.col("key").alias("x"), F.col("band").cast("long").alias("y"), "doc"), "neardup-entries")
    stars = materialise(_stars(entries), "neardup-stars")
    near = stars.where("doc <> head").select(F.least("doc", "head").alias("a"), F.greatest("doc", "head").alias("b")).distinct()
    near = materialise(few(near, stars.count()), "neardup-candidates")
    ends = materialise(few(near.select(F.explode(F.array("a", "b")).alias("doc")).distinct(), 2 * near.count()), "neardup-ends")
    # beyond few documents by shuffle: those to compare grow with the input, so they are no table to broadcast
    few_ends = if_small(ends)
    texts = materialise(docs.select("doc", "text").join(few_ends if few_ends is not ends else ends.hint("merge"), "doc", "left_semi"), "neardup-texts")
    known = materialise(_checked(near, texts, k, threshold), "neardup-pairs")
    class_of = classes(known.where("near"))

    # members of buckets that hold several classes meet again where they agree in two bands
    again = _classed(stars.select("x", "y", "doc"), class_of)
    again = materialise(again.join(if_small(_mixed(again, stars.count())).select("x", "y"), ["x", "y"]).select("x", "y", "doc"), "neardup-again")
    two = materialise(few(again.groupBy("doc").agg(F.sort_array(F.collect_set(F.struct("y", "x"))).alias("k")), again.count(), 20_000), "neardup-two")  # BANDS entries at most
    finer = F.explode(F.expr("flatten(transform(k, p -> transform(filter(k, q -> q.y > p.y), q -> struct(p.x AS p, q.x AS q, p.y * 1000 + q.y AS y))))"))
    finer = two.select("doc", finer.alias("e")).select(F.xxhash64("e.p", "e.q").alias("x"), "e.y", "doc")
    # documents whose other k-mers are their own alone can't be near to any
    common = materialise(_common(texts.join(if_small(two.select("doc")), "doc", "left_semi"), k), "neardup-common")
    possible = common.where(F.col("common") >= threshold * F.col("size") - 1e-9)
    slots = F.map_from_entries(F.transform("k", lambda e: F.struct(e["y"], e["x"])))
    slotted = two.select("doc", slots.alias("m")).select("doc", F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.try_element_at("m", b.cast("long"))).alias("slots"))
    # small ones are broadcast: of some 300 bytes a document
    possible = materialise(possible.join(if_small(slotted, SMALL // 4), "doc"), "neardup-possible")
    some = if_small(possible, SMALL // 4)
    least, agree = threshold / (1 + threshold), (1 + threshold) / 2
    apart = int(SIGN_BITS * (1 - agree) + SIGN_SLACK * math.sqrt(SIGN_BITS * agree * (1 - agree)))
    # a pair may share many buckets: it is compared in the first that two bands give, or else in that of its only band
    agreeing = "(" + " + ".join(f"if(slots[{b}] = h_slots[{b}], {1 << b}L, 0L)" for b in range(bands)) + ")"
    in_two = f"({agreeing} & (shiftleft(2L, int(y % 1000)) - 1L)) = shiftleft(1L, int(y div 1000)) + shiftleft(1L, int(y % 1000))"
    for entries, here in ((finer, in_two), (again, f"{agreeing} = shiftleft(1L, int(y))")):
        heads, rest = 64, materialise(entries.join(if_small(possible.select("doc")), "doc", "left_semi"), "neardup-rest")
        n = rest.count()
        while True:
            # of any two classes one isn't the bucket's largest: ever more drawn members of such classes are compared with all
            # of other classes, and leave
            rest = _classed(rest, class_of)
            mixed = _mixed(rest, n)
            if mixed.limit(1).count() == 0:
                break
            live = materialise(rest.join(if_small(mixed), ["x", "y"]).join(some, "doc").withColumn("drawn", (F.col("class") != F.col("major")) & (F.col("u") <= F.lit(float(heads)) / F.col("minor"))), "neardup-live")
            drawn = live.where("drawn").select("x", "y", *(F.col(c).alias(f"h_{c}") for c in ("doc", "class", "size", "common", "sign", "slots")))
            enough = F.least("common", "h_common") >= least * (F.col("size") + F.col("h_size")) - 1e-9
            # written out, so that it is compiled
            close = F.expr(" + ".join(f"bit_count(sign[{i}] ^ h_sign[{i}])" for i in range(SIGN_BITS // 64)) + f" <= {apart}")
            some_drawn = if_small(drawn, SMALL // 4)
            # a broadcast leaves the comparing to the tasks that read, so these rows are dealt out evenly
            spread = live if some_drawn is drawn else live.repartition(max(4 * live.sparkSession.sparkContext.defaultParallelism, live.count() // 5000))
            pairs = spread.join(some_drawn, ["x", "y"]).where((F.col("class") != F.col("h_class")) & enough & (close if signed else F.lit(True)) & F.expr(here))
            pairs = pairs.select(F.least("doc", "h_doc").alias("a"), F.greatest("doc", "h_doc").alias("b")).distinct()
            pairs = materialise(pairs.join(if_small(known.select("a", "b")), ["a", "b"], "left_anti"), "neardup-candidates")
            new = materialise(_checked(pairs, texts, k, threshold), "neardup-pairs")
            known = known.unionByName(new)
            if new.where("near").limit(1).count():
                class_of = classes(known.where("near"))
            rest, heads = live.where("not drawn").select("x", "y", "doc"), heads * 16
    found = known.where("near").select("a", "b")
    degree = found.select(F.explode(F.array("a", "b")).alias("doc")).groupBy("doc").agg(F.count(F.lit(1)).alias("n_links"))
    linked = few(degree, 2 * known.count()).join(if_small(class_of), "doc").select(F.col("doc").alias("node"), "class", "n_links")
    full = nodes.join(if_small(materialise(linked, "neardup-linked")), "node", "left").withColumns({"class": F.coalesce("class", "node"), "n_links": F.coalesce("n_links", F.lit(0))})
    full = materialise(full.withColumnRenamed("n", "copies"), "neardup-full")
    least = materialise(few(full.groupBy("class").agg(F.min("least").alias("class_id"), F.count(F.lit(1)).alias("n")), full.count()), "neardup-least")
    named = materialise(join_counted(full, least, ["class"]).select(*same, "class_id", "n_links", F.col("copies").alias("n")), "neardup-named")
    return join_counted(sketch.select("doc_id", *same), named, same).select("doc_id", "class_id", "n_links")
