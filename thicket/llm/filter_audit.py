"""What each filter of a corpus loses, in every order in which the filters could be applied.

A document has a mask: a bit for each filter that it fails. Its fate at a step depends on the *set* of filters applied before and on the
next one, not on their order, so the k! orders are paths through a lattice of k * 2^(k-1) edges (applied set, next filter): 80 for five
filters. Every document counts in each of these edges; documents of a part with the same mask and labels count there together, so they
meet as sums of a few bytes. The edges' sums are then joined to the steps of all orders (k * k! rows, a table of fixed size).

Filters: A fewer than ``LEAST_WORDS`` words; B a share of distinct words under ``DISTINCT`` percent; C over ``CAPITALS`` percent A-Z; D a character
of ``MARKS``; E the whole text is that of a smaller doc_id.

Defined cases: a null text is empty, which fails A alone (and E as a copy). Words are maximal runs of anything but space and \\t \\n \\v \\f \\r. A null
doc_id is smaller than none and none is smaller than it, so such rows never fail E, nor make others fail. Rows of equal doc_id aren't copies of each
other. Texts are compared by SHA-256, of any length. Several labels of one doc_id: one that is 1 is enough; rows without labels are neither
good nor toxic; rows that repeat a doc_id each have its labels. A null ``lang`` is the part ''. An empty table has no parts. Other columns aren't read.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import join_counted, materialise

NAMES = "ABCDE"
LEAST_WORDS, DISTINCT, CAPITALS, MARKS = 100, 80, 10, "[#$%&*|]"
_SPACE = " \t\n\x0b\f\r"
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def own_failures(rows: DataFrame) -> DataFrame:
    """``rows`` (text, not null, ...) with ``mask``, the bits of the filters that need the text alone, in place of the text. Words are split once: a
    projection of their own holds them."""
    others = [c for c in rows.columns if c != "text"]
    words = F.split(F.btrim("text", F.lit(_SPACE)), f"[{_SPACE}]+")
    capitals, length = F.length(F.regexp_replace("text", "[^A-Z]+", "")), F.length("text")
    rows = rows.select(*others, words.alias("words"), (100 * capitals.cast("long") > CAPITALS * length.cast("long")).alias("capital"), F.col("text").rlike(MARKS).alias("marked"))
    # a text without words splits into one empty word
    blank = F.element_at("words", 1) == ""
    rows = rows.select(*others, F.size("words").alias("n"), F.size(F.array_distinct("words")).alias("distinct"), blank.alias("blank"), "capital", "marked")
    fails = (F.col("blank") | (F.col("n") < LEAST_WORDS), ~F.col("blank") & (100 * F.col("distinct") < DISTINCT * F.col("n")), F.col("capital"), F.col("marked"))
    return rows.select(*others, sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0)).alias("mask"))


def failures(docs: DataFrame) -> DataFrame:
    """doc_id, part and mask of each row of ``docs`` (doc_id, lang, text). Texts aren't shuffled, their hashes are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = materialise(own_failures(rows.select("*", F.unhex(F.sha2("text", 256)).alias("sha"))), "audit-rows")
    copies = rows.groupBy("sha").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null")
    both = join_counted(rows, materialise(copies, "audit-copies"), ["sha"], "left")
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))
    return both.select("doc_id", "part", (F.col("mask") + F.when(copied, 1 << NAMES.index("E")).otherwise(0)).alias("mask"))


def cells(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, good, toxic (0 or 1) and n, the number of rows of ``masks`` (doc_id, part, mask), by ``labels`` (doc_id, quality, toxic)."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(one("quality").alias("good"), one("toxic").alias("toxic"))
    rows = masks.groupBy("doc_id", "part", "mask").agg(F.count(F.lit(1)).alias("n"))  # a repeated id is a few rows from here on
    rows = rows.join(known, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"), "n")
    return rows.groupBy("part", "mask", "good", "toxic").agg(F.sum("n").alias("n"))


def edges(cells: DataFrame, names: str = NAMES) -> DataFrame:
    """part, applied (bits of the filters applied before), next (bit of the filter applied now) and the sums of what happens there."""
    k = len(names)
    lattice = [(s, 1 << f) for f in range(k) for s in range(1 << k) if not s >> f & 1]
    every = F.array(*(F.struct(F.lit(s).alias("applied"), F.lit(b).alias("next")) for s, b in lattice))
    at = cells.withColumn("edge", F.explode(every)).select("part", "edge.applied", "edge.next", "mask", "good", "toxic", "n")
    fails, gone = F.col("mask").bitwiseAND(F.col("next")) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    total = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    what = (~fails & ~gone, fails & ~gone, fails & gone, F.col("mask") == F.col("next"), fails & ~gone & (F.col("good") == 1), fails & ~gone & (F.col("toxic") == 1))
    return at.groupBy("part", "applied", "next").agg(*(total(c).alias(name) for c, name in zip(what, COUNTS, strict=True)))


def audit(cells: DataFrame, names: str = NAMES) -> DataFrame:
    """part, filter_order, step, COUNTS and shapley, for every part and every step of every order of ``names`` (a letter a filter, in the order of
    the mask's bits). ``shapley``: what the step's filter removes, summed over all orders."""
    k, spark = len(names), cells.sparkSession
    counts = materialise(edges(cells, names), "audit-edges")
    size = F.bit_count("applied")
    orders = F.element_at(F.array(*(F.lit(factorial(s) * factorial(k - 1 - s)) for s in range(k))), size + 1)  # that pass through the edge
    shares = counts.groupBy("part", "next").agg(F.sum(F.col("removed") * orders).alias("shapley"))
    steps = [("".join(names[f] for f in order), i + 1, sum(1 << f for f in order[:i]), 1 << order[i]) for order in permutations(range(k)) for i in range(k)]
    paths = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, applied int, next int"))  # k * k! rows
    return counts.join(shares, ["part", "next"]).join(paths, ["applied", "next"]).select("part", "filter_order", "step", *COUNTS, "shapley")


def sql() -> str:
    """The audit of ``documents`` and ``labels`` in DuckDB, order by order."""
    letters = ", ".join(f"('{x}', {1 << i})" for i, x in enumerate(NAMES))
    return rf"""
        WITH letters(name, bit) AS (VALUES {letters}),
        orders AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
            FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
        steps AS (SELECT filter_order, step, bits[step] AS bit, list_sum([0] || bits[1 : step - 1])::INT AS before FROM orders, (SELECT unnest(range(1, 6))::INT AS step) s),
        texts AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
        masks AS (SELECT doc_id, part, (CASE WHEN len(w) < 100 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 80 * len(w) THEN 2 ELSE 0 END)
            + (CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 4 ELSE 0 END) + (CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END)
            + (CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END) AS mask FROM texts),
        known AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
        cells AS (SELECT part, mask, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, count(*) AS n FROM masks LEFT JOIN known USING (doc_id) GROUP BY ALL),
        counts AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 THEN n ELSE 0 END) AS removed,
            sum(CASE WHEN mask & bit > 0 AND mask & before > 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
            sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND good THEN n ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit > 0 AND mask & before = 0 AND toxic THEN n ELSE 0 END) AS toxic_lost
            FROM cells, steps GROUP BY ALL)
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
            toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM counts
    """
