"""Merkle manifest of a table: a digest a row, trees of digests, and a proof a row that its content is what the root says.

A leaf is the SHA-256 of a row's fields, each its length in bytes, a colon and its value, or ``-`` where null. The leaves of a group, in order, are
hashed in runs of ``FANOUT`` into parents, these again, until one node is left, the group's subroot; the subroots, in order of their groups, are
hashed the same way into the root. Digests are joined as lower-case hexadecimal text.

Supersteps over RDDs, as in Pregel: a vertex is a parent with a place in its level. Upward, every child sends its digest to its parent; a parent that has
got all its children hashes them and sends on in the next superstep. Downward, every parent sends each child the path above it, with the
siblings at its level, until the leaves' parents hand the whole path to each leaf, which folds it from what its content is *now*. A path is sent once a run, not once a leaf.
A vertex has ``FANOUT`` children at most, however large its group, and a level has an eighth of the vertices below; a superstep is one shuffle by
(group, place). Leaves get their places by ranges: one count a range and group, summed up; no task sees a whole group. Content never leaves its row: digests travel.
The rows' digests and places are written, so lost executors lose no more than supersteps, which are repeated from those tables.

Defined cases: a group of one leaf has that leaf as subroot, and its path starts above; without any siblings the proof is the digest of nothing. The null group
comes first and is one of its own. Rows of equal order in a group (repeated or null ids, null first) go by leaf digest; equal rows have the same leaf
and take neighbouring places. Texts of any length are hashed where they lie. An empty table gives no rows. Columns that aren't fields aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from hashlib import sha256

from pyspark import RDD
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import materialise, shuffle_width

FANOUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_RESULT = "group string, doc_id long, leaf string, subroot string, root string, proof array<struct<before:string,after:string>>, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    value = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(*values: Column) -> Column:
    """Digest of a row by its fields."""
    return F.sha2(F.concat(*map(field, values)), 256)


def _hash(digests: str) -> str:
    return sha256(digests.encode()).hexdigest()


def _place(key: tuple[str, int]) -> int:
    return zlib.crc32(f"{key[1]} {key[0]}".encode("utf-8", "surrogatepass"))


# --- places ---------------------------------------------------------------------------------------------------------------


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` (a written table with ``group``, not null) with ``place``, from 0, in the group's order, and ``size``, the group's number of rows."""
    dealt = rows.repartitionByRange(shuffle_width(rows.sparkSession), "group", *order).sortWithinPartitions("group", *order)
    dealt = materialise(dealt.withColumn("range", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "merkle-ranges")
    counts = dealt.groupBy("group", "range").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("least"))  # one row a range, and one more for each change of group
    whole = "sum(n) over (partition by group"
    counts = counts.select("group", "range", "least", F.expr(f"{whole})").alias("size"), F.expr(f"{whole} order by range) - n").alias("before"))
    both = dealt.join(counts, ["group", "range"])
    return both.withColumn("place", F.col("before") + F.col("at") - F.col("least")).drop("range", "at", "least", "before")


# --- supersteps -----------------------------------------------------------------------------------------------------------


def _complete(children: Iterable[tuple]) -> tuple:
    """A parent of its children (place in the run, size of their level, digest, payload): the parents' number, digest, whether it only passes
    a lone leaf on, digests and payloads of the run."""
    run = sorted(children, key=lambda c: c[0])
    size, digests = run[0][1], [c[2] for c in run]
    if [c[0] for c in run] != list(range(len(run))):
        raise ValueError("a run has a child missing or twice")
    lone = size == 1
    return -(-size // FANOUT), digests[0] if lone else _hash("".join(digests)), lone, digests, [c[3] for c in run]


def _siblings(run: tuple) -> list[list[tuple[str, str]]]:
    """For each child the step of its path in this run: the digests before and after it; no step for a lone leaf."""
    digests = run[3]
    return [[]] if run[2] else [[("".join(digests[:i]), "".join(digests[i + 1 :]))] for i in range(len(digests))]


class Tree:
    """Trees over leaves ((group, place), (size, digest, payload)); ``depth``: levels above the leaves of the largest."""

    def __init__(self, leaves: RDD, largest: int, width: int) -> None:
        self.widths, self.levels, below = [], [], leaves.map(lambda x: ((x[0][0], x[0][1] // FANOUT), (x[0][1] % FANOUT, *x[1])))
        most = largest
        while not self.levels or most > 1:
            most = -(-most // FANOUT)
            self.widths.append(max(1, min(width, most)))
            runs = below.groupByKey(self.widths[-1], _place).mapValues(_complete)
            self.levels.append(runs)
            below = runs.filter(lambda x: x[1][0] > 1).map(lambda x: ((x[0][0], x[0][1] // FANOUT), (x[0][1] % FANOUT, x[1][0], x[1][1], None)))
            width = max(1, width // FANOUT)

    def tops(self) -> RDD:
        """(group, level, digest) of each tree."""
        own = [runs.filter(lambda x: x[1][0] == 1).map(lambda x, level=level: (x[0][0], level, x[1][1])) for level, runs in enumerate(self.levels)]
        return own[0].context.union(own)

    def paths(self, seeds: RDD) -> RDD:
        """(group, digest, payload, what its seed says, path) of each leaf, by ``seeds`` (group, (level of its top, what is said, path above the top)). A path:
        the (before, after) of each level, from the leaf up."""
        down = None
        for level in reversed(range(len(self.levels))):
            own = seeds.filter(lambda x, level=level: x[1][0] == level).map(lambda x: ((x[0], 0), (False, x[1][1:])))
            told = own if down is None else own.union(down)
            told = told.partitionBy(self.widths[level], _place)
            met = self.levels[level].mapValues(lambda run: (True, run)).union(told).groupByKey(self.widths[level], _place)
            down = met.flatMap(_tell_runs if level else _tell_leaves)
        return down


def _met(values: Iterable[tuple]) -> tuple[tuple, tuple]:
    by = dict(values)
    return by[True], by[False]


def _tell_runs(x: tuple) -> Iterator[tuple]:
    (group, place), values = x
    run, (said, path) = _met(values)
    for i, step in enumerate(_siblings(run)):
        yield (group, place * FANOUT + i), (False, (said, step + path))


def _tell_leaves(x: tuple) -> Iterator[tuple]:
    (group, _), values = x
    run, (said, path) = _met(values)
    for step, digest, payload in zip(_siblings(run), run[3], run[4], strict=True):
        yield group, digest, payload, said, step + path


def fold(digest: str, path: list[tuple[str, str]]) -> str:
    """The root that a leaf's digest and its path give."""
    for before, after in path:
        digest = _hash(before + digest + after)
    return digest


# --- manifest -------------------------------------------------------------------------------------------------------------


def manifest(leaves: DataFrame, proofs: bool = False) -> DataFrame:
    """group, doc_id, leaf, subroot, root, proof (before and after of each level; null unless ``proofs``), proof_sha256, folded_root and verified
    of each row of ``leaves``: group, doc_id, leaf (digest of the content that the manifest is made of) and now (digest of the content that is
    to be verified; null: the same)."""
    spark = leaves.sparkSession
    width = shuffle_width(spark)
    # the null group before all others; a number a row spreads equal rows over ranges
    group = F.coalesce(F.concat(F.lit("="), F.col("group").cast("string")), F.lit("")).alias("group")
    rows = materialise(leaves.select(group, F.col("doc_id").cast("long").alias("doc_id"), "leaf", F.when(F.col("now") != F.col("leaf"), F.col("now")).alias("now"), F.monotonically_increasing_id().alias("row")), "merkle-leaves")
    rows = materialise(placed(rows, ["doc_id", "leaf", "row"]).select("group", "place", "size", "leaf", "doc_id", "now"), "merkle-places")
    largest = rows.agg(F.max("size")).first()[0]
    if largest is None:
        return spark.createDataFrame([], _RESULT)
    lower = Tree(rows.rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3], (r[4], r[5])))), largest, width)

    tops = materialise(spark.createDataFrame(lower.tops(), "name string, level int, leaf string", verifySchema=False).withColumn("group", F.lit("")), "merkle-subroots")
    tops = materialise(placed(tops, ["name"]), "merkle-subroot-places")
    groups = tops.agg(F.max("size")).first()[0]
    upper = Tree(tops.select("group", "place", "size", "leaf", "name", "level").rdd.map(lambda r: ((r[0], r[1]), (r[2], r[3], (r[4], r[5])))), groups, width)
    above = upper.paths(upper.tops().map(lambda x: (x[0], (x[1], x[2], []))))  # of each subroot; what is said is the root
    above = spark.createDataFrame(above.map(lambda x: (x[2][0], x[2][1], x[1], x[3], x[4])), "name string, level int, subroot string, root string, path array<struct<before:string,after:string>>", verifySchema=False)
    seeds = materialise(above, "merkle-seeds").rdd.map(lambda r: (r[0], (r[1], (r[2], r[3]), [tuple(p) for p in r[4]])))

    def row(x: tuple) -> tuple:
        group, digest, (doc_id, now), (subroot, root), path = x
        folded = fold(now or digest, path)
        return group[1:] if group else None, doc_id, digest, subroot, root, path if proofs else None, _hash("".join(b + a for b, a in path)), folded, folded == root

    return spark.createDataFrame(lower.paths(seeds).map(row), _RESULT, verifySchema=False)


def lowered(text: Column) -> Column:
    """A-Z as a-z and nothing else."""
    upper = "".join(map(chr, range(65, 91)))
    return F.translate(text, upper, upper.lower())


def tampering(docs: DataFrame, every: int = 3) -> DataFrame:
    """Leaves of ``documents`` by lang, of which one in ``every`` (by the checksum of doc_id) is verified with its text in lower case."""
    now = {c: F.col(c) for c in FIELDS} | {"text": lowered(F.col("text").cast("string"))}
    touched = F.crc32(F.col("doc_id").cast("string")) % every == 0
    return docs.select(F.col("lang").alias("group"), "doc_id", leaf(*(F.col(c) for c in FIELDS)).alias("leaf"), F.when(touched, leaf(*now.values())).alias("now"))


def sql() -> str:
    """The query on ``documents`` in DuckDB: levels, proofs and folding by recursion."""
    text = {c: c for c in FIELDS}
    whole = lambda by: "sha256(" + " || ".join(f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')" for v in by.values()) + ")"
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    bits = f"list_reduce([xor(c, b)] || range(8), lambda x, i: {step})"
    crc = f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(doc_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT), lambda c, b: {bits}), 4294967295)"
    return f"""
        WITH RECURSIVE leaves AS (SELECT doc_id, lang, {whole(text)} AS leaf, CASE WHEN {crc} % 3 = 0 THEN {whole(text | {"text": low})} END AS now FROM documents),
        own AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place, count(*) OVER (PARTITION BY lang) AS size FROM leaves),
        lower_nodes AS (SELECT lang, 0 AS level, place, size, leaf AS digest FROM own
            UNION ALL SELECT lang, level + 1, place // {FANOUT}, (size + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY place)) FROM lower_nodes WHERE size > 1 GROUP BY lang, level, size, place // {FANOUT}),
        tops AS (SELECT lang, level AS height, digest, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS size FROM lower_nodes WHERE size = 1),
        upper_nodes AS (SELECT 0 AS level, place, size, digest FROM tops
            UNION ALL SELECT level + 1, place // {FANOUT}, (size + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(digest, '' ORDER BY place)) FROM upper_nodes WHERE size > 1 GROUP BY level, size, place // {FANOUT}),
        steps AS (
            SELECT a.lang, a.level, a.place, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), '') AS before, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '') AS after
            FROM lower_nodes a JOIN lower_nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND a.place // {FANOUT} = b.place // {FANOUT} WHERE a.size > 1 GROUP BY a.lang, a.level, a.place
            UNION ALL
            SELECT t.lang, t.height + a.level, t.top, coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place < a.place), ''), coalesce(string_agg(b.digest, '' ORDER BY b.place) FILTER (b.place > a.place), '')
            FROM (SELECT lang, height, place, 0 AS top FROM tops) t JOIN upper_nodes a ON a.size > 1 AND a.place = t.place // power({FANOUT}, a.level)::BIGINT
            JOIN upper_nodes b ON a.level = b.level AND a.place // {FANOUT} = b.place // {FANOUT} GROUP BY ALL),
        folds AS (SELECT lang, place AS leaf_place, place, 0 AS level, coalesce(now, leaf) AS digest, '' AS proof FROM own
            UNION ALL SELECT f.lang, f.leaf_place, f.place // {FANOUT}, f.level + 1, sha256(s.before || f.digest || s.after), f.proof || s.before || s.after
            FROM folds f JOIN steps s ON f.lang IS NOT DISTINCT FROM s.lang AND f.level = s.level AND f.place = s.place),
        ends AS (SELECT lang, leaf_place, max_by(digest, level) AS folded_root, max_by(proof, level) AS proof FROM folds GROUP BY ALL),
        root AS (SELECT digest AS root FROM upper_nodes WHERE size = 1)
        SELECT o.doc_id, o.leaf, t.digest AS subroot, root, sha256(e.proof) AS proof_sha256, e.folded_root, e.folded_root = root AS verified
        FROM own o JOIN ends e ON o.lang IS NOT DISTINCT FROM e.lang AND o.place = e.leaf_place JOIN tops t ON o.lang IS NOT DISTINCT FROM t.lang, root
    """
