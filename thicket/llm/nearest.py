"""Approximate nearest neighbours: inverted lists with an adaptive scan of dimensions.

Vectors are turned by a random rotation, so that any of their coordinates say as much about a distance as others. Centres
of the lists come from a bounded sample; every vector goes to its nearest centre's list. Each query probes the lists of the nearest centres, as
many as give ``TARGET`` of the true neighbours for queries within that sample, where all distances are computed: few lists for vectors in
clusters, most of them for vectors without. Within a list, distances grow by blocks of ``COLUMNS`` coordinates: after b of D coordinates a candidate is
abandoned if its partial square distance, times D / b, exceeds the square of (1 + ``EPSILON`` / sqrt(b)) times the query's current
tenth best, a hypothesis test that errs rarely. What survives is measured exactly, in double precision on the vectors as given.

Vectors are shuffled once, into chunks of ``CHUNK`` of one list, so a hot list is many tasks; queries are written to the shared folder, a folder
a list, and a chunk streams those of its list past itself in blocks of ``QUERIES``: neither side is copied for the other. The first pass
probes each query's nearest lists, ``FIRST`` of them; its tenth best distance is where the second pass over the other lists begins, so that
most candidates are abandoned at once and few reach the final ranking.

Defined cases: a vector takes no part if it is null, empty, all zero, of another length than most (of equally common lengths, the
longest), or holds null or non-finite components, or if its vec_id is null. A query's own vec_id is no candidate, in no row of it;
of several query rows with one vec_id the least vector counts. Other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.shared import filesystem, materialise, work_dir

K, SAMPLE, MOST_LISTS, COLUMNS, EPSILON, CHUNK, QUERIES, BLOCK = 10, 10_000, 4096, 16, 2.1, 16_384, 1024, 256
#: Share of true neighbours that the probed lists hold in the sample, the queries that measure it, and lists of the first pass.
TARGET, TRIALS, FIRST = 0.985, 300, 2
#: Queries of a list that one task writes.
FILE_QUERIES = 1_000_000


def rotation(d: int, seed: int = 5) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def centres(sample: np.ndarray, lists: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """k-means of a bounded sample."""
    rng = np.random.default_rng(seed)
    c = sample[rng.permutation(len(sample))[:lists]].copy()
    for _ in range(rounds):
        own = nearest_lists(sample, c, 1)[:, 0]
        n = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, sample)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_lists(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
    d = (c * c).sum(1)[None] - 2 * x @ c.T
    if n == 1:
        return d.argmin(1)[:, None]
    return np.argsort(d, axis=1, kind="stable")[:, :n]


def matrix(column: pa.Array, d: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(len(column), d)


def probes_for(sample: np.ndarray, c: np.ndarray, k: int, target: float = TARGET, trials: int = TRIALS) -> int:
    """Lists to probe so that they hold ``target`` of the k nearest in the sample, of its first ``trials`` vectors."""
    own = nearest_lists(sample, c, 1)[:, 0]
    asked = sample[:trials]
    square = (sample * sample).sum(1)[None] - 2 * asked @ sample.T
    square[np.arange(len(asked)), np.arange(len(asked))] = np.inf
    near = np.argsort(square, axis=1, kind="stable")[:, : min(k, len(sample) - 1)]
    if not near.size:
        return 1
    place = np.argsort(nearest_lists(asked, c, len(c)), axis=1, kind="stable")  # rank of every list, by query
    ranks = np.sort(np.take_along_axis(place, own[near], 1).ravel())
    return int(ranks[math.ceil(target * len(ranks)) - 1]) + 1


def scan(queries: np.ndarray, ids: np.ndarray, limits: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) that survive the adaptive scan of rotated vectors: all of the k best of each query within its limit (a square
    distance), but for candidates that a test abandons wrongly."""
    d, m = rows.shape[1], len(queries)
    best, kept = np.repeat(limits[:, None], k, 1), []
    for at in range(0, len(rows), BLOCK):
        x = rows[at : at + BLOCK]
        limit = best[:, -1]
        w = min(COLUMNS, d)
        partial = (queries[:, :w] ** 2).sum(1)[:, None] + (x[:, :w] ** 2).sum(1)[None] - 2 * queries[:, :w] @ x[:, :w].T
        alive = (ids[:, None] != row_ids[None, at : at + BLOCK]) & (partial * (d / w) <= (limit * (1 + EPSILON / math.sqrt(w)) ** 2)[:, None] + 1e-12)
        q, c = np.nonzero(alive)
        total = ((queries[q, :w] - x[c, :w]) ** 2).sum(1)
        while w < d and len(q):
            to = min(w + COLUMNS, d)
            total = total + ((queries[q, w:to] - x[c, w:to]) ** 2).sum(1)
            w = to
            factor = (1 + EPSILON / math.sqrt(w)) ** 2 if w < d else 1 + 1e-9
            stay = total * (d / w) <= limit[q] * factor + 1e-12
            q, c, total = q[stay], c[stay], total[stay]
        if not len(q):
            continue
        touched = np.unique(q)
        found = np.full((len(touched), len(x)), np.inf)
        found[np.searchsorted(touched, q), c] = total
        both = np.hstack([best[touched], found])
        best[touched] = np.sort(np.partition(both, k - 1, axis=1)[:, :k], axis=1)
        kept.append((q, c + at, total))
    if not kept:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    q, c, total = (np.concatenate(x) for x in zip(*kept, strict=True))
    stay = total <= best[q, -1] * (1 + 1e-9) + 1e-12
    return q[stay], c[stay]


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and v (array of double) of the vectors that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    fine = "vec_id IS NOT NULL AND v IS NOT NULL AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    return rows.where(fine)


def search(vectors: DataFrame, every: int = 100, k: int = K, lists: int | None = None, probes: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score (Euclidean distance) of the ``k`` nearest found for each query: the vectors whose vec_id
    ``every`` divides."""
    spark = vectors.sparkSession
    rows = valid(vectors)
    common = rows.groupBy(F.size("v").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d, n = common["d"], common["n"]
    rows = rows.where(F.size("v") == d)
    turn = rotation(d)
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()  # `sample` rows at most
    known = np.array([r["v"] for r in some]) @ turn
    lists = lists or max(1, min(MOST_LISTS, round(math.sqrt(n) / 2)))
    middle = centres(known, min(lists, len(some)))
    probes = min(len(middle), probes or probes_for(known, middle, k))
    shared = spark.sparkContext.broadcast((turn, middle))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotate, c = shared.value
        for batch in batches:
            if len(batch):
                near = nearest_lists(matrix(batch.column("v"), d) @ rotate, c, 1)[:, 0]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32))], ["vec_id", "v", "list"])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotate, c = shared.value
        for batch in batches:
            if len(batch):
                near = nearest_lists(matrix(batch.column("v"), d) @ rotate, c, max(probes, 2))[:, :probes].astype(np.int32)
                ends = np.arange(len(batch) + 1, dtype=np.int32) * near.shape[1]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(near.ravel()))], ["vec_id", "v", "lists"])

    index = materialise(rows.mapInArrow(assign, "vec_id long, v array<double>, list int"), "nearest-index")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = materialise(asked.mapInArrow(probe, "vec_id long, v array<double>, lists array<int>"), "nearest-queries")
    # a row for each list: MOST_LISTS at most
    chunks = F.broadcast(materialise(index.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks")), "nearest-chunks"))
    index = index.join(chunks, "list").select("list", F.pmod(F.xxhash64("vec_id"), F.col("chunks")).cast("int").alias("chunk"), "vec_id", "v")
    files = 1 + n // every // FILE_QUERIES

    def one_pass(queries: DataFrame) -> DataFrame:
        """The k best of each query (vec_id, v, lists, within) in each chunk of its lists, as far as they are within its limit."""
        path = work_dir(spark, "nearest-probes")
        spread = queries.select(F.explode("lists").alias("list"), "vec_id", "v", "within")
        spread.repartition("list", F.pmod(F.xxhash64("vec_id"), F.lit(files))).write.partitionBy("list").parquet(path)

        def compare(key: tuple, group: pa.Table) -> pa.Table:
            fs, base = filesystem(path)
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            here = fs.get_file_info(pyarrow.fs.FileSelector(f"{base}/list={key[0].as_py()}", allow_not_found=True))
            x, ids = matrix(group.column("v"), d), np.asarray(group.column("vec_id"))
            order = np.argsort(ids, kind="stable")  # the same blocks wherever it runs
            x, ids = x[order], ids[order]
            turned = x @ shared.value[0]
            for file in sorted(f.path for f in here if f.path.endswith(".parquet")):
                with fs.open_input_file(file) as source:
                    for batch in pyarrow.parquet.ParquetFile(source).iter_batches(QUERIES, columns=["vec_id", "v", "within"]):
                        q, asks = matrix(batch.column("v"), d), np.asarray(batch.column("vec_id"))
                        a, b = scan(q @ shared.value[0], asks, np.asarray(batch.column("within")), turned, ids, k)
                        score = np.sqrt(((q[a] - x[b]) ** 2).sum(1))
                        order = np.lexsort((ids[b], score, a))
                        a, b, score = a[order], b[order], score[order]
                        first = np.flatnonzero(np.r_[True, a[1:] != a[:-1]]) if len(a) else a
                        top = np.arange(len(a)) - np.repeat(first, np.diff(np.r_[first, len(a)])) < k
                        out.append((asks[a[top]], ids[b[top]], score[top]))
            parts = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            return pa.table(dict(zip(("query_id", "vec_id", "score"), parts, strict=True)))

        return index.groupBy("list", "chunk").applyInArrow(compare, "query_id long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
        return ranked.where(F.col("rank") <= k)

    anything = F.lit(float("inf")).alias("within")
    found = materialise(best(one_pass(asked.select("vec_id", "v", F.slice("lists", 1, FIRST).alias("lists"), anything))), "nearest-first")
    if probes > FIRST:
        # the square of the k-th best, where there are that many; a little more, as it is compared with rotated vectors' distances
        limit = found.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), (F.col("score") * F.col("score") * (1 + 1e-9) + 1e-12).alias("within"))
        rest = asked.join(limit, "vec_id", "left").select("vec_id", "v", F.slice("lists", FIRST + 1, MOST_LISTS).alias("lists"), F.coalesce("within", F.lit(float("inf"))).alias("within"))
        found = best(found.drop("rank").unionByName(one_pass(rest)))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
