"""Quality of documents by nearest-neighbour voting over latent-semantic vectors.

Terms of a text are hashed character trigrams (log counts, weighted by inverse document frequency over all documents) and
its shape: shares of capitals, digits, punctuation, line ends, distinct words and lines, lengths, each as steps passed.
``SAMPLE`` labelled texts at most span the latent space (the leading ``RANK`` directions of their term vectors) and are the
neighbours: their vectors go to all tasks. Every document's cosines with all of them are exact products, a block of
documents at a time; its ``NEIGHBOURS`` nearest vote with their similarity as weight.

The sample is bounded by its documented size, whatever the input; frequencies count all documents.

Defined cases: null and empty texts have no trigrams but a shape, so they are scored by it. Rows that repeat are
each scored. Cosines count to ``DIGITS`` places; of labelled texts that are equally near where the last votes are given, all share these votes, so no id and no order
decides. The sample goes by hashes of texts, and the model by the sample's content. Texts of any length are whole terms, in batches of their own. An empty table gives no rows. With no
labels at all every score is 0.5. Labels that are null don't count; a document with several labels has the least; rows of equal doc_id and text are one neighbour. Other columns aren't read, but for ``carry``, which returns every row as one struct, whatever its columns are named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import labelled_sample
from thicket.llm.words import SPACED, byte_class, chunks, split_words

BUCKETS, RANK, SAMPLE, NEIGHBOURS, POWER, DIGITS = 1024, 64, 4000, 15, 4, 5
FOLDS, THRESHOLD = 5, 0.3
_STEPS = {
    "log_bytes": (3, 4.5, 5.5, 6.5, 7.5, 8.5, 9.5, 10.5),
    "upper": (0.005, 0.01, 0.02, 0.04, 0.08, 0.2, 0.4, 0.7),
    "digit": (0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4),
    "mark": (0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.3),
    "line": (0.001, 0.002, 0.004, 0.008, 0.015, 0.03, 0.06, 0.12),
    "beyond": (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4, 0.7),
    "word_bytes": (2, 3, 4, 5, 6, 7, 9, 12),
    "distinct_words": (0.05, 0.15, 0.3, 0.45, 0.6, 0.75, 0.85, 0.95),
    "distinct_lines": (0.05, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.99),
}
TERMS = BUCKETS + sum(map(len, _STEPS.values()))
_LINES = byte_class("\n")


def _share(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags)])
    return (sums[offsets[1:]] - sums[offsets[:-1]]) / np.maximum(np.diff(offsets), 1)


def _distinct(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Share of distinct values in each document."""
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.bincount(o[new], minlength=len(n)) / np.maximum(n, 1)


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram counts (documents x BUCKETS) and shape (documents x the rest) of texts."""
    words = split_words(column, SPACED)
    buffer, offsets = words.buffer, words.offsets
    n = len(offsets) - 1
    wide = buffer.astype(np.uint32)
    if len(buffer) > 2:
        grams = (wide[:-2] * np.uint32(0x9E3779B1) + wide[1:-1] * np.uint32(0x85EBCA6B) + wide[2:] * np.uint32(0xC2B2AE35))
        grams = (grams ^ (grams >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(22)
        owner = np.repeat(np.arange(n), np.diff(offsets))
        inside = owner[2:] == owner[:-2]
        counts = np.bincount(owner[:-2][inside] * BUCKETS + grams[inside], minlength=n * BUCKETS).reshape(n, BUCKETS)
    else:
        counts = np.zeros((n, BUCKETS), np.int64)
    lines = split_words(column, _LINES)
    size = np.diff(offsets)
    low = buffer | 32
    letter = (low >= 97) & (low <= 122)
    stats = {
        "log_bytes": np.log(np.maximum(size, 1)),
        "upper": _share(letter & (buffer < 97), offsets),
        "digit": _share((buffer >= 48) & (buffer <= 57), offsets),
        "mark": _share((buffer > 32) & (buffer < 127) & ~letter & ~((buffer >= 48) & (buffer <= 57)), offsets),
        "line": _share(buffer == 10, offsets),
        "beyond": _share(buffer >= 128, offsets),
        "word_bytes": (np.add.reduceat(np.append(words.end - words.start, 0), np.minimum(words.first[:-1], len(words.start))) * (words.counts > 0) / np.maximum(words.counts, 1)) if n else np.zeros(0),
        "distinct_words": _distinct(words.hash, words.first),
        "distinct_lines": _distinct(lines.hash, lines.first),
    }
    shape = [np.where(stats[k] > step, 1.0, -1.0) for k, steps in _STEPS.items() for step in steps]
    return counts, np.stack(shape, 1).astype(np.float32) if n else np.zeros((0, TERMS - BUCKETS), np.float32)


def vectors(counts: np.ndarray, shape: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weighted terms: the trigrams' part and the shape's part have length 1 each."""
    grams = np.log1p(counts.astype(np.float32)) * idf
    grams /= np.maximum(np.linalg.norm(grams, axis=1, keepdims=True), 1e-9)
    return np.hstack([grams, shape / np.sqrt(np.float32(shape.shape[1]))]).astype(np.float32)


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, for each trigram bucket, how many hold it: sums over all documents, of fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(BUCKETS, np.int64)
        for batch in chunks(batches, "text"):
            n += len(batch)
            total += (terms(batch.column("text"))[0] > 0).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS, dtype=np.int32)), pa.array(np.append(n, total))], ["bucket", "n"])

    rows = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    found = {r["bucket"]: r["n"] for r in rows}
    return found.get(-1, 0), np.array([found.get(i, 0) for i in range(BUCKETS)])


class Model:
    """Latent directions, labelled vectors in them, and their labels."""

    def __init__(self, idf: np.ndarray, counts: np.ndarray, shape: np.ndarray, labels: np.ndarray) -> None:
        self.idf, self.labels = idf.astype(np.float32), labels.astype(np.float32)
        x = vectors(counts, shape, self.idf)
        self.mean = x.mean(0) if len(x) else np.zeros(TERMS, np.float32)
        x = x - self.mean
        _, base = np.linalg.eigh(x.T.astype(np.float64) @ x)
        # in double precision, as single products hang on where a text lies in its block, and may tip a cosine's last place
        self.base = np.ascontiguousarray(base[:, ::-1][:, :RANK])
        self.known = self.unit(x @ self.base)

    @staticmethod
    def unit(x: np.ndarray) -> np.ndarray:
        return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)

    def latent(self, column: pa.Array) -> np.ndarray:
        """Unit vectors of texts in the latent space."""
        return self.unit((vectors(*terms(column), self.idf) - self.mean) @ self.base)

    def score(self, column: pa.Array) -> np.ndarray:
        """Share of label 1 among the nearest, weighted by similarity; a block of texts by all labelled vectors."""
        if not len(self.labels):
            return np.full(len(column), 0.5)
        own = self.latent(column)
        k, out = min(NEIGHBOURS, len(self.labels)), np.zeros(len(column))
        for at in range(0, len(own), 256):
            cosines = np.round(own[at : at + 256] @ self.known.T, DIGITS).astype(np.float32)
            least = -np.partition(-cosines, k - 1, axis=1)[:, k - 1 : k]
            # all that are nearer than the k-th, and its equals, which share the places that are left
            nearer, equal = cosines > least, cosines == least
            share = (k - nearer.sum(1, keepdims=True)) / equal.sum(1, keepdims=True)
            weight = np.maximum(cosines, 1e-3).astype(np.float64) ** POWER * (nearer + equal * share)
            out[at : at + 256] = weight @ self.labels / weight.sum(1)
        return np.round(np.clip(out, 0, 1), 6)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model of ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), from at most ``sample`` rows that aren't held out."""
    n, df = document_frequencies(docs.select(F.col("text").cast("string").alias("text")))
    idf = np.log((1 + n) / (1 + df)) + 0.1
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    texts = labelled_sample(docs, own.where(~held_out()).groupBy("doc_id").agg(F.min("label").alias("label")), sample, "quality")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            counts, shape = terms(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([row.astype("<u4").tobytes() for row in counts], pa.binary()), pa.array([row.tobytes() for row in shape], pa.binary())],
                ["label", "counts", "shape"],
            )

    got = texts.mapInArrow(run, "label int, counts binary, shape binary").orderBy("counts", "shape", "label").collect()  # `sample` rows at most
    counts = np.frombuffer(b"".join(bytes(r["counts"]) for r in got), "<u4").reshape(len(got), BUCKETS)
    shape = np.frombuffer(b"".join(bytes(r["shape"]) for r in got), np.float32).reshape(len(got), TERMS - BUCKETS)
    return Model(idf, counts, shape, np.array([r["label"] for r in got]))


def score(docs: DataFrame, model: Model, carry: str | None = None) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text); ``carry``: the name of a struct column that
    holds the whole row. Only texts go to the Python workers."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in texts:
            parts = chunks(iter([pa.RecordBatch.from_arrays([column], ["text"])]), "text")
            yield pa.array(np.concatenate([np.zeros(0), *(shared.value.score(p.column(0)) for p in parts)]), pa.float64())

    # called non-deterministic so that a filter by the score doesn't compute it again
    of_text = F.arrow_udf(run, "double").asNondeterministic()(F.col("text").cast("string"))
    row = [F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias(carry)] if carry else []
    found = docs.select("doc_id", of_text.alias("score"), *row)
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), *([carry] if carry else []))
