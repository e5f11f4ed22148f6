"""Toxicity by a logistic classifier that is trained to score a sentence alike whichever group it mentions.

Features of a text are the words it holds (lower case) and their beginnings of ``PREFIXES`` bytes; each counts once a text, so one insult in a long
text weighs as much as in a short one. The model knows the ``FEATURES`` features that tell labelled texts apart most (the likelihood ratio of
their presence); a word is known by its 64-bit hash, so other words never pass for it.

*Counterfactuals*: in every labelled sentence that names a group (``IDENTITY``: sets of terms that can stand for each other), the term is swapped for each
other term of its set. Training minimises the log loss of texts plus ``BALANCE`` times the mean squared difference of the scores (log odds) of a sentence
and its counterfactual, plus ``RIDGE`` of the weights: where toxic labels happen to go along with mentions of a group, the weight of the mention is spread over all
terms of its set, or lost to the words that do the harm, instead of marking neutral mentions as toxic. Terms that
occur in labelled texts are features whatever their ratio, so their weights are part of what is trained.

The model is fitted on ``SAMPLE`` labelled texts and ``PAIRS`` counterfactual pairs at most, those of the least hashes, each a row of ``FEATURES`` bits: a fixed size
whatever the input. Every text is scored as a whole, in tasks, by a broadcast of ``FEATURES`` weights.

Defined cases: null and empty texts have no features and get the score of the constant. Texts of any length are scored in batches of their own. Rows that
repeat are each scored, equal texts alike. Labels that are null or neither 0 nor 1 don't count; a document with several has the greatest; labels of a doc_id that
several rows have count for each of their texts, for equal ones once. Null doc_ids have no labels and aren't held out. With no labels, every score is 0.5; with labels of one class only, the constant
decides. An empty table gives no rows. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.quality import held_out
from thicket.llm.shared import labelled_sample, least_hashes, materialise
from thicket.llm.words import _BYTE_BASE, ALNUM, Words, chunks, mix, ranges_hash, split_words

FEATURES, SAMPLE, PAIRS, LEAST = 4096, 30_000, 20_000, 5
PREFIXES = (4, 5, 6)
BALANCE, RIDGE, STEPS, THRESHOLD = 1.0, 1e-4, 500, 0.5
#: Terms that can stand for each other in a sentence; swaps stay within a language and kind.
IDENTITY = (
    ("women", "men", "girls", "boys"), ("woman", "man", "girl", "boy"), ("female", "male", "transgender", "nonbinary"),
    ("gay", "lesbian", "bisexual", "straight", "queer", "homosexual", "heterosexual"), ("black", "white", "asian", "latino", "african", "european", "arab"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"), ("old", "young", "elderly"), ("blind", "deaf", "disabled", "autistic"),
    ("femmes", "hommes", "filles", "garçons"), ("musulmans", "chrétiens", "juifs", "athées"), ("immigrés", "réfugiés", "étrangers", "citoyens"),
    ("frauen", "männer", "mädchen", "jungen"), ("muslime", "christen", "juden", "atheisten"), ("einwanderer", "flüchtlinge", "ausländer", "bürger"),
    ("mujeres", "hombres", "chicas", "chicos"), ("musulmanes", "cristianos", "judíos", "ateos"), ("inmigrantes", "refugiados", "extranjeros", "ciudadanos"),
)
_SENTENCE = re.compile(r"[^.!?\n]+")
Identity = tuple[tuple[str, ...], ...]


def _low(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.string()), ""))


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, hash of a feature), in order."""
    doc, size = words.doc, words.end - words.start
    long = [np.flatnonzero(size > n) for n in PREFIXES]
    start, ends = words.start[np.concatenate(long)], np.repeat(PREFIXES, [len(x) for x in long])
    begun = mix(ranges_hash(words.buffer.astype(np.uint64) + np.uint64(1), start, start + ends, _BYTE_BASE) ^ (ends.astype(np.uint64) << np.uint64(56))) if len(start) else np.zeros(0, np.uint64)
    keys, owner = [words.hash, begun], [doc, doc[np.concatenate(long)]]
    key, doc = np.concatenate(keys), np.concatenate(owner)
    order = np.lexsort((key, doc))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    return doc[new], key[new]


def word_key(word: str) -> int:
    return int(split_words(pa.array([word]), ALNUM).hash.view(np.int64)[0])


@dataclass
class Model:
    """Known features (ascending hashes), their weights and the constant."""

    keys: np.ndarray
    weights: np.ndarray
    constant: float

    def find(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(text, number of the feature) of the known features of lower-case texts, each once a text."""
        doc, key = features(split_words(column, ALNUM))
        at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
        hit = np.flatnonzero(self.keys[at] == key) if len(self.keys) else np.zeros(0, int)
        return doc[hit], at[hit]

    def score(self, column: pa.Array) -> np.ndarray:
        doc, at = self.find(_low(column))
        odds = self.constant + np.bincount(doc, self.weights[at], len(column))
        return np.round(1 / (1 + np.exp(-np.clip(odds, -30, 30))), 6)


# --- training -------------------------------------------------------------------------------------------------------------


def swaps(text: str, identity: Identity = IDENTITY) -> Iterator[tuple[str, str]]:
    """(sentence, counterfactual) of a lower-case text: each identity term of each sentence for each other of its set."""
    sets = {t: group for group in identity for t in group}
    term = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, sorted(sets, key=len, reverse=True))) + r")(?!\w)")
    for sentence in _SENTENCE.findall(text):
        for m in term.finditer(sentence):
            for other in sets[m[0]]:
                if other != m[0]:
                    yield sentence, sentence[: m.start()] + other + sentence[m.end() :]


def _labelled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """text, toxic of at most ``sample`` labelled rows that aren't held out."""
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    own = own.where(~held_out()).groupBy("doc_id").agg(F.max("label").alias("label"))
    return labelled_sample(docs, own, sample, "toxicity").withColumnRenamed("label", "toxic")


def _candidates(texts: DataFrame, least: int) -> DataFrame:
    """key, n and toxic: how many labelled texts hold a feature, and how many of them are toxic. Counted in tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 8 << 20):
            doc, key = features(split_words(_low(batch.column("text")), ALNUM))
            keys, at = np.unique(key, return_inverse=True)
            toxic = np.bincount(at, np.asarray(batch.column("toxic"), float)[doc], len(keys)) if len(keys) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(np.bincount(at, minlength=len(keys)).astype(np.int64)), pa.array(toxic.astype(np.int64))], ["key", "n", "toxic"])

    return texts.select("text", "toxic").mapInArrow(run, "key long, n long, toxic long").groupBy("key").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic")).where(F.col("n") >= least)


def _telling(counts: DataFrame, rows: int, toxic: int, most: int) -> DataFrame:
    """The ``most`` features of the greatest likelihood ratio."""
    part = lambda k, n: k * F.log((k + 0.5) / (n + 1.0))
    n, t = F.col("n"), F.col("toxic")
    clean = rows - toxic
    split = part(t, F.lit(toxic)) + part(toxic - t, F.lit(toxic)) + part(n - t, F.lit(clean)) + part(clean - n + t, F.lit(clean))
    whole = part(n, F.lit(rows)) + part(rows - n, F.lit(rows))
    return counts.withColumn("gain", F.round(split - whole, 6)).orderBy(F.desc("gain"), "key").limit(most).select("key")


def _bits(doc: np.ndarray, at: np.ndarray, rows: int) -> list[bytes]:
    out = np.zeros((rows, FEATURES // 8), np.uint8)
    np.bitwise_or.at(out, (doc, at >> 3), (1 << (at & 7)).astype(np.uint8))
    return [row.tobytes() for row in out]


def _sparse(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Rows and features of bit rows, a portion at a time."""
    doc, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(0, len(bits), 1024):
        flags = np.unpackbits(np.frombuffer(b"".join(map(bytes, bits[i : i + 1024])), np.uint8).reshape(-1, FEATURES // 8), axis=1, bitorder="little")
        d, a = np.nonzero(flags)
        doc.append(d + i)
        at.append(a)
    return np.concatenate(doc), np.concatenate(at)


def fit(texts: tuple[np.ndarray, np.ndarray], labels: np.ndarray, pairs: tuple[np.ndarray, np.ndarray, np.ndarray], size: int, balance: float = BALANCE, ridge: float = RIDGE, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and constant by Adam, full batches, with steps that shrink to nothing. texts: (row, feature) of what texts hold; pairs: (pair, feature, sign), signs 1 for what only
    the sentence holds, -1 for what only the counterfactual does."""
    (doc, at), (pair, edge, sign), n = texts, pairs, max(len(labels), 1)
    many = int(pair.max()) + 1 if len(pair) else 1
    w, b = np.zeros(size), float(np.log((labels.sum() + 0.5) / (n - labels.sum() + 0.5)))
    moment, scale = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        p = 1 / (1 + np.exp(-np.clip(b + np.bincount(doc, w[at], len(labels)), -30, 30)))
        error = (p - labels) / n
        slope = np.bincount(at, error[doc], size) + ridge * w
        if len(pair) and balance:
            slope += np.bincount(edge, sign * (2 * balance / many * np.bincount(pair, sign * w[edge], many))[pair], size)
        slope = np.append(slope, error.sum())
        moment, scale = 0.9 * moment + 0.1 * slope, 0.99 * scale + 0.01 * slope**2
        move = 0.1 * (1 - (step - 1) / steps) * (moment / (1 - 0.9**step)) / (np.sqrt(scale / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def train(docs: DataFrame, labels: DataFrame, identity: Identity = IDENTITY, balance: float = BALANCE, sample: int = SAMPLE, most_pairs: int = PAIRS, least: int = LEAST) -> Model:
    """A model of ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic)."""
    texts = _labelled(docs, labels, sample)
    rows, toxic = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not rows:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0.0)
    counts = materialise(_candidates(texts, least), "toxicity-features")
    terms = np.array(sorted({word_key(t) for group in identity for t in group}), np.int64)[: FEATURES // 4]
    told = [r["key"] for r in _telling(counts, rows, toxic, FEATURES - len(terms)).collect()]
    model = Model(np.unique(np.array(told, np.int64).view(np.uint64)), np.zeros(0), 0.0)
    model.keys = np.union1d(model.keys, terms.view(np.uint64))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            found = _bits(*model.find(_low(batch.column("text"))), len(batch))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), batch.column("toxic")], ["bits", "toxic"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text", 4 << 20):
            made = [p for text in _low(batch.column("text")).to_pylist() for p in swaps(text, identity)]
            sides = [_bits(*model.find(pa.array([p[i] for p in made], pa.string())), len(made)) for i in (0, 1)] if made else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(side, pa.binary()) for side in sides], ["own", "other"])

    got = texts.select("text", "toxic").mapInArrow(bits, "bits binary, toxic int").orderBy("bits", "toxic").collect()  # `sample` rows at most
    made = materialise(texts.select("text").mapInArrow(pairs, "own binary, other binary").where("own <> other"), "toxicity-pairs")
    made = least_hashes(made, ["own", "other"], most_pairs).orderBy("own", "other").collect()  # `most_pairs` rows at most
    left, right = _sparse([r["own"] for r in made]), _sparse([r["other"] for r in made])
    whole = [np.concatenate([left[i], right[i]]) for i in (0, 1)]
    sign = np.concatenate([np.ones(len(left[0])), -np.ones(len(right[0]))])
    size = len(model.keys)
    cell, at = np.unique(whole[0] * size + whole[1], return_inverse=True)
    sums = np.bincount(at, sign, len(cell)) if len(cell) else np.zeros(0)
    cell, sums = cell[sums != 0], sums[sums != 0]
    model.weights, model.constant = fit(_sparse([r["bits"] for r in got]), np.array([r["toxic"] for r in got], float), (cell // size, cell % size, sums), size, balance)
    return model


# --- scoring --------------------------------------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.score(batch.column("text")), pa.float64())], ["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
