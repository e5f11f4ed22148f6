"""Secrets: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Patterns give the base spans (``assign``, ``access``, ``hex``). Beside them, every token of ``LEAST`` or more characters of
``TOKEN`` is scored by two first-order character Markov models: log-likelihood as a random string less that as an
ordinary identifier, per character. Tokens at or over ``RATIO`` that hold letters and digits and don't touch a base span are
spans of kind ``random``.

Both models are trained from labelled samples: the matches of the patterns label random strings, together with seeded strings of
the alphabets that credentials use; the words and identifiers outside of matches label ordinary ones, but for long ones with digits, which
are left open. Spark counts the character
pairs of all documents; the counts (two tables of 66 x 66) are all that comes to the driver.

Defined cases: null and empty texts have no spans. Positions are code points, ends exclusive. Other columns aren't read.
Texts without samples leave the seeded strings against a flat model.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.words import chunks, text_buffer

#: Fixed patterns.
ASSIGN = re.compile(rb"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")

LEAST, RATIO = 20, 1.0
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
BACK_OFF = 5.0
SEEDED = 400  # strings of each seeded alphabet
_CODE = np.full(256, -1, np.int16)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(len(ALPHABET))
_HEX = np.zeros(256, bool)
_HEX[np.frombuffer(b"0123456789abcdef", np.uint8)] = True
_N = len(ALPHABET)


def _runs(inside: np.ndarray, offsets: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least ``least`` bytes, none over a document's edge."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = np.concatenate([[False], inside[:-1]])
    edge = np.zeros(len(inside) + 1, bool)
    edge[offsets] = True
    start = np.flatnonzero(inside & (~before | edge[:-1]))
    stop = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]]) | edge[1:])) + 1
    long = stop - start >= least
    return start[long], stop[long]


def base_spans(buffer: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, int, int]]:
    """(document, kind, start, end) in bytes of the buffer."""
    data, out = buffer.tobytes(), []
    low = data.lower()
    if any(k in low for k in KEYWORDS) or b"AKIA" in data:
        for d in range(len(offsets) - 1):
            a, b = int(offsets[d]), int(offsets[d + 1])
            if any(low.find(k, a, b) >= 0 for k in KEYWORDS):
                out += [(d, "assign", m.start(), m.end()) for m in ASSIGN.finditer(data, a, b) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
            if data.find(b"AKIA", a, b) >= 0:
                out += [(d, "access", m.start(), m.end()) for m in ACCESS.finditer(data, a, b) if m.end() - m.start() >= ACCESS_LEAST]
    start, stop = _runs(_HEX[buffer], offsets, HEX_LEAST)
    owner = np.searchsorted(offsets, start, "right") - 1
    out += [(d, "hex", s, e) for d, s, e in zip(owner.tolist(), start.tolist(), stop.tolist(), strict=True)]
    return out


def _pair_counts(codes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Counts of neighbouring characters inside the runs, flat."""
    joint = np.zeros(len(codes) + 1, np.int32)
    np.add.at(joint, start, 1)
    np.add.at(joint, stop - 1, -1)
    at = np.flatnonzero(np.cumsum(joint[:-1]) > 0)
    at = at[at + 1 < len(codes)]
    return np.bincount(codes[at].astype(np.int64) * _N + codes[at + 1], minlength=_N * _N)


def samples(docs: DataFrame) -> DataFrame:
    """label (1 random, 0 ordinary), pair (of characters, as a number), n: counts over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _N * _N), np.int64)
        for batch in chunks(batches, "text"):
            buffer, offsets = text_buffer(batch.column("text"))
            codes = _CODE[buffer]
            start, stop = _runs(codes >= 0, offsets, 2)
            spans = base_spans(buffer, offsets)
            matched = np.zeros(len(buffer) + 1, np.int32)
            for _, _, s, e in spans:
                matched[s] += 1
                matched[e] -= 1
            held = np.concatenate([[0], np.cumsum(np.cumsum(matched[:-1]) > 0)])
            random_ = held[stop] - held[start] > 0
            whole = random_ & (stop - start >= ACCESS_LEAST)
            total[1] += _pair_counts(codes, start[whole], stop[whole])
            # long tokens with digits are what has to be judged: they label nothing
            digits = np.concatenate([[0], np.cumsum((codes >= 52) & (codes < 62))])
            plain = ~random_ & ((stop - start < LEAST) | (digits[stop] == digits[start]))
            total[0] += _pair_counts(codes, start[plain], stop[plain])
        label, pair = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(pair.astype(np.int32)), pa.array(total[label, pair])], ["label", "pair", "n"])

    return docs.mapInArrow(run, "label int, pair int, n long").groupBy("label", "pair").agg(F.sum("n").alias("n"))


def seeded_counts(seed: int = 7) -> np.ndarray:
    """Pair counts of random strings: hex, upper case with digits, letters with digits, base64."""
    rng, total = random.Random(seed), np.zeros(_N * _N, np.int64)
    for letters in ("0123456789abcdef", ALPHABET[:26] + "0123456789", ALPHABET[:62], ALPHABET[:64]):
        for _ in range(SEEDED):
            codes = _CODE[np.frombuffer("".join(rng.choices(letters, k=rng.randint(20, 40))).encode(), np.uint8)]
            total += np.bincount(codes[:-1].astype(np.int64) * _N + codes[1:], minlength=_N * _N)
    return total


def train(counts: list[tuple[int, int, int]], seed: int = 7) -> np.ndarray:
    """Log-likelihood ratio of each character pair (66 x 66): log P(second | first) as random less that as ordinary.
    counts: (label, pair, n). Pairs back off to how common the second character is at all, so that characters that
    ordinary words hardly use speak for a random string. Found and seeded random strings weigh alike."""
    total = np.zeros((2, _N * _N), float)
    for label, pair, n in counts:
        total[label, pair] += n
    seeded = seeded_counts(seed)
    if total[1].sum():
        total[1] *= seeded.sum() / total[1].sum()
    total[1] += seeded
    table = total.reshape(2, _N, _N)
    single = table.sum(1) + 0.5
    single /= single.sum(1, keepdims=True)
    chance = (table + BACK_OFF * single[:, None]) / (table.sum(2, keepdims=True) + BACK_OFF)
    return np.log(chance[1]) - np.log(chance[0])


def find(docs: DataFrame, model: np.ndarray, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """doc_id and spans (kind, start, end) of each row, by start, then kind."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            buffer, offsets = text_buffer(batch.column("text"))
            spans = base_spans(buffer, offsets)
            codes = _CODE[buffer]
            start, stop = _runs(codes >= 0, offsets, least)
            if len(start):
                matched = np.zeros(len(buffer) + 1, np.int32)
                for _, _, s, e in spans:
                    matched[s] += 1
                    matched[e] -= 1
                held = np.concatenate([[0], np.cumsum(np.cumsum(matched[:-1]) > 0)])
                for s, e in zip(start.tolist(), stop.tolist(), strict=True):
                    own = codes[s:e]
                    digits = ((own >= 52) & (own < 62)).sum()
                    if held[e] == held[s] and 0 < digits and (own < 52).any() and model[own[:-1], own[1:]].mean() >= ratio:
                        spans.append((int(np.searchsorted(offsets, s, "right") - 1), "random", s, e))
            found: list[list[dict]] = [[] for _ in range(len(batch))]
            if spans:
                heads = np.concatenate([[0], np.cumsum((buffer & 0xC0) != 0x80)])  # code points before each byte
                for d, kind, s, e in sorted(spans, key=lambda x: (x[0], x[2], KINDS.index(x[1]))):
                    zero = heads[offsets[d]]
                    found[d].append({"kind": kind, "start": int(heads[s] - zero), "end": int(heads[e] - zero)})
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "spans"])

    return docs.mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def scan(docs: DataFrame, least: int = LEAST, ratio: float = RATIO) -> DataFrame:
    """Trains on ``docs`` (doc_id, text) and finds secrets in each row: doc_id, spans."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = [(r["label"], r["pair"], r["n"]) for r in samples(docs.select("text")).collect()]  # 2 x 66 x 66 rows at most
    return find(docs, train(counts), least, ratio)
