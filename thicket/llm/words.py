"""Vectorised words and word-window hashes over Arrow text columns.

Everything works on the UTF-8 bytes of many documents at once. A word is a maximal run of bytes of a
class, so classes may hold any ASCII characters and all or none of the others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
U64 = np.uint64
_BYTE_BASE, _WORD_BASE = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95 | 1


def byte_class(drop: str, ascii_only: bool = False) -> np.ndarray:
    """256 booleans: False for the bytes of ``drop`` (and, if ``ascii_only``, for those from 128 on)."""
    out = np.ones(256, bool)
    out[[ord(c) for c in drop]] = False
    if ascii_only:
        out[128:] = False
    return out


#: Every character but space and \t \n \v \f \r.
SPACED = byte_class(" \t\n\v\f\r")
#: Letters, digits and everything beyond ASCII.
ALNUM = byte_class("".join(chr(i) for i in range(128) if not chr(i).isalnum()))
KEEP = np.arange(256, dtype=np.uint8)
#: A-Z to a-z.
LOWER = KEEP.copy()
LOWER[65:91] += 32


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, grown as needed."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, U64), np.ones(1, U64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = 1 << max(20, (n - 1).bit_length())
            for name, base in (("up", self.base), ("down", self.inverse)):
                factors = np.full(size, base, U64)
                factors[0] = 1
                setattr(self, name, np.multiply.accumulate(factors))
        return self.up[:n], self.down[:n]


_powers = {b: _Powers(b) for b in (_BYTE_BASE, _WORD_BASE)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (the splitmix64 finaliser)."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def ranges_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray, base: int) -> np.ndarray:
    """Polynomial (Rabin-Karp) hashes modulo 2^64 of ``values[start:end]`` for many ranges, from prefix sums."""
    up, down = _powers[base].get(len(values) + 1)
    sums = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return (sums[end] - sums[start]) * down[start]


@dataclass
class Words:
    """Words of a chunk of documents, in order. ``first`` (documents + 1): index of each document's first word."""

    buffer: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def windows(self, k: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of ``k`` consecutive words at every position where they lie in one document, and those positions."""
        at = np.flatnonzero(np.arange(k, k + len(self.hash)) <= np.repeat(self.first[1:], self.counts))
        values = mix(self.hash ^ U64(salt)) if salt else self.hash
        return mix(ranges_hash(values, at, at + k, _WORD_BASE) ^ U64(k)), at


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets (rows + 1) into them; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if not len(column) or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def split_words(column: pa.Array, word: np.ndarray = SPACED, fold: np.ndarray = KEEP) -> Words:
    """Words of every text: maximal runs of bytes b with ``word[fold[b]]``, hashed after folding."""
    buffer, offsets = text_buffer(column)
    if len(buffer) == 0:
        none = np.zeros(0, np.int64)
        return Words(buffer, offsets, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, U64))
    if fold is not KEEP:
        buffer = fold[buffer]
    inside = word[buffer]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    edges = np.unique(offsets[:-1])
    edges = edges[edges < len(buffer)]
    begins[edges] = inside[edges]
    closes = inside.copy()
    closes[:-1] &= ~inside[1:]
    last = np.unique(offsets[1:]) - 1
    last = last[last >= 0]
    closes[last] = inside[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
    values = ranges_hash(buffer.astype(U64) + U64(1), start, end, _BYTE_BASE)
    return Words(buffer, offsets, start, end, np.searchsorted(start, offsets), mix(values ^ ((end - start).astype(U64) << U64(40))))


def chunks(batches: Iterator[pa.RecordBatch], column: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text, so that temporary arrays stay small.

    Whole rows only: a longer text is a batch by itself.
    """
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(text), 0), np.int64)) if len(text) else np.zeros(0)
        at = 0
        while at < len(sizes):
            before = sizes[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(sizes, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to
