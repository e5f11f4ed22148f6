"""Token ids in Simple-8b words: encode documents, write shards, read them back.

A task writes its range of documents as shards of about ``SHARD_IDS`` ids each, so that neither a task's memory nor a file grows with the
input; only a single document of more ids is a shard by itself.

Shard file (little-endian): 8 bytes magic, then int64 documents, ids, blocks, words; int64 doc_id,
int64 ids, uint8 "doc_id is null" of each document; uint32 first word of each block (blocks + 1);
the 64-bit words. A block holds ``BLOCK`` ids (the last one fewer) and starts a word of its own, so that
blocks decode independently and all at once.

A word has its selector in the top four bits: ``COUNTS[s]`` ids of ``WIDTHS[s]`` bits each, lowest first.
A block's last word may have unused places. ``ESCAPE`` says that the next word is one id as it is,
for ids of over 60 bits.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from thicket.llm.shared import filesystem, materialise, publish, shuffle_width, work_dir
from thicket.llm.words import chunks

MAGIC = b"S8BSHRD1"
BLOCK = 4096
SHARD_IDS = 8 << 20
END_ID = 1
#: Ids in a word and bits of each, by selector; selector 15 is the escape.
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
ESCAPE = 15
_NARROWEST = np.searchsorted(1 << WIDTHS, np.arange(1 << 16), "right").astype(np.uint8)
_ROWS = 256  # blocks that are packed together


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of all blocks of ``ids`` (unsigned 64-bit) and the first word of each block (blocks + 1)."""
    ids = np.ascontiguousarray(ids, np.uint64)
    words, firsts = [], [np.zeros(1, np.int64)]
    for at in range(0, len(ids), BLOCK * _ROWS):
        w, n = _pack_rows(ids[at : at + BLOCK * _ROWS])
        words.append(w)
        firsts.append(n)
    return np.concatenate(words) if words else np.zeros(0, np.uint64), np.cumsum(np.concatenate(firsts))


def _pack_rows(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Greedy packing of several blocks side by side: one step makes one word of every block that isn't over."""
    rows = -(-len(ids) // BLOCK)
    size = np.full(rows, BLOCK)
    size[-1] = len(ids) - BLOCK * (rows - 1)
    grid = np.zeros((rows, BLOCK + 60), np.uint64)
    grid[:, :BLOCK].flat[: len(ids)] = ids
    # the narrowest selector for each id alone, then for windows that grow as the counts do
    top = np.zeros((rows, BLOCK + 60), np.uint8)
    kind = _NARROWEST[ids.astype(np.int64)] if ids.max() < len(_NARROWEST) else np.searchsorted(np.uint64(1) << WIDTHS.astype(np.uint64), ids, "right").astype(np.uint8)
    top[:, :BLOCK].flat[: len(ids)] = kind
    select = np.full((rows, BLOCK), 14, np.uint8)
    span = 1
    for s in range(len(COUNTS) - 1, -1, -1):
        n = int(COUNTS[s])
        while span < n:
            step = min(span, n - span)
            top[:, : top.shape[1] - step] = np.maximum(top[:, : top.shape[1] - step], top[:, step:])
            span += step
        select[top[:, :BLOCK] <= s] = s
    counts, widths = np.append(COUNTS, 1), np.append(WIDTHS, 0).astype(np.uint64)
    at, live, where, kinds = np.zeros(rows, np.int64), np.arange(rows), [], []
    while len(live):
        k = select[live, at[live]]
        where.append(live * BLOCK + at[live])
        kinds.append(k)
        at[live] += counts[k]
        live = live[at[live] < size[live]]
    where, kinds = np.concatenate(where), np.concatenate(kinds)
    order = np.argsort(where, kind="stable")
    where, kinds = where[order], kinds[order]
    row, col = where // BLOCK, where % BLOCK
    made = 1 + (kinds == 14)
    place = np.cumsum(made) - made
    words = np.zeros(int(made.sum()), np.uint64)
    for s in np.unique(kinds):
        mine = np.flatnonzero(kinds == s)
        if s == 14:
            words[place[mine]] = np.uint64(ESCAPE << 60)
            words[place[mine] + 1] = grid[row[mine], col[mine]]
            continue
        value = np.full(len(mine), int(s) << 60, np.uint64)
        for j in range(counts[s]):
            value |= grid[row[mine], col[mine] + j] << (np.uint64(j) * widths[s])
        words[place[mine]] = value
    return words, np.bincount(row, made, rows).astype(np.int64)


def unpack(words: np.ndarray, firsts: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of all blocks; every selector's words are decoded together."""
    if not n:
        return np.zeros(0, np.uint64)
    kinds = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(len(words), bool)
    for i in np.flatnonzero(kinds == ESCAPE):  # in order: a raw word may look like an escape
        if not raw[i]:
            raw[i + 1] = True
    heads = np.flatnonzero(~raw)
    kinds = kinds[heads]
    counts = np.append(np.append(COUNTS, 0), 1)[kinds]
    # a block's ids begin at a multiple of BLOCK; unused places of its last word are cut off
    block = np.searchsorted(firsts, heads, "right") - 1
    before = np.cumsum(counts) - counts
    first_head = np.searchsorted(heads, firsts[:-1])
    begin = before - before[first_head[block]] + block * BLOCK
    limit = np.minimum((block + 1) * BLOCK, n)
    out = np.zeros(n, np.uint64)
    for s in np.unique(kinds):
        mine = np.flatnonzero(kinds == s)
        if s == ESCAPE:
            out[begin[mine]] = words[heads[mine] + 1]
            continue
        value, width = words[heads[mine]], np.uint64(WIDTHS[s])
        mask = np.uint64((1 << int(width)) - 1)
        for j in range(COUNTS[s]):
            to = begin[mine] + j
            fits = to < limit[mine]
            out[to[fits]] = (value[fits] >> (np.uint64(j) * width)) & mask
    return out


def shard_bytes(doc_ids: list[int | None], counts: np.ndarray, parts: list[np.ndarray]) -> list[bytes]:
    ids = np.concatenate(parts) if parts else np.zeros(0, np.uint64)
    words, firsts = pack(ids)
    head = np.array([len(doc_ids), len(ids), len(firsts) - 1, len(words)], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    return [MAGIC, head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), counts.astype("<i8").tobytes(), null.tobytes(), firsts.astype("<u4").tobytes(), words.astype("<u8").tobytes()]


def read_shard(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """doc_ids, ids of each document, "doc_id is null" and all ids of a shard."""
    if data[:8] != MAGIC:
        raise ValueError("not a token shard")
    docs, ids, blocks, words = (int(x) for x in np.frombuffer(data, "<i8", 4, 8))
    at, out = 40, []
    for kind, n in (("<i8", docs), ("<i8", docs), ("u1", docs), ("<u4", blocks + 1), ("<u8", words)):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    return out[0], out[1], out[2].astype(bool), unpack(out[4].astype(np.uint64), out[3].astype(np.int64), ids)


#: How the tokenizers with word ends and lower case normalise and cut texts.
_NORMALISERS = ["NFC", "Replace", "Lowercase"]
_CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The same within Latin-1, after lower-casing.
_LATIN_CUT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\t-\r \x85\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies use for each byte: itself if visible, else the next from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(rest)}


class _Known(dict):
    """Index of each known word; a new one is encoded when it is looked up. ``pieces``: where the ids of a word's part first lie in ``flat``, and how many they are."""

    def __init__(self, model: object) -> None:
        super().__init__()
        self.model, self.letters, self.pieces = model, _byte_letters(), {}
        self.flat, self.first = array("I"), array("q", [0])

    def __missing__(self, word: str) -> int:
        for piece in _LATIN_CUT.findall(word):
            place = self.pieces.get(piece)
            if place is None:
                seen = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.letters)
                ids = [t.id for t in self.model.tokenize(seen)]
                self.pieces[piece] = len(self.flat) << 32 | len(ids)
            else:
                ids = self.flat[place >> 32 : (place >> 32) + (place & 0xFFFFFFFF)]
            self.flat.extend(ids)
        self.first.append(len(self.flat))
        self[word] = n = len(self.first) - 2
        return n


class Encoder:
    """A tokenizer file, and the ids of words that it has met.

    The library alone encodes about 1.3 MB a second and core (measured), under half of what this class does.
    Tokenizers that lower-case, drop white space and cut at ``_CUT`` encode each word of a Latin-1 text by
    itself: of such texts the words go to the library's BPE model once each. Every other text (or tokenizer)
    takes the library's whole way. At most ``keep`` words are remembered.
    """

    def __init__(self, path: str, keep: int = 700_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        plan = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (plan["normalizer"] or {}).get("normalizers", [])]
        cuts = (plan["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = steps == _NORMALISERS and [x["type"] for x in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": _CUT}
        self.special = [x["content"] for x in plan["added_tokens"]]
        self.known = _Known(self.tokenizer.model)

    def words(self, text: str) -> list[str] | None:
        """White-space-separated words in lower case, where they encode one by one."""
        if not self.by_word or "|>" in text and any(x in text for x in self.special):
            return None
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return None
        low = text.lower()
        # split() also cuts at \x1c to \x1f, which aren't white space to the tokenizer
        return [w for w in low.translate(_BLANKS).split(" ") if w] if any(c in low for c in "\x1c\x1d\x1e\x1f") else low.split()

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, each followed by ``END_ID``, and how many each has."""
        words = [self.words(t) for t in texts]
        if len(self.known) > self.keep:
            self.known = _Known(self.tokenizer.model)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(w for w in words if w)), np.int64)
        flat, first = np.array(self.known.flat, np.uint32), np.array(self.known.first, np.int64)
        n = first[at + 1] - first[at]
        total = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(first[at] - total[:-1], n) + np.arange(total[-1])]
        ends = total[np.cumsum([len(w or ()) for w in words], dtype=np.int64)]
        counts = np.diff(ends, prepend=0) + 1
        if None not in words:
            return np.insert(ids, ends, END_ID), counts
        parts = []
        for i, (text, end) in enumerate(zip(texts, ends, strict=True)):
            own = ids[end - counts[i] + 1 : end] if words[i] is not None else np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
            counts[i] = len(own) + 1
            parts += [own, np.array([END_ID], np.uint32)]
        return np.concatenate(parts), counts


_BLANKS = str.maketrans(dict.fromkeys("\t\n\v\f\r\x85\xa0", " "))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per Python worker, until the worker reads shards."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def let_go() -> None:
    """Once all is encoded: remembered words shouldn't fill a worker that goes on to other work. A function, as tasks get copies of the globals that they name themselves."""
    _encoders.clear()


def write_shards(docs: DataFrame, path: str, tokenizer: str, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Encodes ``docs`` (doc_id, text) into shards of ranges of doc_id, in ascending order, below ``path``: shard, their names in that
    order.

    Nulls count as empty texts, a null doc_id comes first; equal doc_ids are all kept, ordered by text.
    A shard is written under a name of its own and then renamed, so a task that runs again does no harm.
    """
    width = shuffle_width(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, context, number = encoder(tokenizer), TaskContext.get(), 0
        doc_ids, counts, parts, held = [], [], [], 0

        def close() -> str:
            fs, base = filesystem(path)
            fs.create_dir(base, recursive=True)
            name = f"shard-{context.partitionId():06d}-{number:06d}"
            with fs.open_output_stream(f"{base}/{name}.{context.taskAttemptId()}.tmp") as out:
                for piece in shard_bytes(doc_ids, np.concatenate(counts), parts):
                    out.write(piece)
            publish(fs, f"{base}/{name}.{context.taskAttemptId()}.tmp", f"{base}/{name}.s8b")
            return f"{name}.s8b"

        for batch in chunks(batches, "text", min(6 << 20, 4 * shard_ids)):
            ids, n = coder.encode([t or "" for t in batch.column(1).to_pylist()])
            if held and held + len(ids) > shard_ids:
                yield pa.RecordBatch.from_pydict({"shard": pa.array([close()])})
                doc_ids, counts, parts, held, number = [], [], [], 0, number + 1
            doc_ids += batch.column(0).to_pylist()
            counts.append(n)
            parts.append(ids)
            held += len(ids)
        if doc_ids:
            yield pa.RecordBatch.from_pydict({"shard": pa.array([close()])})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.repartitionByRange(width, "doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(write, "shard string"), "token-shards")


def read_shards(shards: DataFrame, path: str) -> DataFrame:
    """One row per document of the ``shards`` below ``path``: shard, place, doc_id, before, n_tokens, ids_crc32. A task holds one shard
    at a time."""
    width = shuffle_width(shards.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        fs, base = filesystem(path)
        for frame in frames:
            for name in frame["shard"]:
                with fs.open_input_file(f"{base}/{name}") as source:
                    doc_ids, counts, null, ids = read_shard(source.read())
                flat = ids.astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(flat[e - n : e].data) for n, e in zip(counts, ends, strict=True)]
                ids_of = pd.Series(doc_ids).astype("Int64").mask(null)
                yield pd.DataFrame({"shard": name, "place": np.arange(len(counts)), "doc_id": ids_of, "before": ends - counts, "n_tokens": counts, "ids_crc32": np.array(crc, np.int64)})

    return shards.repartition(width, "shard").mapInPandas(read, "shard string, place long, doc_id long, before long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, shard_ids: int = SHARD_IDS) -> DataFrame:
    """Writes shards and reads them back: doc_id, start (ids of all documents before), n_tokens, ids_crc32, shard.

    An empty table gives no file and no row. Other columns, clashing names included, aren't read.
    """
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = path or work_dir(docs.sparkSession, "tokens")
    rows = materialise(read_shards(write_shards(docs, path, tokenizer, shard_ids), path), "token-rows")
    totals = rows.groupBy("shard").agg(F.sum("n_tokens").alias("ids"))
    # one row a shard: the running sum is small, whatever the documents
    begins = totals.select(F.col("shard").alias("of"), (F.sum("ids").over(Window.orderBy("shard")) - F.col("ids")).alias("shard_start"))
    return rows.join(begins, F.col("shard") == F.col("of")).select("doc_id", (F.col("before") + F.col("shard_start")).alias("start"), "n_tokens", "ids_crc32", "shard")
