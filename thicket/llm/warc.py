"""WARC archives with revisit records: write records once, resolve equal payloads by their headers, rewrite the archives, read them back.

1. Each task writes its pages as response records (a gzip member each) into *raw* archives and gives their headers: page_id, url, payload
   digest and size, and where the member lies. Payloads go no further; they are never shuffled.
2. Headers are grouped by payload digest: of equal payloads of ``LEAST`` bytes or more the largest page_id is the original. Revisits join it.
3. Headers return to their raw archive, which one task copies member by member; a revisit's member is replaced by a record with a
   header made anew and no payload.
4. The archives are read back as streams, a record at a time; sizes and digests are computed again from the payloads.

An archive ends at ``ROLL`` bytes, so none is too large for a task, whatever the partitions. Files carry the name of the attempt that
wrote them until they are whole, so a task that runs again does no harm.

Defined cases: null html is an empty payload; empty and small payloads are always responses. Rows that repeat the
original's page_id and payload are responses too. A null page_id counts as smaller than any other. A null url is an
empty target. An empty table gives no archive and no row. Other columns aren't read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from thicket.llm.shared import filesystem, join_counted, materialise, publish, remove, shuffle_width, work_dir

LEAST, ROLL = 1000, 64 << 20
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEADERS = "file string, at long, length long, page_id long, url string, digest string, size long"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
_READ = 1 << 20


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id_of(urn: str | None) -> int | None:
    body = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(body) if body else None


def _line(value: str | None) -> str:
    """A header's value: line ends can't be in it."""
    return (value or "").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, digest: str, size: int, payload: bytes | None = None, original: int | None = None) -> bytes:
    """One record as a gzip member: a response with its payload, or without one a revisit of the page ``original``."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if payload is None else 'response'}",
        f"WARC-Record-ID: {_urn(page_id)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url)}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(original)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 1, mtime=0)


def parse(stream: BinaryIO) -> Iterator[dict]:
    """Records of an archive, one at a time; each gzip member is inflated by itself."""
    data = stream.read(_READ)
    while data:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not data and not (data := stream.read(_READ)):
                raise ValueError("a gzip member isn't whole")
            parts.append(inflate.decompress(data))
            data = inflate.unused_data
        data = data or stream.read(_READ)
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"not a WARC record: {lines[0][:40]}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        http, _, payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")
        yield {
            "page_id": _id_of(fields["WARC-Record-ID"]),
            "record_type": fields["WARC-Type"],
            "url": fields["WARC-Target-URI"],
            "payload_digest": base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex(),
            "payload_bytes": int(http.decode("latin-1").rpartition("Content-Length: ")[2].split("\r\n")[0]),
            "refers_to": _id_of(fields.get("WARC-Refers-To")),
            "payload": None if fields["WARC-Type"] == "revisit" else bytes(payload),
        }


def write_raw(pages: DataFrame, path: str, roll: int = ROLL) -> DataFrame:
    """Writes all pages as responses into raw archives below ``path``: HEADERS, a row each."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = filesystem(path)
        context, out, name, number, at = TaskContext.get(), None, "", 0, 0
        for batch in batches:
            rows: list[tuple] = []
            for page_id, url, html in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                payload = html.as_buffer().to_pybytes() if html.is_valid else b""
                digest = hashlib.sha1(payload).hexdigest()
                if out is None:
                    fs.create_dir(base, recursive=True)
                    name, at = f"raw-{context.partitionId():06d}-{context.taskAttemptId()}-{number:06d}", 0
                    out, number = fs.open_output_stream(f"{base}/{name}", compression=None), number + 1
                member = record_bytes(page_id.as_py(), url.as_py(), digest, len(payload), payload)
                out.write(member)
                rows.append((name, at, len(member), page_id.as_py(), url.as_py(), digest, len(payload)))
                at += len(member)
                if at >= roll:
                    out.close()
                    out = None
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["file", "at", "length", "page_id", "url", "digest", "size"])
        if out is not None:
            out.close()

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return materialise(rows.mapInArrow(write, HEADERS), "warc-headers")


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """``headers`` with original: the page_id that a revisit refers to, null for responses."""
    found = headers.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("n")).where("n > 1 and original is not null")
    originals = materialise(found, "warc-originals")
    original = F.when(F.col("page_id").eqNullSafe(F.col("original")), F.lit(None)).otherwise(F.col("original"))
    return join_counted(headers, originals, ["digest"], "left").withColumn("original", original)


def rewrite(resolved: DataFrame, raw: str, path: str) -> DataFrame:
    """Copies raw archives to archives below ``path``, revisits as records of their own: archive, the files' names."""
    width = shuffle_width(resolved.sparkSession)

    def copy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        source_fs, source_base = filesystem(raw)
        fs, base = filesystem(path)
        attempt, current, source, out = TaskContext.get().taskAttemptId(), None, None, None

        def close() -> list[str]:
            if current is None:
                return []
            source.close()
            out.close()
            final = f"{current.replace('raw', 'archive', 1)}.warc.gz"
            publish(fs, f"{base}/{current}.{attempt}.tmp", f"{base}/{final}")
            return [final]

        for batch in batches:
            done: list[str] = []
            for file, at, length, page_id, url, digest, size, original in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file != current:
                    done += close()
                    fs.create_dir(base, recursive=True)
                    current, source = file, source_fs.open_input_file(f"{source_base}/{file}")
                    out = fs.open_output_stream(f"{base}/{file}.{attempt}.tmp", compression=None)
                out.write(source.read_at(length, at) if original is None else record_bytes(page_id, url, digest, size, None, original))
            yield pa.RecordBatch.from_pydict({"archive": pa.array(done, pa.string())})
        yield pa.RecordBatch.from_pydict({"archive": pa.array(close(), pa.string())})

    rows = resolved.select("file", "at", "length", "page_id", "url", "digest", "size", "original")
    return materialise(rows.repartition(width, "file").sortWithinPartitions("file", "at").mapInArrow(copy, "archive string"), "warc-names")


def read_archives(names: DataFrame, path: str) -> DataFrame:
    """RECORDS of the archives of these ``names`` below ``path``, a row each."""
    width = shuffle_width(names.sparkSession)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = filesystem(path)
        for frame in frames:
            for name in frame["archive"]:
                rows = []
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for r in parse(stream):
                        payload = r.pop("payload")
                        if payload is not None and (hashlib.sha1(payload).hexdigest() != r["payload_digest"] or len(payload) != r["payload_bytes"]):
                            raise ValueError(f"the payload of page {r['page_id']} isn't what its header says")
                        rows.append(r)
                out = pd.DataFrame(rows, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
                yield out.astype({"page_id": "Int64", "refers_to": "Int64", "payload_bytes": "Int64"})

    return names.repartition(width, "archive").mapInPandas(read, RECORDS)


def archive(pages: DataFrame, least: int = LEAST, path: str | None = None, roll: int = ROLL) -> DataFrame:
    """Writes the archives of ``pages`` (page_id, url, html) below ``path`` and returns their records: page_id, payload_bytes,
    payload_digest, record_type, refers_to, url. A revisit's size and digest are those of the payload it refers to."""
    spark = pages.sparkSession
    path, raw = path or work_dir(spark, "warc"), work_dir(spark, "warc-raw")
    headers = write_raw(pages, raw, roll)
    names = rewrite(resolve(headers, least), raw, path)
    remove(spark, raw)
    return materialise(read_archives(names, path), "warc-records")
