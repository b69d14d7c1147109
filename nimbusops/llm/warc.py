"""WARC records in ZIP-packaged archives: written by tasks, read back by range without extraction.

An archive holds two stored members: `archive/data.warc.gz`, a gzip member per record, and
`indexes/index.cdx`, a line per record with its offset and length. Readers parse the central (and
ZIP64) directory, take offsets from the index and read runs of records; an archive of any size is
dealt to many tasks that way.

Payloads of equal length and SHA-1, of at least `least_bytes` bytes, are stored once: the record with
the smallest page_id is the response, the others are revisits that refer to it and keep only the HTTP
header. Which payloads repeat comes from a digest count; payloads themselves are not shuffled unless
the table of repeated digests is too large for Spark to broadcast.

Null html counts as an empty payload. Rows without a page_id are responses that nothing refers to.
Rows that repeat the smallest page_id are responses, too. Archives are finished at `ARCHIVE_BYTES` of
records; a larger record makes a larger archive. File names hold the task attempt, and only files that
a finished attempt returned are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nimbusops.llm import zips
from nimbusops.llm.batches import bounded, tidy
from nimbusops.llm.files import open_folder
from nimbusops.session import Staging

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdx"
ARCHIVE_BYTES = 32 << 20
READ_BYTES = 4 << 20
TASK_BYTES = 64 << 20
DATE = "1970-01-01T00:00:00Z"
ID = "urn:x-page:"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def planned(pages: DataFrame, staging: Staging, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, and refers_to for the rows whose payload another row stores."""
    rows = bounded(pages).select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumns(
        {"sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload")})
    repeated = rows.where((F.col("n_bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha1", "n_bytes").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = staging.write("repeated", repeated)
    return rows.join(repeated, ["sha1", "n_bytes"], "left").select(
        "page_id", "url", "payload", F.expr("CASE WHEN page_id <> first THEN first END").alias("refers_to"))


def _clean(url: str | None) -> str:
    return "".join(c if " " < c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(page_id, url: str | None, payload: bytes, refers_to) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
             f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_clean(url)}",
             f"WARC-Payload-Digest: sha1:{digest(payload)}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{ID}{refers_to}>"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def write(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write rows of `planned` as archives into a shared folder; a row per archive: path, bytes, records."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        attempt = TaskContext.get().taskAttemptId()
        body, index, number = bytearray(), [], 0

        def finish() -> pa.RecordBatch:
            nonlocal number
            name = f"{path}/pages-{attempt}-{number}.zip"
            with system.open_output_stream(name) as out:
                zips.write(out, [(DATA, bytes(body)), (INDEX, "".join(index).encode())])
            number += 1
            done = pa.RecordBatch.from_arrays([pa.array([name]), pa.array([len(body)]), pa.array([len(index)])], ["path", "bytes", "records"])
            body.clear()
            index.clear()
            return done

        for batch in batches:
            for page_id, url, payload, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                packer = zlib.compressobj(1, wbits=31)
                packed = packer.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py())) + packer.flush()
                index.append(f"{len(body)} {len(packed)}\n")
                body += packed
                if len(body) >= archive_bytes:
                    yield finish()
        if index:
            yield finish()

    return rows.select("page_id", "url", "payload", "refers_to").mapInArrow(tidy(run), "path string, bytes long, records long")


def locate(archives: DataFrame, folder: str, read_bytes: int = READ_BYTES) -> DataFrame:
    """path, start and lengths of runs of records that lie together, from directories and indexes alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with system.open_input_file(path) as source:
                    members = {m.name: m for m in zips.directory(source, source.size())}
                    base, at = zips.body_at(source, members[DATA]), zips.body_at(source, members[INDEX])
                    index = zips.read_at(source, at, members[INDEX].size)
                runs: list[tuple[int, list[int]]] = []
                for line in index.decode().splitlines():
                    offset, length = map(int, line.split())
                    if not runs or runs[-1][0] + sum(runs[-1][1]) != base + offset or offset + base - runs[-1][0] >= read_bytes:
                        runs.append((base + offset, []))
                    runs[-1][1].append(length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(runs), pa.string()), pa.array([r[0] for r in runs], pa.int64()),
                     pa.array([r[1] for r in runs], pa.list_(pa.int64()))], ["path", "start", "lengths"])

    return archives.select("path").mapInArrow(tidy(run), "path string, start long, lengths array<bigint>")


def parse(raw: bytes) -> dict:
    """Header fields, HTTP header fields and payload of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields | {"http": dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), "payload": payload}


def read(runs: DataFrame, folder: str) -> DataFrame:
    """Records of `locate`'s runs: record_id, record_type, refers_to, payload_bytes, payload_digest, payload.

    A response's digest is checked against its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path, start, lengths in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                with system.open_input_file(path) as source:
                    body = zips.read_at(source, start, sum(lengths))
                at, rows = 0, []
                for length in lengths:
                    found = parse(zlib.decompress(body[at:at + length], wbits=31))
                    at += length
                    stated = found["WARC-Payload-Digest"].removeprefix("sha1:")
                    if found["WARC-Type"] == "response" and digest(found["payload"]) != stated:
                        raise ValueError(f"a payload in {path} differs from its digest")
                    ids = [found.get(k, "").removeprefix(f"<{ID}").removesuffix(">") or None for k in ("WARC-Record-ID", "WARC-Refers-To")]
                    rows.append((ids[0], found["WARC-Type"], ids[1], int(found["http"]["Content-Length"]), stated, found["payload"]))
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (
                    pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()), strict=True)],
                    ["record_id", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"])

    return runs.mapInArrow(tidy(run), "record_id string, record_type string, refers_to string, payload_bytes long, "
                                "payload_digest string, payload binary")


def round_trip(pages: DataFrame, least_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Pages as archives in the shared folder, and the records that are then read from them."""
    staging = Staging(pages.sparkSession)
    folder = f"{staging.path}/archives"
    archives = staging.write("archive-list", write(planned(pages, staging, least_bytes), folder, archive_bytes))
    # Rows that name archives or runs are tiny, what they stand for is not: tasks are dealt by stored bytes.
    stored = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-stored // TASK_BYTES))
    runs = locate(archives.repartition(tasks, "path"), folder).repartition(tasks, "path", "start")
    return read(runs, folder)
