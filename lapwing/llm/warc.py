"""WARC archives: writing, reading, and revisit resolution.

An archive is written by Spark's text writer, one record a row; the two line ends that close a record
are the writer's line separator, so files go to whatever store Spark writes to, compressed as a
whole at a fast level.  A file holds what one task has, and FILE_RECORDS records at most.  It is
read back as a binary file, inflated as a stream and cut by Content-Length, so what a reader holds is
the compressed file and one batch of records.

Revisit resolution reads headers only and shuffles them by payload digest: of equal payloads, the
record with the smallest page number stays a response and the others become revisits of it.  The
smallest is found by partial aggregation, and headers are joined to it by digest, which adaptive
execution splits when one payload is very common.  Payloads move once, by record number, to meet
their verdict, and new archives with fresh headers are written.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import frames

RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PRINTABLE = re.compile(r"[\x00-\x1f\x7f]")
FILE_RECORDS = 2000

HEAD = "record_id string, record_type string, page_id long, url string, payload_digest string, payload_bytes long, refers_to_id string, refers_to_url string, refers_to long"
_FIELDS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Target-URI": "url", "WARC-Payload-Digest": "payload_digest", "WARC-Refers-To": "refers_to_id",
    "WARC-Refers-To-Target-URI": "refers_to_url", "X-Page-Number": "page_id", "X-Refers-To-Page-Number": "refers_to",
}


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _line(name: str, value) -> str:
    return "" if value is None else f"{name}: {value}\r\n"


def _address(name: str, value: str | None) -> str:
    """A line for a url; one with white space or control characters is given once without and once escaped, which the reader takes."""
    if value is None:
        return ""
    plain = " ".join(PRINTABLE.sub(" ", value).split())
    return _line(name, plain) + (_line(f"X-Escaped-{name}", quote(value, safe="")) if plain != value else "")


def render(row: dict, date: str) -> str:
    """A WARC/1.1 record without its closing line ends; a revisit has the HTTP head only."""
    payload = row["payload"] if row["record_type"] == "response" else ""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    size = len(http) + len(payload.encode())
    return (
        "WARC/1.1\r\n" + _line("WARC-Type", row["record_type"]) + _line("WARC-Record-ID", f"<urn:uuid:{row['record_id']}>") + _line("WARC-Date", date)
        + _address("WARC-Target-URI", row["url"]) + _line("WARC-Payload-Digest", f"sha1:{row['payload_digest']}") + _line("X-Page-Number", row["page_id"])
        + (_line("WARC-Profile", PROFILE) + _line("WARC-Refers-To", f"<urn:uuid:{row['refers_to_id']}>") + _address("WARC-Refers-To-Target-URI", row["refers_to_url"])
           + _line("WARC-Refers-To-Date", date) + _line("X-Refers-To-Page-Number", row["refers_to"]) if row["record_type"] == "revisit" else "")
        + f"Content-Type: application/http; msgtype=response\r\nContent-Length: {size}\r\n\r\n{http}{payload}"
    )


def parse(archive: BinaryIO, with_payload: bool = True) -> Iterator[tuple[dict, int, bytes | None]]:
    """(header fields, length of the payload, payload if asked for) of each record of an archive, one at a time."""
    at = 0
    while line := archive.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at record {at}")
        fields = dict(x.decode("utf-8").rstrip("\r\n").split(": ", 1) for x in iter(archive.readline, b"\r\n"))
        rest, length = int(fields["Content-Length"]), 0
        while (line := archive.readline()) != b"\r\n":
            rest -= len(line)
            if line[:15].lower() == b"content-length:":
                length = int(line[15:])
        rest -= 2
        payload = archive.read(rest) if with_payload else None
        skip = 4 if with_payload else rest + 4
        while skip > 0:
            skip -= len(archive.read(min(skip, 1 << 20))) or skip
        yield fields, length, payload
        at += 1


def write_archives(records: DataFrame, path: str, date: str | None = None) -> None:
    """Write records (columns of HEAD, and payload as a string) as gzip-compressed archives, dated ``date`` (WARC's form; now, if not given)."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def rendered(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_pydict({"value": [render(r, date) for r in batch.to_pylist()]})

    lines = records.mapInArrow(frames.per_step(rendered, "payload"), "value string")
    lines.write.option("lineSep", RECORD_END).option("compression", "gzip").option("zlib.compress.level", "THREE").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _read(with_payload: bool, verify: bool):
    names = [x.split()[0] for x in HEAD.split(", ")]
    schema = pa.schema([(x.split()[0], pa.int64() if x.endswith("long") else pa.string()) for x in HEAD.split(", ")] + [("payload", pa.string())] * with_payload)

    def work(batches):
        for batch in batches:
            for raw in batch.column("content"):
                rows, have = [], 0
                stream = io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw.as_py())), 1 << 17)
                for fields, length, payload in parse(stream, with_payload or verify):
                    row = dict.fromkeys(names) | {_FIELDS[k]: v for k, v in fields.items() if k in _FIELDS}
                    row |= {_FIELDS[k.removeprefix("X-Escaped-")]: unquote(v) for k, v in fields.items() if k.startswith("X-Escaped-")}
                    for k in ("record_id", "refers_to_id"):
                        row[k] = row[k] and row[k].removeprefix("<urn:uuid:").removesuffix(">")
                    row["payload_digest"] = row["payload_digest"].removeprefix("sha1:")
                    if verify and row["record_type"] == "response" and digest(payload) != row["payload_digest"]:
                        raise ValueError(f"record {row['record_id']} does not match its digest")
                    for k in ("page_id", "refers_to"):
                        row[k] = row[k] and int(row[k])
                    row["payload_bytes"] = length
                    if with_payload:
                        row["payload"] = payload.decode("utf-8")
                        have += len(payload)
                    rows.append(row)
                    if have > frames.STEP_BYTES or len(rows) == FILE_RECORDS:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, have = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return work


def read_archives(spark: SparkSession, path: str, with_payload: bool = True, verify: bool = True) -> DataFrame:
    """Records of the archives under ``path``: columns of HEAD, and payload if asked for; digests of payloads are verified if asked for."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(_read(with_payload, verify), HEAD + ", payload string" * with_payload)


def _as_responses(batch: pa.RecordBatch):
    payloads = [p or "" for p in batch.column("html").to_pylist()]
    raw = [p.encode("utf-8") for p in payloads]
    n = len(raw)
    none = pa.nulls(n, pa.string())
    yield pa.RecordBatch.from_pydict(
        {
            "record_id": batch.column("record_id"), "record_type": ["response"] * n, "page_id": batch.column("page_id"), "url": batch.column("url"),
            "payload_digest": [digest(x) for x in raw], "payload_bytes": [len(x) for x in raw], "refers_to_id": none, "refers_to_url": none, "refers_to": pa.nulls(n, pa.int64()), "payload": payloads,
        }
    )


def responses(pages: DataFrame) -> DataFrame:
    """A response record for each row of ``pages``."""
    rows = pages.select(F.uuid().alias("record_id"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(frames.per_step(_as_responses, "html"), HEAD + ", payload string")


def resolve_revisits(heads: DataFrame, min_bytes: int = 0) -> DataFrame:
    """record_id, record_type, refers_to_id, refers_to_url, refers_to for each header.

    Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest page_id
    (without one: last; ties: by record_id) is the response and the others revisit it.
    """
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "record_id", "url")
    firsts = heads.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min(rank).alias("first"))
    joined = heads.select("record_id", "payload_digest").join(firsts, "payload_digest", "left")
    again = F.col("first").isNotNull() & (F.col("first.record_id") != F.col("record_id"))
    told = lambda name, alias: F.when(again, F.col(f"first.{name}")).alias(alias)
    return joined.select("record_id", F.when(again, "revisit").otherwise("response").alias("record_type"), told("record_id", "refers_to_id"), told("url", "refers_to_url"), told("page_id", "refers_to"))


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = 0) -> None:
    """Read the archives under ``source`` and write them, repeated payloads replaced by revisit records, under ``target``."""
    verdicts = resolve_revisits(read_archives(spark, source, with_payload=False, verify=False), min_bytes)
    records = read_archives(spark, source).drop("record_type", "refers_to_id", "refers_to_url", "refers_to")
    write_archives(records.join(verdicts, "record_id").select(*[x.split()[0] for x in HEAD.split(", ")], "payload"), target)


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives, deduplicate those, read the result back: one row per page with
    page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A null html is an empty payload; urls come back as they were, white space and nulls included.  Repeated rows are one response and revisits of it.  Other columns
    are ignored; an empty table gives an empty result.
    """
    spark = pages.sparkSession
    base = f"{frames.shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(responses(pages), f"{base}/raw")
    deduplicate_archives(spark, f"{base}/raw", f"{base}/deduplicated", min_bytes)
    return read_archives(spark, f"{base}/deduplicated", with_payload=False).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
