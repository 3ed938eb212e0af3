"""WARC archives as a table of chunks: written from chunk rows, read back as chunk rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorloom.llm.common import opened, stage, table, work_folder, written

#: Bytes of a chunk, and of an archive before the next is begun.
CHUNK, ARCHIVE = 1 << 20, 1 << 30
#: Payloads of fewer bytes are never written as revisits.
MIN_BYTES = 0
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "urn:x-page:"
CHUNK_SCHEMA = (
    "page_id long, record_type string, refers_to long, target_uri string, archive string, record long, chunk long, "
    "offset long, size long, payload_bytes long, digest string, last boolean"
)


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def planned(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(page_id, url, payload, sha1, holder) of every row; holder is the page a revisit refers to.

    Digests are summed up to the largest page_id with a map-side part, and only ids and digests are moved
    for that; rows whose id is not the holder's then meet their payload by id. So a third of all pages may
    bear one payload.
    """
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha1", F.sha1("payload"))
    marks = rows.where(F.length("payload") >= min_bytes).select("page_id", "sha1")
    groups = marks.groupBy("sha1").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null")
    others = marks.join(groups, "sha1").where(~F.col("page_id").eqNullSafe(F.col("holder"))).select("page_id", "sha1", "holder").distinct()
    others = stage(others, "revisits").select(F.col("page_id").alias("__page"), F.col("sha1").alias("__sha1"), "holder")
    same = F.col("page_id").eqNullSafe(F.col("__page")) & (F.col("sha1") == F.col("__sha1"))
    return rows.join(others, same, "left").select("page_id", "url", "payload", "sha1", "holder")


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """A row per record and chunk, in order; an empty payload has one empty chunk. A revisit has none of its
    payload."""
    n = F.greatest(F.ceil(F.length("payload") / F.lit(float(size))), F.lit(1))
    numbers = F.sequence(F.lit(0).cast("long"), F.when(F.col("holder").isNull(), n - 1).otherwise(0))
    # Numbers first, bytes after: a payload is never there twice.
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("chunk", F.explode(numbers))
    data = F.substring("payload", (F.col("chunk") * size + 1).cast("int"), F.lit(size))
    data = F.when(F.col("holder").isNull(), data).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "sha1", "holder", "payload_bytes", F.col("chunk").cast("int").alias("chunk"), data.alias("data"))


def _uri(url: str | None) -> str:
    """White space and control characters would end a header line."""
    return re.sub(r"[\x00-\x20\x7f-\xa0  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "")


def record_name(page: int | None) -> str:
    return f"<{RECORD}{'none' if page is None else page}>"


def _page(name: str) -> int | None:
    found = re.fullmatch(rf"<{RECORD}(-?\d+)>", name)
    return int(found[1]) if found else None


def record_head(page: int | None, url: str | None, sha1: str, size: int, holder: int | None) -> bytes:
    """Header of the record and of its HTTP response. A revisit repeats the HTTP header of the full payload
    and nothing of the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if holder is None else 'revisit'}",
        f"WARC-Record-ID: {record_name(page)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url else []),
        f"WARC-Payload-Digest: sha1:{base32_sha1(bytes.fromhex(sha1))}",
        *([f"WARC-Refers-To: {record_name(holder)}", f"WARC-Profile: {PROFILE}"] if holder is not None else []),
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(http) + (size if holder is None else 0)}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + http


class _Archive:
    """One archive; every record is a gzip member, deflated chunk by chunk."""

    def __init__(self, path: str):
        self.path, self.bytes, self.records = path, 0, 0
        self.file = written(path)
        self.out = self.file.__enter__()

    def put(self, raw: bytes) -> None:
        self.bytes += self.out.write(raw) or len(raw)

    def begin(self, head: bytes) -> None:
        self.member = zlib.compressobj(6, zlib.DEFLATED, 31)
        self.put(self.member.compress(head))

    def data(self, raw: bytes) -> None:
        self.put(self.member.compress(raw))

    def end(self) -> None:
        self.put(self.member.compress(b"\r\n\r\n") + self.member.flush())
        self.records += 1


def write_archives(rows: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write chunk rows to archives and return (archive, records). A task writes archives of its own names
    and names them when they are whole; those of a task that died are in no row returned, so readers of
    these rows never see a record twice. The payload's digest is carried from chunk to chunk and must be the
    planned one."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive, done, sha, want = None, [], None, None

        def finish() -> None:
            nonlocal sha
            if sha is not None:
                if want is not None and sha.hexdigest() != want:
                    raise ValueError("payload changed while it was written")
                archive.end()
                sha = None

        try:
            for frame in frames:
                columns = (frame[c] for c in ("page_id", "url", "sha1", "holder", "payload_bytes", "chunk", "data"))
                for page, url, sha1, holder, size, chunk, data in zip(*columns, strict=True):
                    page, holder = (None if x is None else int(x) for x in (page, holder))
                    if chunk == 0:
                        finish()
                        if archive and archive.bytes >= archive_bytes:
                            archive.file.__exit__(None, None, None)
                            done.append(archive)
                            archive = None
                        if archive is None:
                            archive = _Archive(f"{folder}/{uuid.uuid4().hex}.warc.gz")
                        archive.begin(record_head(page, url, sha1, size, holder))
                        sha, want = hashlib.sha1(), sha1 if holder is None else None
                    sha.update(data)
                    archive.data(data)
            finish()
        except BaseException as error:
            if archive:
                try:
                    archive.file.__exit__(type(error), error, None)
                except BaseException:  # the first error is the one to tell
                    pass
            raise
        if archive:  # an empty partition writes nothing and says nothing
            archive.file.__exit__(None, None, None)
            done.append(archive)
            yield pd.DataFrame({"archive": [a.path for a in done], "records": [a.records for a in done]})

    # Ids go as text: longs with nulls among them would come as floats.
    named = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "holder")})
    return named.mapInPandas(write, "archive string, records long")


def _headers(stream) -> dict[str, str]:
    out = {}
    while (line := stream.readline()) not in (b"\r\n", b""):
        name, _, value = line.decode().rstrip("\r\n").partition(": ")
        out[name.lower()] = value
    return out


def _records(path: str, chunk_bytes: int) -> Iterator[tuple]:
    """Chunk rows of an archive, read as a stream; memory holds one chunk."""
    with opened(path) as raw, gzip.GzipFile(fileobj=raw) as stream:
        record = 0
        while line := stream.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"{path}: record {record} does not begin with a version")
            head = _headers(stream)
            left = int(head["content-length"])
            before = stream.tell()
            stream.readline()
            http = _headers(stream)
            left -= stream.tell() - before
            refers = _page(head.get("warc-refers-to", ""))
            fixed = (_page(head["warc-record-id"]), head["warc-type"], refers, head.get("warc-target-uri"), path, record)
            total, told = int(http["content-length"]), head["warc-payload-digest"].removeprefix("sha1:")
            sha, offset, chunk = hashlib.sha1(), 0, 0
            if head["warc-type"] == "revisit":
                yield (*fixed, 0, 0, 0, total, told, True, b"")
            while head["warc-type"] != "revisit":
                data = stream.read(min(chunk_bytes, left)) if left else b""
                if left and not data:
                    raise ValueError(f"{path}: record {record} is cut off")
                sha.update(data)
                left -= len(data)
                digest = base32_sha1(sha.digest())
                if not left and digest != told:
                    raise ValueError(f"{path}: record {record} has another digest than it says")
                yield (*fixed, chunk, offset, len(data), total, digest, not left, data)
                offset, chunk = offset + len(data), chunk + 1
                if not left:
                    break
            record += 1


def read_chunks(archives: DataFrame, chunk_bytes: int = CHUNK, with_data: bool = False) -> DataFrame:
    """Rows (page_id, record_type, ..., chunk, offset, size, digest, last) of archives (archive string). `digest` is
    that of the payload up to and with the chunk, so the row marked `last` has the payload's. An archive
    is one task, read front to back; with_data adds the chunk's bytes."""
    names = [c.strip().split(" ")[0] for c in CHUNK_SCHEMA.split(",")] + ["data"]

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path in frame["archive"]:
                rows, held = [], 0
                for row in _records(path, chunk_bytes):
                    rows.append(row if with_data else row[:-1])
                    held += len(row[-1]) if with_data else 0
                    if len(rows) >= 10_000 or held >= 8 * chunk_bytes:
                        yield as_frame(rows)
                        rows, held = [], 0
                if rows:
                    yield as_frame(rows)

    def as_frame(rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=names if with_data else names[:-1], dtype=object)
        return frame.assign(**{c: pd.array(frame[c], "Int64") for c in ("page_id", "refers_to")})

    parts = max(1, archives.count())
    # A sequence number deals archives evenly; a hash of their names would not.
    return archives.select("archive").repartition(parts).mapInPandas(read, CHUNK_SCHEMA + (", data binary" if with_data else ""))


def archived(pages: DataFrame, folder: str | None = None, min_bytes: int = MIN_BYTES, chunk_bytes: int = CHUNK, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Write a record per row of (page_id, url, html), read the archives back, and return per record
    (page_id, payload_bytes, payload_digest, record_type, refers_to, target_uri).

    Null html is an empty payload; equal payloads of min_bytes or more refer to the row with the largest
    page_id. Rows that repeat that id with that payload are all responses; a null id is never referred to,
    and where all ids are null, all are responses. A null or empty url has no target. Long payloads go and
    come in chunks. No rows write no archive and give no rows. Other columns are not read.
    """
    folder = folder or work_folder(pages.sparkSession, "warc")
    archives = stage(write_archives(chunks(planned(pages, min_bytes), chunk_bytes), folder, archive_bytes), "archives")
    rows = read_chunks(archives, chunk_bytes).where("last")
    return rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to", "target_uri")


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(table(spark, sf_dir, "pages")).drop("target_uri")


#: Digests without archives. DuckDB has sha1 in hexadecimal; base32 takes five bits at a time.
ORACLE = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), g AS (
  SELECT hex, max(page_id) AS holder FROM p GROUP BY hex
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + (((('0x' || substr(hex || '0', (i * 5 // 4 + 1)::BIGINT, 2))::INT) >> (3 - (i * 5 % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> holder THEN holder END AS refers_to
FROM p JOIN g USING (hex)
"""
