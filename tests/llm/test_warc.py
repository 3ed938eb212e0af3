"""Archives: records of every page, chunks, digests."""

from __future__ import annotations

import base64
import gzip
import hashlib

import pytest

from sensorloom.llm import op10_warc as op10
from sensorloom.llm.common import file_paths

SCHEMA = "page_id long, url string, html string, holder long, chunk int, archive string, payload string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, *[None] * (7 - len(r))) for r in rows], SCHEMA)


ROWS = [
    (1, "http://a/x y\r\nWARC-Type: fake", "same"), (2, None, "same"), (3, "http://b", "same"), (4, "u", ""), (5, "", None),
    (6, "http://long", "é" * 70_000 + "\r\n\r\nWARC/1.1\r\n"), (7, "u", "WARC/1.1\r\nWARC-Type: response\r\n\r\n"), (None, "u", "alone"), (None, "u", "same"),
]


@pytest.mark.parametrize("least", [0, 5])
def test_round_trip(spark, tmp_path, least):
    found = op10.archived(pages(spark, ROWS), str(tmp_path), min_bytes=least, chunk_bytes=1_000, archive_bytes=2_000).collect()
    best: dict = {}
    for i, _, h in ROWS:
        if i is not None:
            best[h or ""] = max(i, best.get(h or "", i))
    want = []
    for i, _, h in ROWS:
        raw = (h or "").encode()
        holder = best.get(h or "") if len(raw) >= least else None
        revisit = holder is not None and i != holder
        want.append((str(i), len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", str(holder if revisit else None)))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in found) == sorted(want)
    assert {r.target_uri for r in found if r.page_id in (2, 5)} == {None}
    for path in file_paths(str(tmp_path)):
        raw = gzip.open(path.removeprefix("file://")).read()
        assert raw.startswith(b"WARC/1.1\r\n") and raw.endswith(b"\r\n\r\n")


def test_chunks_add_up(spark, tmp_path):
    text = "0123456789" * 100
    rows = op10.chunks(op10.planned(pages(spark, [(1, "u", text)])), 64)
    assert rows.count() == 16 and max(len(r.data) for r in rows.collect()) == 64
    archives = op10.write_archives(rows, str(tmp_path))
    read = sorted(op10.read_chunks(archives, 100, with_data=True).collect(), key=lambda r: r.chunk)
    assert b"".join(r.data for r in read) == text.encode() and [r.offset for r in read] == list(range(0, 1000, 100))
    for r in read:
        assert r.digest == op10.base32_sha1(hashlib.sha1(text[: r.offset + r.size].encode()).digest())
    assert [r.last for r in read] == [False] * 9 + [True]


def test_no_rows_and_repeated_rows(spark, tmp_path):
    assert op10.archived(pages(spark, []), str(tmp_path / "none")).collect() == []
    twice = op10.archived(pages(spark, [(1, "u", "x"), (1, "u", "x"), (0, "u", "x")]), str(tmp_path / "twice")).collect()
    assert sorted((r.page_id, r.record_type, r.refers_to) for r in twice) == [(0, "revisit", 1), (1, "response", None), (1, "response", None)]


def test_long_ids_next_to_null_ones(spark, tmp_path):
    a, b = 2**60 + 1, 2**60 + 3
    rows = [(a, "u", "x"), (b, "u", "x"), (None, "u", "x"), (2**53 + 1, "u", "y"), (None, "u", "z")]
    found = op10.archived(pages(spark, rows).coalesce(1), str(tmp_path)).collect()
    assert sorted(((r.page_id or 0), r.record_type, r.refers_to) for r in found) == [
        (0, "response", None), (0, "revisit", b), (2**53 + 1, "response", None), (a, "revisit", b), (b, "response", None)
    ]


def test_a_damaged_archive_fails(spark, tmp_path):
    with gzip.open(tmp_path / "x.warc.gz", "wb") as out:
        head = op10.record_head(1, "u", hashlib.sha1(b"abc").hexdigest(), 3, None)
        out.write(head + b"abd\r\n\r\n")
    frame = spark.createDataFrame([(str(tmp_path / "x.warc.gz"),)], "archive string")
    with pytest.raises(Exception, match="another digest"):
        op10.read_chunks(frame).collect()
