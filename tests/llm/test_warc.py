"""Exact round trips, broken archives, revisits."""

import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from conftest import SF_SMALL
from tabflaw.llm import warc

PAGES = "page_id bigint, url string, html string"


def b32(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def archive_of(tmp_path, records):
    a = warc.ArchiveWriter(f"file://{tmp_path}")
    for r in records:
        a.add(r)
    return a.close()["path"]


def test_archive_round_trip_one_frame_per_record(tmp_path):
    records = [warc.make_record(k, f"http://x/{k}", b"<p>%d</p>" % k * k, b32("<p>%d</p>" % k * k), 0, None, "2020-01-01T00:00:00Z")
               for k in range(600)]
    path = archive_of(tmp_path, records)
    assert list(warc.read_archive(path)) == records
    data = open(path.removeprefix("file://"), "rb").read()
    magic, size = struct.unpack("<II", data[:8])
    assert magic == warc.SKIPPABLE and data[8:12] == struct.pack("<I", warc.TRAINED)
    assert zstandard.frame_content_size(data[8 + size:8 + size + 32]) == len(records[0])


def test_few_records_use_a_raw_dictionary_and_compressed_ones_load(tmp_path):
    one = warc.make_record(None, None, b"", b32(""), 0, None, "2020-01-01T00:00:00Z")
    assert list(warc.read_archive(archive_of(tmp_path, [one]))) == [one]
    packed = zstandard.ZstdCompressor().compress(b"dictionary content" * 10)
    assert warc.load_dictionary(packed).as_bytes() == b"dictionary content" * 10


@pytest.mark.parametrize("harm", [
    lambda r: r.replace(b"WARC/1.1", b"WARC/0.9", 1), lambda r: r.replace(b"WARC-Date", b"Date", 1),
    lambda r: r.replace(b"Content-Length: 8", b"Content-Length: 9"), lambda r: r[:-4] + b"\r\n", lambda r: r + b"x",
    lambda r: r.replace(b"hello", b"jello"), lambda r: r.replace(b"\r\n\r\n", b"\n\n")])
def test_broken_records_are_refused(harm):
    good = warc.make_record(1, "http://x/", b"hello", b32("hello"), 0, None, "2020-01-01T00:00:00Z")
    warc.read_payload(*warc.parse_record(good))
    with pytest.raises(ValueError):
        warc.read_payload(*warc.parse_record(harm(good)))


def test_cut_off_archives_are_refused(tmp_path):
    path = archive_of(tmp_path, [warc.make_record(1, "u", b"hello", b32("hello"), 0, None, "2020-01-01T00:00:00Z")])
    name = path.removeprefix("file://")
    data = open(name, "rb").read()
    for cut in (4, 20, len(data) - 3):
        open(name, "wb").write(data[:cut])
        with pytest.raises((ValueError, struct.error)):
            list(warc.read_archive(path))


def brute(rows):
    by = {}
    for i, (k, _, h) in enumerate(rows):
        by.setdefault(h or "", []).append((k is not None, k or 0, i))
    out = []
    for h, who in by.items():
        top = max(who, key=lambda w: w[:2])
        key = top[1] if top[0] else None
        first = next(w for w in who if w[:2] == top[:2])
        for w in who:
            k = w[1] if w[0] else None
            out.append((k, len(h.encode()), b32(h), "response" if w is first else "revisit", None if w is first else key))
    return sorted(out, key=repr)


def test_round_trip_against_brute_force(prepared):
    rows = [(1, "http://a/ b\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "", None), (4, "u", ""), (5, "u", "one"),
            (5, "u", "one"), (5, "v", "two"), (None, "u", "two"), (None, "u", "three"), (None, "w", "three"),
            (-7, "u", "x" * 300_000)] + [(k, "u", "same") for k in range(100, 400)]
    df = prepared.createDataFrame(rows, PAGES).repartition(5).withColumn("sha", F.lit("clash")).withColumn("top", F.lit(1))
    got = sorted((tuple(r) for r in warc.round_trip(df).collect()), key=repr)
    assert got == brute(rows)


def test_payloads_come_back(prepared):
    pages = prepared.read.parquet(f"{SF_SMALL}/pages.parquet")
    from tabflaw.llm.common import shared_folder
    archives = warc.write_archives(pages, shared_folder(prepared, "t"))
    got = {r["record_id"].split(":")[2]: bytes(r["payload"]) for r in warc.read_archives(prepared, archives).collect()
           if r["record_type"] == "response"}
    assert got == {str(r["page_id"]): r["html"].encode() for r in pages.collect()}


def test_empty_table(prepared):
    assert warc.round_trip(prepared.createDataFrame([], PAGES)).count() == 0
