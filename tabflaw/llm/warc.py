"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: rows become WARC/1.1 records.  Among records of equal payload the one
with the largest key is a ``response`` with the payload as an HTTP message; the
others are ``revisit`` records that name it and hold the HTTP header only.
Each task streams its records into archives of its own in a shared folder,
named at random, so a task that runs twice never touches another's file; the
table of archives (written, not recomputed) lists those that count.

Reading: the first frame of an archive is skippable and holds the dictionary
(trained or raw content, itself possibly compressed).  Every following frame
is one record; it is decoded on its own, its header lines, its lengths and its
digests are checked, and a record that breaks a rule ends the job with the
archive's name and offset.  A reader holds one record at a time.

Folders are URIs; ``file:`` and whatever pyarrow's file systems know
(``hdfs:``, ``s3:``, ``gs:``) work.

Defined results: a null payload is empty.  A null key sorts before all others.
Rows that repeat key and payload are one response (if the key is the largest)
and revisits to it.  Null or odd addresses are replaced or percent-encoded.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, written

#: Fixed values of the formats: magic numbers of the dictionary's skippable frame, a Zstandard frame and a trained dictionary.
SKIPPABLE, FRAME, TRAINED = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NEEDED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")

DICT_BYTES = 16 << 10            # size of a trained dictionary
SAMPLE_BYTES, SAMPLE_ROWS = 2 << 20, 400       # what it is trained on: an archive's first records
ROTATE_BYTES = 256 << 20         # an archive's uncompressed size, at most one record more
CHUNK = 1 << 20
MANIFEST = "path string, records bigint, bytes bigint"
RECORD = ("record_type string, record_id string, target_uri string, refers_to_id string, "
          "payload binary, payload_bytes bigint, payload_digest string")


# --- one record -------------------------------------------------------------------------------------------------

def base32_digest(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def record_id(key, digest: str, n: int) -> str:
    """A record's identifier; equal keys and payloads are numbered."""
    return f"<urn:page:{'null' if key is None else key}:{digest}:{n}>"


def make_record(key, url: str | None, payload: bytes, digest: str, n: int, refers_to: str | None, date: str) -> bytes:
    """A whole response record, or a revisit record if ``refers_to`` names one."""
    block = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n").encode()
    if refers_to is None:
        block += payload
    uri = quote(url, safe="!#$%&'()*+,/:;=?@[]~-._") if url else f"urn:page:{'null' if key is None else key}"
    lines = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", record_id(key, digest, n)),
             ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"),
             ("WARC-Block-Digest", f"sha1:{base32_digest(hashlib.sha1(block).digest())}"),
             ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    if refers_to is not None:
        lines += [("WARC-Refers-To", refers_to), ("WARC-Profile", REVISIT_PROFILE)]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n"
    return head + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; ValueError if a rule is broken."""
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise ValueError("no end of header")
    first, *rest = data[:end].split(b"\r\n")
    if first != VERSION:
        raise ValueError(f"version line {first[:20]!r}")
    head: dict[str, str] = {}
    for line in rest:
        name, colon, value = line.decode("utf-8").partition(":")
        if not colon or not name or name in head:
            raise ValueError(f"header line {line[:40]!r}")
        head[name] = value.strip()
    for name in NEEDED:
        if name not in head:
            raise ValueError(f"no {name}")
    if not head["Content-Length"].isdigit():
        raise ValueError("Content-Length is no number")
    block = data[end + 4:end + 4 + int(head["Content-Length"])]
    if len(block) != int(head["Content-Length"]) or data[end + 4 + len(block):] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    if (d := head.get("WARC-Block-Digest")) and d != f"sha1:{base32_digest(hashlib.sha1(block).digest())}":
        raise ValueError("block digest")
    return head, block


def read_payload(head: dict[str, str], block: bytes) -> tuple[bytes | None, int, str]:
    """Payload (None in a revisit), its full length and its digest, after the checks that the two allow."""
    http, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of the HTTP header")
    fields = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
    length, digest = int(fields[b"Content-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:")
    if head["WARC-Type"] == "revisit":
        if body or "WARC-Refers-To" not in head or head.get("WARC-Profile") != REVISIT_PROFILE:
            raise ValueError("revisit with a payload, or without its reference or profile")
        return None, length, digest
    if len(body) != length or base32_digest(hashlib.sha1(body).digest()) != digest:
        raise ValueError("payload length or digest")
    return body, length, digest


# --- one archive ------------------------------------------------------------------------------------------------

def train(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for an archive: trained where the records suffice, else their first bytes as raw content."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples)
    except zstandard.ZstdError:
        raw = b"".join(s[:1024] for s in samples[:16])[:DICT_BYTES]
        return zstandard.ZstdCompressionDict(raw.ljust(8, b"\0"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def load_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    if content[:4] == struct.pack("<I", FRAME):
        content = zstandard.ZstdDecompressor().decompressobj().decompress(content)
    kind = zstandard.DICT_TYPE_FULLDICT if content[:4] == struct.pack("<I", TRAINED) else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(content, dict_type=kind)


class ArchiveWriter:
    """One archive; the dictionary is made from its first records, which wait until then."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        store, at = fs.FileSystem.from_uri(self.path)
        store.create_dir(at.rpartition("/")[0], recursive=True)
        self.out = store.open_output_stream(at, compression=None)      # the frames are made here, one per record
        self.waiting: list[bytes] | None = []
        self.records = self.bytes = 0

    def add(self, record: bytes) -> None:
        self.records += 1
        self.bytes += len(record)
        if self.waiting is None:
            self.out.write(self.packer.compress(record))
        else:
            self.waiting.append(record)
            if self.bytes >= SAMPLE_BYTES or self.records >= SAMPLE_ROWS:
                self._begin()

    def _begin(self) -> None:
        first, self.waiting = self.waiting, None
        dictionary = train(first)
        content = dictionary.as_bytes()
        self.packer = zstandard.ZstdCompressor(level=3, dict_data=dictionary, write_content_size=True)
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        for record in first:
            self.out.write(self.packer.compress(record))

    def close(self) -> dict:
        if self.waiting is not None:
            self._begin()
        self.out.close()
        return {"path": self.path, "records": self.records, "bytes": self.bytes}


def read_archive(path: str) -> Iterator[bytes]:
    """The records of an archive, one frame each."""
    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_stream(at, compression=None) as source:
        def full(n: int) -> bytes:
            got = b""
            while len(got) < n and (more := source.read(n - len(got))):
                got += more
            if len(got) < n:
                raise ValueError(f"{path}: cut off within its dictionary")
            return got

        magic, size = struct.unpack("<II", full(8))
        if magic != SKIPPABLE:
            raise ValueError(f"{path}: no leading dictionary frame")
        unpacker = zstandard.ZstdDecompressor(dict_data=load_dictionary(full(size)))
        rest, offset = b"", 8 + size
        while rest or (rest := source.read(CHUNK)):
            frame, parts, got = unpacker.decompressobj(), [], 0
            while True:
                parts.append(frame.decompress(rest))
                got += len(rest)
                if frame.eof:
                    break
                if not (rest := source.read(CHUNK)):
                    raise ValueError(f"{path}: cut off within the frame at {offset}")
            rest = frame.unused_data
            offset += got - len(rest)
            yield b"".join(parts)


# --- Spark ------------------------------------------------------------------------------------------------------

def write_archives(rows: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html",
                   date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write every row as a record; returns the table of archives (path, records, bytes).

    Payloads are shuffled once, by key and payload digest (both together, so
    neither a popular payload nor a missing key gathers in one task).  Which
    record is the response comes from a count per digest that is combined
    before its shuffle, joined to keys and digests only.
    """
    body = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    keyed = rows.select(F.col(key).cast("bigint").alias("key"), F.col(url).cast("string").alias("url"),
                        body.alias("payload")).withColumn("sha", F.sha1("payload"))
    at = F.concat(F.coalesce(F.col("key").cast("string"), F.lit("null")), F.lit(":"), F.col("sha")).alias("at")
    tops = keyed.groupBy("sha").agg(F.max("key").alias("top"), F.count("*").alias("n")).filter("n > 1").drop("n")
    others = keyed.select("key", "sha", at).join(tops, "sha").filter("key is null and top is not null or key < top") \
        .groupBy("at").agg(F.max("top").alias("top"))
    ready = keyed.select("key", "url", "payload", "sha", at).repartition("at").join(others, "at", "left") \
        .sortWithinPartitions("at").select("at", "key", "url", "payload", "sha", "top")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, before, n, made = None, None, 0, []
        for batch in batches:
            for r in batch.to_pylist():
                n = n + 1 if r["at"] == before else 0
                before, digest = r["at"], base32_digest(bytes.fromhex(r["sha"]))
                first = r["top"] if r["top"] is not None else r["key"]
                refers = record_id(first, digest, 0) if n or r["top"] is not None else None
                if archive is None:
                    archive = ArchiveWriter(folder)
                archive.add(make_record(r["key"], r["url"], r["payload"], digest, n, refers, date))
                if archive.bytes >= ROTATE_BYTES:
                    made.append(archive.close())
                    archive = None
        if archive is not None:
            made.append(archive.close())
        if made:
            yield pa.RecordBatch.from_pylist(made)

    return written(ready.mapInArrow(write, MANIFEST), "warc-archives")


def read_archives(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the archives (a row each; RECORD), checked while they are read."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
                            ("refers_to_id", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string())])
        rows, held = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                for n, data in enumerate(read_archive(r["path"])):
                    try:
                        head, block = parse_record(data)
                        body, size, digest = read_payload(head, block)
                    except (ValueError, KeyError) as e:
                        raise ValueError(f"{r['path']}, record {n}: {e}") from e
                    rows.append((head["WARC-Type"], head["WARC-Record-ID"], head.get("WARC-Target-URI"),
                                 head.get("WARC-Refers-To"), body if payloads else None, size, digest))
                    held += len(body or b"") if payloads else 100
                    if held >= CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                        rows, held = [], 0
                if n + 1 != r["records"]:
                    raise ValueError(f"{r['path']}: {n + 1} records, {r['records']} written")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    n = max(1, min(archives.count(), 10_000))          # archives are of bounded size; a task reads one or a few
    return archives.select("path", "records").repartition(n, "path").mapInArrow(read, RECORD)


def page_of(identifier):
    """The key in a record identifier (null for a missing key)."""
    found = F.regexp_extract(identifier, r"^<urn:page:(-?\d+):", 1)
    return F.when(found != "", found.cast("bigint"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages(page_id, url, html) and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    archives = write_archives(pages, shared_folder(spark, "warc"))
    return read_archives(spark, archives, payloads=False).select(
        page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page_of(F.col("refers_to_id")).alias("refers_to"))
