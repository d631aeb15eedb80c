"""WARC archives as seekable Zstandard bundles.

A bundle is a file of independent Zstandard frames, each with the records of
about ``FRAME_BYTES``. Two skippable frames end it: the record index, which maps each
page id to frame, offset inside the decompressed frame and length, and the seek
table (the published seekable format: compressed and decompressed size of each
frame). So a bundle can be searched on its own, and one record costs one frame's read
and decompression. The index over all bundles is a table with the same places.

Records are WARC/1.1: a warcinfo record begins a bundle, and responses hold an HTTP
message whose body is the payload. Of records with equal payloads of at least
``min_bytes``, the one with the smallest page id is the response, the others are
revisits that name its page, URL and date and carry the full payload's digest and
length but no payload. Bundles are written by Spark tasks
to the shared folder under names of their own; the index lists those of the
attempts that succeeded, so files of lost executors are never read.

Defined results: a null html is an empty payload; rows with the same id and
payload are written one by one, and where that id is the smallest all are
responses; a null id sorts last and its records name no page; a URL with spaces or
control characters is written percent-encoded and kept beside it; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import struct
import uuid
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote

import pandas as pd
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbridge.llm.common import bound_batches
from tillbridge.session import materialize, scratch_path

FRAME_BYTES = 1 << 20
BUNDLE_BYTES = 256 << 20
LEVEL = 3
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, FOOTER_BYTES = 0x184D2A5E, 0x8F92EAB1, 9
READ_BYTES = 16 << 20
VISIBLE = "".join(map(chr, range(0x21, 0x7F)))
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, bundle string, frame_start long, frame_bytes long, frame_plain long, offset long, length long"
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, html string"


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def shared_uri(spark: SparkSession, path: str) -> str:
    """The path with its file system named, as Spark itself would resolve it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(target).toString()


def open_uri(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path; Hadoop writes local URIs with one slash."""
    return pafs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


def _headed(first: str, fields: list[tuple[str, str]], body: bytes) -> bytes:
    return (first + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + body


def _uri(name: str, url: str) -> list[tuple[str, str]]:
    """Header of a URL; one that header lines or URIs cannot hold is kept in base64 beside its encoded form."""
    if url and all(c > " " and c != "\x7f" and not c.isspace() for c in url):
        return [(name, url)]
    return [(name, quote(url, safe=VISIBLE) or "urn:none"), (f"X-Original-{name}", base64.b64encode(url.encode()).decode())]


def warc_record(kind: str, date: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    named = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", date), *fields, ("Content-Length", str(len(block)))]
    return _headed("WARC/1.1", named, block) + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, html: str | None, date: str, first: tuple[int, str] | None) -> bytes:
    """One page; ``first`` is the page and URL of the response that a revisit refers to."""
    payload = (html or "").encode()
    page = [] if page_id is None else [("X-Page-ID", str(page_id))]
    fields = [*page, *_uri("WARC-Target-URI", url or ""), ("WARC-Payload-Digest", f"sha1:{sha1_base32(payload)}"), ("X-Payload-Length", str(len(payload))), ("Content-Type", "application/http; msgtype=response")]
    answer = [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    if first is None:
        return warc_record("response", date, fields, _headed("HTTP/1.1 200 OK", answer, payload))
    refers = [("WARC-Profile", REVISIT), *_uri("WARC-Refers-To-Target-URI", first[1]), ("WARC-Refers-To-Date", date), ("X-Refers-To-Page", str(first[0]))]
    return warc_record("revisit", date, [*refers, *fields], _headed("HTTP/1.1 200 OK", answer, b""))


def _fields(head: bytes) -> dict[str, str]:
    return dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])


def parse(data: bytes) -> tuple:
    """A record's fields; payload size and digest of a response come from its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = _fields(head)
    _, _, body = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    page_id = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
    kept = fields.get("X-Original-WARC-Target-URI")
    url = fields["WARC-Target-URI"] if kept is None else base64.b64decode(kept).decode()
    if fields["WARC-Type"] == "revisit":
        return page_id, int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", int(fields["X-Refers-To-Page"]), url, None
    return page_id, len(body), sha1_base32(body), "response", None, url, body.decode()


class Bundle:
    """Writer of one bundle; ``rows`` are the index rows of what it holds."""

    def __init__(self, folder: str, date: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        files, path = open_uri(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path, compression=None)
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.buffer, self.waiting, self.frames, self.rows, self.at = bytearray(), [], [], [], 0
        about = _headed("", [("software", "tillbridge"), ("format", "WARC File Format 1.1")], b"")[2:-2]
        self.buffer += warc_record("warcinfo", date, [("WARC-Filename", self.uri.rpartition("/")[2]), ("Content-Type", "application/warc-fields")], about)

    def add(self, page_id: int | None, data: bytes) -> None:
        self.waiting.append((page_id, len(self.buffer), len(data)))
        self.buffer += data
        if len(self.buffer) >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if not self.buffer:
            return
        frame = self.packer.compress(bytes(self.buffer))
        self.out.write(frame)
        self.frames.append((len(frame), len(self.buffer)))
        self.rows += [(i, self.uri, self.at, len(frame), len(self.buffer), offset, size) for i, offset, size in self.waiting]
        self.at += len(frame)
        self.buffer, self.waiting = bytearray(), []

    def close(self) -> list[tuple]:
        self.end_frame()
        number = {start: k for k, start in enumerate(dict.fromkeys(r[2] for r in self.rows))}
        listed = zstandard.compress(json.dumps([(r[0], number[r[2]], r[5], r[6]) for r in self.rows]).encode(), LEVEL)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(listed)) + listed)
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.out.close()
        return self.rows


def seek_table(uri: str) -> list[tuple[int, int, int]]:
    """(start, compressed, decompressed) of each frame, from the bundle's footer alone."""
    files, path = open_uri(uri)
    with files.open_input_file(path) as source:
        size = source.size()
        count, _, magic = struct.unpack("<IBI", source.read_at(FOOTER_BYTES, size - FOOTER_BYTES))
        if magic != SEEKABLE_MAGIC:
            raise ValueError(f"{uri} has no seek table")
        entries = struct.unpack(f"<{2 * count}I", source.read_at(8 * count, size - FOOTER_BYTES - 8 * count))
    out, at = [], 0
    for packed, plain in zip(entries[::2], entries[1::2]):
        out.append((at, packed, plain))
        at += packed
    return out


def record_index(uri: str) -> list[tuple[int | None, int, int, int]]:
    """(page_id, frame number, offset, length) of each record, from the bundle alone."""
    frames = seek_table(uri)
    at = sum(frames[-1][:2]) if frames else 0
    files, path = open_uri(uri)
    with files.open_input_file(path) as source:
        magic, size = struct.unpack("<II", source.read_at(8, at))
        if magic != SKIPPABLE_MAGIC or at + 16 + size + 8 * len(frames) + FOOTER_BYTES != source.size():  # the seek table follows
            raise ValueError(f"{uri} has no record index")
        return [tuple(x) for x in json.loads(zstandard.decompress(source.read_at(size, at + 8)))]


def lookup(uri: str, page_id: int) -> list[tuple]:
    """The parsed records of a page in one bundle, each from its own frame."""
    frames, found = seek_table(uri), []
    files, path = open_uri(uri)
    for _, frame, offset, length in (r for r in record_index(uri) if r[0] == page_id):
        start, packed, plain = frames[frame]
        with files.open_input_file(path) as source:
            data = zstandard.ZstdDecompressor().decompress(source.read_at(packed, start), max_output_size=plain)
        found.append(parse(data[offset:offset + length]))
    return found


def roles(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, digest, refers_to and its URL, of the revisits: digests are computed once and combined before the shuffle."""
    digest = F.pandas_udf(lambda html: html.map(lambda h: hashlib.sha1((h or "").encode()).digest()), "binary")
    seen = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), digest(F.col("html")).alias("digest"), F.octet_length(F.coalesce("html", F.lit(""))).cast("long").alias("size"))
    seen = materialize(seen, "digests").where(F.col("size") >= min_bytes)
    first = seen.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "url")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 AND NOT first.unnamed")
    # the few shared digests are the lookup side; a hot one is split by adaptive execution on the left
    twins = seen.join(first, "digest").where("page_id is null or page_id <> first.page_id")
    return twins.select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("refers_url"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, date: datetime | None = None) -> DataFrame:
    """Writes the bundles now and returns their index; ``date`` is when the pages were fetched (now)."""
    spark = pages.sparkSession
    bound_batches(spark)
    target = shared_uri(spark, folder or scratch_path(spark, "warc"))
    twins = roles(pages, min_bytes).select(F.col("page_id").alias("twin_id"), "refers_to", "refers_url", F.hex("digest").alias("twin_digest")).distinct()
    stamp = (date or datetime.now(UTC)).astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    joined = rows.join(twins, F.col("page_id").eqNullSafe(F.col("twin_id")) & (F.upper(F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8"))) == F.col("twin_digest")), "left")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bundle, size = None, 0
        for batch in batches:
            for page_id, url, html, refers_to, refers_url in batch.itertuples(index=False):
                if bundle is None:
                    bundle, size = Bundle(target, stamp), 0
                number = None if page_id is None else int(page_id)
                data = record(number, url, html, stamp, None if refers_to is None else (int(refers_to), refers_url))
                bundle.add(number, data)
                size += len(data)
                if size >= BUNDLE_BYTES:
                    yield _index(bundle.close())
                    bundle = None
        if bundle is not None:
            yield _index(bundle.close())

    # ids go as text: numbers beside nulls would lose their last digits in a task
    packed = joined.select(F.col("page_id").cast("string").alias("page_id"), "url", "html", F.col("refers_to").cast("string").alias("refers_to"), "refers_url").mapInPandas(pack, INDEX)
    return materialize(packed, "warc-index")


def _index(rows: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame([r[1:] for r in rows], columns=[c.split()[0] for c in INDEX.split(", ")[1:]])
    made.insert(0, "page_id", pd.array([r[0] for r in rows], "Int64"))
    return made


def read(index: DataFrame) -> DataFrame:
    """Records of the index rows: each frame is read and decompressed once, in as many tasks as the records have READ_BYTES."""
    keys = ["bundle", "frame_start", "frame_bytes", "frame_plain"]
    frames = index.groupBy(*keys).agg(F.collect_list(F.struct("offset", "length")).alias("records"))  # bounded by a frame

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for uri, start, packed, plain, records in batch.itertuples(index=False):
                files, path = open_uri(uri)
                with files.open_input_file(path) as source:
                    data = unpacker.decompress(source.read_at(packed, start), max_output_size=plain)
                rows = [parse(data[r["offset"]:r["offset"] + r["length"]]) for r in records]
                yield pd.DataFrame({c.split()[0]: pd.Series([r[i] for r in rows], dtype=object) for i, c in enumerate(RECORD.split(", "))})

    total = index.agg(F.sum("length")).first()[0] or 0
    dealt = frames.repartition(max(1, math.ceil(total / READ_BYTES)), "bundle", "frame_start")
    return dealt.select(*keys, "records").mapInPandas(unpack, RECORD)


def archive_and_read(pages: DataFrame) -> DataFrame:
    """Archives all pages and returns what the archives say of each."""
    return read(write(pages)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
