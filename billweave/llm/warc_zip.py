"""WARC records in ZIP packages: written by Spark tasks, read back by ranges.

A package is a ZIP archive whose members are stored, not compressed: ``archive/data.warc``
(records, or each record gzipped on its own) and ``indexes/index.cdxj`` (one line a record
with its offset and length in the member). The reader takes the end of the file, finds the
central directory (ZIP64 too), looks up both members, and reads records by their ranges;
nothing is unpacked. Files are opened through a file-system handle that supports ``file:``,
``hdfs:`` and object stores.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from billweave.llm.tables import stored, work_folder

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
GZIP_LEVEL = 3

# Signatures and sizes of the ZIP format.
END, END64, LOCATOR64 = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
END_SIZE, LOCATOR64_SIZE, CENTRAL_SIZE, LOCAL_SIZE = 22, 20, 46, 30
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- ZIP directories ---------------------------------------------------------


class ZipRanges:
    """Members of a ZIP archive by ranges of a random-access file."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.members = self._directory()

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _directory(self) -> dict[str, tuple[int, int, int]]:
        """Name -> (method, size, offset of the local header)."""
        tail_size = min(self.size, END_SIZE + FULL16 + LOCATOR64_SIZE)
        tail = self._at(self.size - tail_size, tail_size)
        at = tail.rfind(END, 0, max(0, tail_size - END_SIZE + len(END)))
        while at >= 0 and at + END_SIZE + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(END, 0, at + len(END) - 1)
        if at < 0:
            raise ValueError("no end of a central directory")
        number, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if number == FULL16 or length == FULL32 or offset == FULL32:
            locator = at - LOCATOR64_SIZE
            if locator < 0 or tail[locator:locator + 4] != LOCATOR64:
                raise ValueError("no locator of the ZIP64 directory")
            (end64,) = struct.unpack_from("<Q", tail, locator + 8)
            record = self._at(end64, 56)
            if record[:4] != END64:
                raise ValueError("no end of the ZIP64 directory")
            number, length, offset = struct.unpack_from("<QQQ", record, 32)
        return dict(self._entries(self._at(offset, length), number))

    @staticmethod
    def _entries(directory: bytes, number: int) -> Iterator[tuple[str, tuple[int, int, int]]]:
        at = 0
        for _ in range(number):
            (_, _, _, _, method, _, _, _, packed, size, name_len, extra_len, comment_len, _, _, _, header,
             ) = struct.unpack_from("<4s6H3I5H2I", directory, at)
            name_at = at + CENTRAL_SIZE
            name = directory[name_at:name_at + name_len].decode("utf-8")
            extra = directory[name_at + name_len:name_at + name_len + extra_len]
            while len(extra) >= 4:
                kind, n = struct.unpack_from("<HH", extra)
                if kind == 1:
                    wide = list(struct.unpack_from(f"<{n // 8}Q", extra, 4))
                    size = wide.pop(0) if size == FULL32 else size
                    packed = wide.pop(0) if packed == FULL32 else packed
                    header = wide.pop(0) if header == FULL32 else header
                extra = extra[4 + n:]
            yield name, (method, packed, header)
            at = name_at + name_len + extra_len + comment_len

    def member(self, name: str) -> tuple[int, int]:
        """Offset and size of a stored member's bytes in the file."""
        method, size, header = self.members[name]
        if method:
            raise ValueError(f"{name} is compressed and can't be read by ranges")
        name_len, extra_len = struct.unpack_from("<HH", self._at(header, LOCAL_SIZE), 26)
        return header + LOCAL_SIZE + name_len + extra_len, size

    def read(self, name: str, offset: int = 0, length: int | None = None) -> bytes:
        begin, size = self.member(name)
        length = size - offset if length is None else min(length, size - offset)
        return self._at(begin + offset, length)


# ---- records -----------------------------------------------------------------


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: dict, digest: str) -> bytes:
    """One WARC record. A revisit carries the HTTP headers only; their Content-Length is that of the
    full payload, and WARC-Refers-To names the record that holds it."""
    payload = page["payload"]
    revisit = page["refers_to"] is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{page['page_id']}>", "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if page["url"]:
        # Line ends can't stand in a header; the index keeps the address as it is.
        head.append("WARC-Target-URI: " + " ".join(page["url"].splitlines()))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{page['refers_to']}>"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in lines.decode("utf-8").split("\r\n")[1:])
    return {name.lower(): value.strip() for name, _, value in pairs if name}


def parse(raw: bytes) -> dict:
    """What a record says of its page; a response's digest is computed from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    warc = headers(head)
    block = rest[:int(warc["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size, digest = int(headers(http)["content-length"]), warc["warc-payload-digest"].removeprefix("sha1:")
    if warc["warc-type"] == "response" and (len(payload) != size or sha1_base32(payload) != digest):
        raise ValueError(f"damaged payload of {warc['warc-record-id']}")
    return {
        "page_id": urn(warc["warc-record-id"]), "url": warc.get("warc-target-uri"), "payload_bytes": size,
        "payload_digest": digest, "record_type": warc["warc-type"], "refers_to": urn(warc.get("warc-refers-to")),
        "payload": payload if warc["warc-type"] == "response" else None}


def urn(value: str | None) -> int | None:
    number = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number not in ("", "None") else None


# ---- Spark steps -------------------------------------------------------------


class Package:
    """One ZIP archive being written; its records go through as they come."""

    def __init__(self, folder: str):
        self.path = f"{folder}/{uuid.uuid4().hex}.wacz"
        system, path = fs.FileSystem.from_uri(self.path) if "://" in folder else (fs.LocalFileSystem(), self.path)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.stream = system.open_output_stream(path)
        self.zip = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED, allowZip64=True)
        self.data = self.zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self.bytes, self.index = 0, []

    def add(self, page: dict) -> None:
        digest = sha1_base32(page["payload"])
        packed = gzip.compress(record(page, digest), GZIP_LEVEL, mtime=0)
        self.data.write(packed)
        self.index.append(json.dumps(
            {"page": page["page_id"], "url": page["url"], "offset": self.bytes, "length": len(packed)}))
        self.bytes += len(packed)

    def close(self) -> dict:
        self.data.close()
        self.zip.writestr(zipfile.ZipInfo(INDEX), "\n".join(self.index))
        self.zip.close()
        self.stream.close()
        return {"path": self.path, "records": len(self.index), "bytes": self.bytes}


def write_packages(pages: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Write rows of page_id, url, payload, refers_to into packages below ``folder``.

    Returns the stored manifest: path, records, bytes. Names are new for every attempt of a task and
    only those of finished tasks get into the manifest, so a lost executor leaves files that
    nobody reads.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        package, done = None, []
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                for page in batch.slice(start, 200).to_pylist():
                    package = package or Package(f"{folder}/packages")
                    package.add(page)
                    if package.bytes >= package_bytes:
                        done.append(package.close())
                        package = None
        if package:
            done.append(package.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema(
            [("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    rows = pages.select("page_id", "url", "payload", "refers_to")
    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), folder, "manifest")


def read_packages(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records of the packages at ``path``: page_id, url, payload_bytes, payload_digest, record_type,
    refers_to, and on demand payload (null for revisits).

    Index lines are read first; neighbouring records are fetched in ranges of about RANGE_BYTES.
    """
    schema = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
              "refers_to long" + ", payload binary" * with_payload)
    arrow = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ("record_type", pa.string()), ("refers_to", pa.int64()), *[("payload", pa.binary())] * with_payload])

    def records(path: str) -> Iterator[pa.RecordBatch]:
        system, local = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        with system.open_input_file(local) as file:
            package = ZipRanges(file)
            index = [json.loads(line) for line in package.read(INDEX).decode().split("\n") if line]
            begin = 0
            while begin < len(index):
                end, first = begin, index[begin]["offset"]
                while end < len(index) and index[end]["offset"] - first < RANGE_BYTES:
                    end += 1
                last = index[end - 1]
                held = package.read(DATA, first, last["offset"] + last["length"] - first)
                rows = []
                for entry in index[begin:end]:
                    at = entry["offset"] - first
                    row = parse(gzip.decompress(held[at:at + entry["length"]]))
                    rows.append(row | {"url": entry["url"]})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                yield from records(path)

    spread = manifest.select("path").repartition(max(1, min(manifest.count(), 100_000)), "path")
    return spread.mapInArrow(run, schema)


def with_revisits(
    df: DataFrame, min_bytes: int = 0, text: str = "html", url: str = "url",
) -> DataFrame:
    """page_id, url, payload and refers_to: the smallest page_id among rows with an equal payload of at
    least ``min_bytes`` bytes, or null for that row and for smaller payloads.

    Only digests that occur twice or more are joined, on digests computed from the rows; a group
    of copies of any size is one row on the other side, and skewed partitions can be split.
    """
    pages = df.select(F.col("page_id").cast("long").alias("page_id"), F.col(url).alias("url"),
                      F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("payload"))
    pages = pages.withColumn("digest", F.sha1("payload"))
    copies = (
        pages.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("least"), F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    joined = pages.join(copies.select("digest", "least"), "digest", "left")
    later = F.coalesce(F.col("page_id") > F.col("least"), F.col("page_id").isNull())
    return joined.select("page_id", "url", "payload", F.when(later, F.col("least")).alias("refers_to"))


def archive_round_trip(df: DataFrame, min_bytes: int = 0, with_payload: bool = False) -> DataFrame:
    """Write a record for every page (page_id, url, html) and read the packages back.

    See ``read_packages`` for the columns. A null html is an empty payload. Of rows with
    equal payloads the one with the smallest page_id is a response and the others revisit it;
    a repeated row of that very page_id is a response as well, and a null page_id counts as
    greater than any other. An empty table gives an empty one; further columns are ignored.
    """
    folder = work_folder(df.sparkSession, "packages")
    return read_packages(write_packages(with_revisits(df, min_bytes), folder), with_payload)
