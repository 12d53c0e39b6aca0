"""WARC records in ZIP packages: writer, and a reader that range-reads records without extraction.

A package holds stored members: ``archive/data.warc.gz`` (a gzip member per record) and ``indexes/index.cdxj`` (a line
per record with offset and length).  The reader parses the end of central directory, its ZIP64 locator and record where
there are any, and the central directory; it then knows where each stored member's bytes start, reads the index member
by range, and each record by range.  Packages and records are rows of DataFrames, so both are spread over tasks.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkfolio.llm.bpe import small
from sparkfolio.llm.common import scratch, staged

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: Signatures and fixed sizes of ZIP structures (fixed values of the format).
END, END64, LOCATOR, CENTRAL, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
FULL16, FULL32 = 0xFFFF, 0xFFFFFFFF
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header: int  # where its local header starts


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; plain and file: paths are local (or mounted)."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return (fs.LocalFileSystem(), path) if path.startswith("/") else fs.FileSystem.from_uri(path)


def members(file) -> list[Member]:
    """Central directory of a ZIP file that can be read at any position."""
    size = file.size()
    tail_at = max(0, size - 22 - FULL16)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(END)
    while at >= 0 and (at + 22 > len(tail) or tail_at + at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != size):
        at = tail.rfind(END, 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if FULL16 == count or FULL32 in (length, start):
        place = tail_at + at - 20
        locator = file.read_at(20, place) if place >= 0 else b""
        if locator[:4] == LOCATOR:
            where = struct.unpack_from("<Q", locator, 8)[0]
            record = file.read_at(56, where)
            if record[:4] != END64:
                raise ValueError("no ZIP64 end of central directory where its locator points")
            count, length, start = struct.unpack_from("<QQQ", record, 32)
    directory, found, at = file.read_at(length, start), [], 0
    for _ in range(count):
        if directory[at:at + 4] != CENTRAL:
            raise ValueError("broken central directory")
        method, packed, full, name_length, extra_length, comment, header = (
            struct.unpack_from("<H", directory, at + 10)[0], *struct.unpack_from("<II", directory, at + 20),
            *struct.unpack_from("<HHH", directory, at + 28), struct.unpack_from("<I", directory, at + 42)[0])
        name = directory[at + 46:at + 46 + name_length].decode("utf-8")
        extra = directory[at + 46 + name_length:at + 46 + name_length + extra_length]
        spot = 0
        while spot + 4 <= len(extra):  # of the ZIP64 field only the values that are full in the entry
            kind, field = struct.unpack_from("<HH", extra, spot)
            if kind == 1:
                read = spot + 4
                if full == FULL32:
                    full, read = struct.unpack_from("<Q", extra, read)[0], read + 8
                if packed == FULL32:
                    packed, read = struct.unpack_from("<Q", extra, read)[0], read + 8
                if header == FULL32:
                    header = struct.unpack_from("<Q", extra, read)[0]
            spot += 4 + field
        found.append(Member(name, method, packed, header))
        at += 46 + name_length + extra_length + comment
    return found


def start_of(file, member: Member) -> int:
    """Where the bytes of a stored member start; its local header has lengths of its own."""
    if member.method != 0:
        raise ValueError(f"{member.name} isn't stored")
    local = file.read_at(30, member.header)
    if local[:4] != LOCAL:
        raise ValueError(f"no local header of {member.name}")
    return member.header + 30 + sum(struct.unpack_from("<HH", local, 26))


def record(key: str, url: str | None, payload: bytes, size: int, digest: str, refers_to: str | None, is_revisit: bool, date: str) -> bytes:
    """One WARC record, a gzip member."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if is_revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if is_revisit else 'response'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~' + chr(39))}")
    head += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"X-Page-Id: {key}"]
    if is_revisit:
        head += [f"WARC-Profile: {PROFILE}", f"X-Refers-To-Page-Id: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a gzipped record."""
    head, _, rest = gzip.decompress(raw).partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    return headers, rest[:int(headers["Content-Length"])]


class _Out(io.RawIOBase):
    """A stream that can't seek, over an output stream of a file system."""

    def __init__(self, stream):
        self.stream = stream

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.stream.write(bytes(data))
        return len(data)


def roles(pages: DataFrame, key: str, html: str, least: int) -> DataFrame:
    """``pages`` (key, url, html) with digest, size, is_revisit and refers_to.

    Digests with at least a 500th of the rows, at most 500 of them, are broadcast; the rest is joined by digest, so a
    payload of a third of all pages isn't gathered.
    """
    x = pages.withColumn("digest", F.sha2(F.encode(F.coalesce(html, F.lit("")), "utf-8"), 256)).withColumn("size", F.octet_length(F.coalesce(html, F.lit(""))).cast("long"))
    each = x.filter(F.col("size") >= least).groupBy("digest", key).agg(F.count("*").alias("c"))
    first = staged(each.groupBy("digest").agg(
        F.min(F.struct(F.col(key).isNull().alias("null"), F.col(key).alias("key"), "c")).alias("f"), F.sum("c").alias("n")).filter("n > 1"), "payloads")
    total = first.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = first.filter(F.col("n") >= max(2.0, total / 500))
    rest = first.filter(F.col("n") < max(2.0, total / 500)).select(F.col("digest").alias("_d"), F.col("f").alias("_g"))
    x = x.join(F.broadcast(hot.select("digest", "f")), "digest", "left")
    spread = F.when(F.col("f").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.xxhash64(key).cast("string")))
    x = x.withColumn("_k", spread).join(rest, F.col("_k") == F.col("_d"), "left").withColumn("f", F.coalesce("f", "_g")).drop("_k", "_d", "_g")
    mine = F.col("f").isNotNull() & F.col("f.key").eqNullSafe(F.col(key))
    tied = mine & (F.col("f.c") > 1)  # rows that repeat the smallest page: the first of them is the response
    turn = F.row_number().over(Window.partitionBy("digest", key).orderBy("size"))
    x = x.filter(~tied).withColumn("is_revisit", F.col("f").isNotNull() & ~mine).unionByName(x.filter(tied).withColumn("is_revisit", turn > 1))
    return x.withColumn("refers_to", F.when(F.col("is_revisit"), F.col("f.key"))).drop("f")


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", least: int = 100,
          records: int = 50_000, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes a record per row and returns (path, records) of the packages, of the tasks that ended well only.

    Of rows with equal payloads of ``least`` bytes or more, one with the smallest key is the response and the others
    revisit it.  Null html is the empty payload, null keys come last and null URLs are left out; extra columns too.
    A package holds up to ``records`` records.
    """
    ready = roles(pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(html).alias("html")), "key", "html", least)
    ready = ready.select(F.col("key").cast("string"), "url", "html", "size", "digest", "is_revisit", F.col("refers_to").cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        package, index, at, path, paths, counts = None, [], 0, "", [], []

        def close() -> None:
            data.close()
            with package.open(zipfile.ZipInfo(INDEX), "w") as member:
                member.write("".join(index).encode())
            package.close()
            stream.close()
            paths.append(path)
            counts.append(len(index))

        for batch in small(batches, 64):
            for k, u, h, size, digest, is_revisit, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if package is None:
                    name = f"{uuid.uuid4().hex}.wacz"
                    path = f"{folder}/{name}"
                    stream = system.open_output_stream(f"{base}/{name}")
                    package = zipfile.ZipFile(_Out(stream), "w", zipfile.ZIP_STORED, allowZip64=True)
                    data, index, at = package.open(zipfile.ZipInfo(DATA), "w", force_zip64=True), [], 0
                raw = record("" if k is None else k, u, (h or "").encode(), size, digest, refers or "", is_revisit, date)
                data.write(raw)
                index.append(f"{k} {json.dumps({'offset': at, 'length': len(raw)})}\n")
                at += len(raw)
                if len(index) >= records:
                    close()
                    package = None
        if package is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64())], names=["path", "records"])

    return staged(ready.mapInArrow(run, "path string, records long"), "packages")


def locate(packages: DataFrame) -> DataFrame:
    """(path, at, length) of every record of the packages, from their directories and index members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, name = opened(path)
                with system.open_input_file(name) as file:
                    named = {m.name: m for m in members(file)}
                    start, index = start_of(file, named[DATA]), named[INDEX]
                    lines = file.read_at(index.size, start_of(file, index)).decode().splitlines()
                entries = [json.loads(line.split(" ", 1)[1]) for line in lines]
                for a in range(0, len(entries), 10_000):
                    part = entries[a:a + 10_000]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([path] * len(part)), pa.array([start + e["offset"] for e in part], pa.int64()),
                         pa.array([e["length"] for e in part], pa.int64())], names=["path", "at", "length"])

    return packages.select("path").repartition(F.col("path")).mapInArrow(run, "path string, at long, length long")


def read(packages: DataFrame, kind: str = "long", block: int = 16_000_000) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload) of every record, by range reads.

    Records are dealt to tasks in ranges of packages, as many as the records hold ``block`` bytes: what is shuffled are
    places, so the number of tasks is stated by the bytes behind them.  A response whose payload doesn't have the
    digest that it states fails the job.  ``payload`` of a revisit is null.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_path, file = None, None
        for batch in small(batches, 128):
            rows = []
            for path, at, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if path != open_path:
                    if file is not None:
                        file.close()
                    system, name = opened(path)
                    open_path, file = path, system.open_input_file(name)
                head, body = parsed(file.read_at(length, at))
                digest, payload = head["WARC-Payload-Digest"].removeprefix("sha256:"), None
                if head["WARC-Type"] == "response":
                    payload = body.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"]):
                        raise ValueError(f"a payload of {path} differs from its digest")
                rows.append((head["X-Page-Id"] or None, int(head["X-Payload-Length"]), digest, head["WARC-Type"], head.get("X-Refers-To-Page-Id") or None,
                             head.get("WARC-Target-URI"), payload))
            kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        if file is not None:
            file.close()

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]
    found = staged(locate(packages), "records")
    tasks = -(-(found.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]) // block)
    dealt = found.repartitionByRange(max(1, tasks), "path", "at").sortWithinPartitions("path", "at")
    got = dealt.mapInArrow(run, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string, url string, payload binary")
    return got.withColumn("page_id", F.col("page_id").cast(kind)).withColumn("refers_to", F.col("refers_to").cast(kind))


def archive(pages: DataFrame, **options) -> DataFrame:
    """Packages of ``pages`` in a new folder beneath the shared folder."""
    return write(pages, scratch(pages.sparkSession, "warc"), **options)
