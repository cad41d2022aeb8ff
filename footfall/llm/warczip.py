"""WARC records in ZIP packages, read by ranges.

A package is a ZIP file with two stored members: a WARC file whose records are gzip members
of their own, and an index of where each record lies. Tasks write packages to the shared
folder under names of their own and report them; only reported packages count, so a lost or
repeated task leaves nothing that is read. The reader never extracts: it takes the end of the
file, follows the directory (ZIP64 or not) to the members, reads the index, and deals ranges
of neighbouring records out to tasks, which read just those bytes.

Files are opened through pyarrow, which reaches local, HDFS, S3 and similar folders by URI.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from footfall.llm.registry import query, table
from footfall.session import shared_dir, stored

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
PACKAGE_BYTES = 64 << 20
RANGE_BYTES = 4 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_LOCAL, _CENTRAL, _END, _END64, _AT64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MAX32, _MAX16 = 0xFFFFFFFF, 0xFFFF


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# Records


def _header(value: str) -> str:
    """A value on one line: control characters are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _number(name: str | None) -> int | None:
    digits = (name or "")[len("<urn:page:"):-1]
    return int(digits) if digits else None


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: tuple | None) -> bytes:
    """A WARC/1.1 record: a response with its payload, or (refers_to: the id of the response, in a
    tuple) a revisit that keeps the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to else http + payload
    fields = {
        "WARC-Type": "revisit" if refers_to else "response", "WARC-Record-ID": _name(page_id), "WARC-Date": DATE,
        "WARC-Target-URI": None if url is None else _header(url),
        "WARC-Payload-Digest": f"sha1:{sha1_base32(payload)}",
        "WARC-Profile": PROFILE if refers_to else None, "WARC-Refers-To": _name(refers_to[0]) if refers_to else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None) + "\r\n"
    return head.encode("utf-8", "replace") + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields and payload of one record. `payload` is None for a revisit, whose payload length is
    that of its HTTP header. Raises ValueError on anything else."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(field["Content-Length"])]
    if len(block) < int(field["Content-Length"]) or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("a WARC record is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    said = re.search(rb"(?mi)^Content-Length: (\d+)", http)
    revisit = field["WARC-Type"] == "revisit"
    return {
        "page_id": _number(field["WARC-Record-ID"]), "url": field.get("WARC-Target-URI"), "record_type": field["WARC-Type"],
        "payload_digest": field["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": _number(field.get("WARC-Refers-To")),
        "payload": None if revisit else payload, "payload_bytes": int(said[1]) if revisit else len(payload),
    }


def _gzip(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


# ZIP packages


class StoredZip:
    """Writes stored members one after the other to a stream. Their lengths follow the data, so a
    member may be of any length; with `zip64` every size is in ZIP64 form."""

    def __init__(self, stream, zip64: bool = False):
        self.stream, self.zip64, self.at = stream, zip64, 0
        self.members: list[tuple] = []

    def _write(self, data: bytes) -> None:
        self.stream.write(data)
        self.at += len(data)

    def begin(self, name: str) -> None:
        raw = name.encode()
        # Bit 3: length and checksum follow the data; bit 11: the name is UTF-8.
        self.member = [raw, self.at, 0, 0]
        self._write(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 0x808, 0, 0, 0x21, 0, 0, 0, len(raw), 0) + raw)

    def write(self, data: bytes) -> int:
        """Adds to the open member; returns where in the member the data begin."""
        at = self.member[3]
        self.member[2], self.member[3] = zlib.crc32(data, self.member[2]), at + len(data)
        self._write(data)
        return at

    def end(self) -> None:
        _, _, crc, size = self.member
        wide = self.zip64 or size >= _MAX32
        self._write(b"PK\x07\x08" + struct.pack("<IQQ" if wide else "<III", crc, size, size))
        self.members.append(tuple(self.member))

    def close(self) -> None:
        start = self.at
        for raw, at, crc, size in self.members:
            wide = self.zip64 or size >= _MAX32 or at >= _MAX32
            extra = struct.pack("<HHQQQ", 1, 24, size, size, at) if wide else b""
            shown = (_MAX32, _MAX32) if wide else (size, size)
            self._write(_CENTRAL + struct.pack(
                "<HHHHHHIIIHHHHHII", 45, 45, 0x808, 0, 0, 0x21, crc, *shown, len(raw), len(extra), 0, 0, 0, 0,
                _MAX32 if wide else at) + raw + extra)
        size, n = self.at - start, len(self.members)
        if self.zip64 or start >= _MAX32 or size >= _MAX32 or n >= _MAX16:
            where = self.at
            self._write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, start))
            self._write(_AT64 + struct.pack("<IQI", 0, where, 1))
            n, size, start = _MAX16, _MAX32, _MAX32
        self._write(_END + struct.pack("<HHHHIIH", 0, 0, n, n, size, start, 0))


def members(read: Callable[[int, int], bytes], size: int) -> dict[str, tuple[int, int]]:
    """(start, length) of the data of every stored member, by name. `read(offset, length)` reads
    from a ZIP file of `size` bytes; only the end, the directory and local headers are read.
    Compressed or encrypted members are left out, as they cannot be read by range."""
    tail_at = max(0, size - (_MAX16 + 22))
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("not a ZIP file")
    n, length, start = struct.unpack("<HII", tail[end + 10:end + 20])
    if n == _MAX16 or length == _MAX32 or start == _MAX32:
        locator = read(tail_at + end - 20, 20) if tail_at + end >= 20 else b""
        if locator[:4] == _AT64:
            at = struct.unpack("<Q", locator[8:16])[0]
            record = read(at, 56)
            if record[:4] != _END64:
                raise ValueError("the ZIP64 end record is missing")
            n, length, start = struct.unpack("<QQQ", record[32:56])
    directory = read(start, length)
    found, at = {}, 0
    for _ in range(n):
        if directory[at:at + 4] != _CENTRAL:
            raise ValueError("the ZIP directory is cut short")
        flags, method = struct.unpack("<HH", directory[at + 8:at + 12])
        packed, plain, n_name, n_extra, n_note = struct.unpack("<IIHHH", directory[at + 20:at + 34])
        where = struct.unpack("<I", directory[at + 42:at + 46])[0]
        name = directory[at + 46:at + 46 + n_name].decode("utf-8", "replace")
        extra = directory[at + 46 + n_name:at + 46 + n_name + n_extra]
        while len(extra) >= 4:
            tag, n_tag = struct.unpack("<HH", extra[:4])
            if tag == 1:
                wide = iter(struct.unpack(f"<{n_tag // 8}Q", extra[4:4 + n_tag // 8 * 8]))
                plain = next(wide) if plain == _MAX32 else plain
                packed = next(wide) if packed == _MAX32 else packed
                where = next(wide) if where == _MAX32 else where
            extra = extra[4 + n_tag:]
        if method == 0 and not flags & 1:
            local = read(where, 30)
            if local[:4] != _LOCAL:
                raise ValueError("a ZIP member is missing")
            found[name] = (where + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        at += 46 + n_name + n_extra + n_note
    return found


# Spark jobs


def mark_revisits(pages: DataFrame, payload: Column, least_bytes: int = 0) -> DataFrame:
    """`pages` with `_payload` (bytes, null as empty) and `_first`: the response's page_id in a
    struct if the row is a revisit, else null. Equal payloads of at least `least_bytes` have one
    response, the largest page_id (all rows with that id, if they repeat). A null page_id is below
    all others. Copies are found by SHA-1: only digests with more than one record are joined
    back, and Spark splits a hot one."""
    rows = pages.withColumn("_payload", F.coalesce(payload.cast("binary"), F.lit(b""))).withColumn("_sha", F.sha1("_payload"))
    groups = rows.where(F.octet_length("_payload") >= least_bytes).groupBy("_sha").agg(
        F.max("page_id").alias("_last"), F.count("*").alias("_n")).where("_n > 1")
    groups = stored(groups, "copies").select(F.col("_sha").alias("_key"), "_last")
    joined = rows.join(groups.hint("merge"), F.col("_sha") == F.col("_key"), "left")
    other = F.col("_key").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_last"))
    return joined.withColumn("_first", F.when(other, F.struct(F.col("_last").alias("page_id")))).drop("_sha", "_key", "_last")


def write_packages(records: DataFrame, folder: str, zip64: bool = False, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes `records` (page_id, url, _payload, _first) as packages of about `package_bytes` and
    returns their list (path, bytes, records), stored. No rows, no packages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, root = open_folder(folder)
        where.create_dir(root, recursive=True)
        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        package, index, name = None, [], ""

        def close() -> pa.RecordBatch:
            nonlocal package
            package.end()
            package.begin(INDEX)
            package.write("".join(index).encode())
            package.end()
            package.close()
            package.stream.close()
            row = {"path": f"{folder}/{name}", "bytes": package.at, "records": len(index)}
            package = None
            return pa.RecordBatch.from_pylist([row], schema)

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, payload, first = (c[i].as_py() for c in batch.columns)
                if package is None:
                    name, index = f"{uuid.uuid4().hex}.wacz", []
                    package = StoredZip(where.open_output_stream(f"{root}/{name}"), zip64)
                    package.begin(DATA)
                raw = _gzip(make_record(page_id, url, payload, (first["page_id"],) if first else None))
                at = package.write(raw)
                index.append(f"{_header(url or '-').replace(' ', '%20')} {DATE} {json.dumps({'offset': at, 'length': len(raw)})}\n")
                if package.at >= package_bytes:
                    yield close()
        if package is not None:
            yield close()

    rows = records.select("page_id", "url", "_payload", "_first")
    return stored(rows.mapInArrow(run, "path string, bytes long, records long"), "packages")


def ranges(packages: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, start, length, sizes): runs of neighbouring records of about `range_bytes`, from the
    directory and index of each package; sizes are the records' lengths, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("sizes", pa.list_(pa.int64()))])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                where, name = open_folder(path)
                with where.open_input_file(name) as f:
                    at = members(lambda offset, n: f.read_at(n, offset), f.size())
                    data, _ = at[DATA]
                    text = f.read_at(at[INDEX][1], at[INDEX][0]).decode()
                spots = sorted((x["offset"], x["length"]) for x in (json.loads(r.split(" ", 2)[2]) for r in text.splitlines()))
                row = None
                for offset, n in spots:
                    if row and (row["start"] + row["length"] != data + offset or row["length"] >= range_bytes):
                        yield pa.RecordBatch.from_pylist([row], schema)
                        row = None
                    row = row or {"path": path, "start": data + offset, "length": 0, "sizes": []}
                    row["length"] += n
                    row["sizes"].append(n)
                if row:
                    yield pa.RecordBatch.from_pylist([row], schema)

    return packages.select("path").mapInArrow(run, "path string, start long, length long, sizes array<long>")


def read_packages(packages: DataFrame, range_bytes: int = RANGE_BYTES, with_payload: bool = True) -> DataFrame:
    """(page_id, url, record_type, payload_digest, refers_to, payload_bytes, payload) of every record
    of `packages` (path). Ranges are dealt out evenly, so one large package is read by many tasks.
    Damaged packages raise."""
    found = ranges(packages, range_bytes)
    dealt = found.repartition(F.col("path"), F.col("start"))
    schema = pa.schema([
        ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_digest", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                where, name = open_folder(r["path"])
                with where.open_input_file(name) as f:
                    data = f.read_at(r["length"], r["start"])
                rows, at = [], 0
                for n in r["sizes"]:
                    row = parse_record(zlib.decompress(data[at:at + n], 31))
                    rows.append(row if with_payload else row | {"payload": None})
                    at += n
                yield pa.RecordBatch.from_pylist(rows, schema)

    return dealt.mapInArrow(
        run, "page_id long, url string, record_type string, payload_digest string, refers_to long, payload_bytes long, payload binary")


WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
s AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY hex) AS last_id FROM s)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 +
    ((('0x' || substr(hex, (5 * (i // 4) + 1)::INT, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31)::INT, 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM last_id THEN last_id END AS refers_to
FROM g"""


@query("op9_warc_zip", WARC_SQL)
def op9_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to packages and read back by range."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    packages = write_packages(mark_revisits(pages, F.col("html")), f"{shared_dir(spark)}/packages-{uuid.uuid4().hex}")
    return read_packages(packages, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
