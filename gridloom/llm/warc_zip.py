"""ZIP packages of web archives: written once, then read by ranges without extraction.

A package is a ZIP file with stored members: below ``archive/`` web archives, records each in a gzip member of
their own, and below ``indexes/`` lines of key, time and JSON that name a record's archive, offset and length (plain or in
gzip). The reader finds the central directory from the end of the file, through the ZIP64 records where there
are any, and the members' bytes from their local headers. As members are stored, a record
lies at a known range of the package, and one range read fetches it. The writer makes one archive and one index a package.

Files are reached through pyarrow's file systems, by URI, in the folder that all executors share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.storage import discard, materialize, scratch, ship

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
#: A package is closed when its data reaches this; a task writes as many as it needs.
PACKAGE_BYTES = 64 << 20
#: Records are grouped for range reads by position; a gap below this is read through.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20
#: Bytes of records that one task reads, about.
TASK_BYTES = 16 << 20
#: Payload digests that repeat, sent to every task at most; more are joined by a shuffle.
BROADCAST_DIGESTS = 200_000
#: Rows equal in id, url and payload that one row stands for until they are dealt out.
PIECE_ROWS = 1024

# fixed values: signatures and sizes of the ZIP format
_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07"
_MAX16, _MAX32 = 0xFFFF, 0xFFFFFFFF


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def file_system(uri: str):
    """(file system, path in it) of a URI or an absolute path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else f"file://{uri.removeprefix('file:')}")


# --- writing ---------------------------------------------------------------------------------


class _Stored:
    """A stored member written as it comes: sizes and checksum follow in a ZIP64 data descriptor."""

    def __init__(self, out, name: str) -> None:
        self.out, self.name, self.at, self.crc, self.size = out, name.encode(), out.tell(), 0, 0
        # version 4.5, sizes later, stored; a ZIP64 field makes the descriptor's sizes 8 bytes
        out.write(_LOCAL + struct.pack("<HHHHHIIIHH", 45, 8, 0, 0, 33, 0, _MAX32, _MAX32, len(self.name), 20) + self.name + struct.pack("<HHQQ", 1, 16, 0, 0))

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.crc, self.size = zlib.crc32(data, self.crc), self.size + len(data)

    def close(self) -> None:
        self.out.write(b"PK\x07\x08" + struct.pack("<IQQ", self.crc, self.size, self.size))

    def central(self, zip64: bool) -> bytes:
        big = zip64 or max(self.size, self.at) >= _MAX32
        size, at = (_MAX32, _MAX32) if big else (self.size, self.at)
        extra = struct.pack("<HHQQQ", 1, 24, self.size, self.size, self.at) if big else b""
        return _CENTRAL + struct.pack("<HHHHHHIIIHHHHHII", 45, 45, 8, 0, 0, 33, self.crc, size, size, len(self.name), len(extra), 0, 0, 0, 0, at) + self.name + extra


def _close_zip(out, members: list[_Stored], zip64: bool) -> None:
    at = out.tell()
    entries = b"".join(m.central(zip64) for m in members)
    out.write(entries)
    n = len(members)
    if zip64 or at >= _MAX32:
        end = out.tell()
        out.write(_END64 + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, len(entries), at))
        out.write(_LOCATOR64 + struct.pack("<IQI", 0, end, 1))
        out.write(_END + struct.pack("<HHHHIIH", 0, 0, _MAX16, _MAX16, _MAX32, _MAX32, 0))
    else:
        out.write(_END + struct.pack("<HHHHIIH", 0, 0, n, n, len(entries), at, 0))


def _header(value: object) -> str:
    return quote(str(value), safe="!#$%&'()*+,-./:;=?@[]_~")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _record(page_id, url, payload: bytes, digest: str, size: int, refers_to, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: {_header(url) if url is not None else 'urn:none'}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def _writer(folder: str, package_bytes: int, zip64: bool):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        out = data = None
        index: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal out
            data.close()
            listing = _Stored(out, INDEX)
            listing.write(b"".join(sorted(index)))
            listing.close()
            _close_zip(out, [data, listing], zip64)
            out.close()
            out = None
            return pa.RecordBatch.from_pydict({"package": [f"{folder}/{name}"], "records": [len(index)]})

        for batch in batches:
            for row in range(batch.num_rows):
                page, url, html, first, revisit = (c[row].as_py() for c in batch.columns)
                if out is None:
                    # a name of its own for every attempt: only those of the attempt that counts get listed
                    name, index = f"{uuid.uuid4().hex}.wacz", []
                    out = fs.open_output_stream(f"{root}/{name}")
                    data = _Stored(out, DATA)
                payload = html or b""
                digest = digest32(payload)
                at = data.size
                data.write(_record(page, url, payload, digest, len(payload), first, revisit))
                entry = {"digest": f"sha1:{digest}", "filename": DATA.partition("/")[2], "offset": str(at), "length": str(data.size - at)}
                index.append(f"{_header(url or 'urn:none')} 20200101000000 {json.dumps(entry)}\n".encode())
                if data.size >= package_bytes:
                    yield close()
        if out is not None:
            yield close()

    return write


def write_packages(pages: DataFrame, folder: str, least_revisit: int = 0, package_bytes: int = PACKAGE_BYTES, zip64: bool = False) -> DataFrame:
    """Writes ``pages`` (page_id, url, html string or binary) to packages in ``folder``; returns (package, records).

    Of pages with equal payloads of at least ``least_revisit`` bytes, that with the smallest page_id is a
    response record and the others are revisits of it, without payload; smaller ones are all responses. Null html is the
    empty payload; null ids come after all others. Of pages that share the smallest id one is the response, that of the
    least url; of rows equal in all three, any. Only digests are exchanged, and whole pages beyond BROADCAST_DIGESTS digests that
    repeat.
    """
    spark = ship(pages.sparkSession)
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("binary"), F.lit("").cast("binary")).alias("html"))
    key = F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.coalesce("url", F.lit("")).alias("url"))
    keyed = pages.withColumns({"_sha1": F.sha1("html"), "_key": key})
    found = keyed.where(F.octet_length("html") >= least_revisit).groupBy("_sha1", "_key").agg(F.count(F.lit(1)).alias("_n"))
    found = found.groupBy("_sha1").agg(F.sum("_n").alias("_all"), F.min(F.struct("_key", "_n")).alias("_f")).where("_all > 1")
    again = materialize(found.select("_sha1", F.col("_f._key").alias("_first"), F.col("_f._n").alias("_ties")), "digests")
    again_ = F.broadcast(again) if again.count() <= BROADCAST_DIGESTS else again
    joined = keyed.join(again_, "_sha1", "left")
    rows = joined.withColumn("revisit", F.coalesce(F.col("_key") != F.col("_first"), F.lit(False)))
    if not again.where("_ties > 1").isEmpty():
        # equal rows: one of them stands for all, in pieces that are dealt out
        tied = rows.where("_ties > 1 and not revisit").dropDuplicates(["_sha1"])
        tied = tied.withColumn("_lo", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_ties") - 1, F.lit(PIECE_ROWS).cast("long")))).repartition("_sha1", "_lo")
        tied = tied.withColumn("_i", F.explode(F.sequence("_lo", F.least(F.col("_lo") + PIECE_ROWS, F.col("_ties")) - 1)))
        rows = rows.where("_ties is null or _ties = 1 or revisit").unionByName(tied.withColumn("revisit", F.col("_i") > 0).drop("_lo", "_i"))
    # a revisit keeps size and digest; its payload is needed for the digest alone
    rows = rows.select("page_id", "url", "html", F.col("_first.id").cast("long").alias("_first"), "revisit")
    done = materialize(rows.mapInArrow(_writer(folder, package_bytes, zip64), "package string, records long"), "packages")
    discard(again)
    return done


# --- reading ---------------------------------------------------------------------------------


def read_directory(read, size: int) -> dict[str, tuple[int, int, int]]:
    """name -> (compression method, first byte of the data, bytes) of each member; read(at, n) -> bytes."""
    tail = read(max(0, size - 22 - _MAX16 - 20), min(size, 22 + _MAX16 + 20))
    at = tail.rfind(_END)
    # the signature may stand in a comment: that of the record is followed by a comment that ends the file
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack("<H", tail[at + 20 : at + 22])[0] != len(tail)):
        at = tail.rfind(_END, 0, at + 3)
    if at < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack("<HII", tail[at + 10 : at + 20])
    if _MAX16 == count or _MAX32 in (length, start):
        where = tail[at - 20 : at]
        if where[:4] != _LOCATOR64:
            raise ValueError("no ZIP64 locator")
        end = read(struct.unpack("<Q", where[8:16])[0], 56)
        if end[:4] != _END64:
            raise ValueError("no ZIP64 end record")
        count, length, start = struct.unpack("<QQQ", end[32:56])
    entries, at, found = read(start, length), 0, {}
    for _ in range(count):
        if entries[at : at + 4] != _CENTRAL:
            raise ValueError("bad central directory")
        method = struct.unpack("<H", entries[at + 10 : at + 12])[0]
        packed, plain = struct.unpack("<II", entries[at + 20 : at + 28])
        names, extras, notes = struct.unpack("<HHH", entries[at + 28 : at + 34])
        header = struct.unpack("<I", entries[at + 42 : at + 46])[0]
        name = entries[at + 46 : at + 46 + names].decode()
        extra, e = entries[at + 46 + names : at + 46 + names + extras], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack("<HH", extra[e : e + 4])
            if kind == 1:  # only the fields that overflow, in this order
                wide = iter(struct.unpack(f"<{n // 8}Q", extra[e + 4 : e + 4 + n // 8 * 8]))
                plain = next(wide) if plain == _MAX32 else plain
                packed = next(wide) if packed == _MAX32 else packed
                header = next(wide) if header == _MAX32 else header
            e += 4 + n
        local = read(header, 30)
        if local[:4] != _LOCAL:
            raise ValueError("bad local header")
        found[name] = (method, header + 30 + sum(struct.unpack("<HH", local[26:30])), packed)
        at += 46 + names + extras + notes
    return found


def _lines(f, at: int, left: int, packed: bool) -> Iterator[list[bytes]]:
    """Lines of a stored member, in parts; ``packed``: of gzip members."""
    rest, gz = b"", zlib.decompressobj(31)
    while left or rest:
        part = f.read_at(min(left, READ_BYTES), at) if left else b""
        at, left = at + len(part), left - len(part)
        if packed:
            plain = []
            while part:
                plain.append(gz.decompress(part))
                part = gz.unused_data
                if gz.eof:
                    gz = zlib.decompressobj(31)
            part = b"".join(plain)
        lines, _, rest = (rest + part).rpartition(b"\n")
        if not left:
            lines, rest = lines + b"\n" + rest, b""
        yield lines.split(b"\n")


def _list_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column(0).to_pylist():
            fs, path = file_system(uri)
            with fs.open_input_file(path) as f:
                members = read_directory(lambda at, n, f=f: f.read_at(n, at), f.size())
                used = {n: m for n, m in members.items() if n.startswith(("archive/", "indexes/")) and not n.endswith("/")}
                for name, (method, _, _) in used.items():
                    if method != 0:
                        raise ValueError(f"{name} in {uri} is not stored")
                for name, (_, at, left) in sorted(used.items()):
                    # fixed values: endings of plain and packed record indexes
                    if not name.startswith("indexes/") or not name.endswith((".cdx", ".cdxj", ".cdx.gz", ".cdxj.gz")):
                        continue
                    for lines in _lines(f, at, left, name.endswith(".gz")):
                        entries = [json.loads(x[x.index(b"{") :]) for x in lines if b"{" in x and not x.startswith(b"!")]
                        begin = [used["archive/" + e["filename"]][1] + int(e["offset"]) for e in entries]
                        yield pa.RecordBatch.from_pydict({"package": [uri] * len(entries), "at": pa.array(begin, pa.int64()), "length": pa.array([int(e["length"]) for e in entries], pa.int64())})


def list_records(packages: DataFrame) -> DataFrame:
    """(package, at, length) of every record of ``packages`` (package): ranges of the ZIP files, from their indexes."""
    ship(packages.sparkSession)
    return packages.select("package").mapInArrow(_list_records, "package string, at long, length long")


def _parse(record: bytes) -> dict:
    raw = gzip.decompress(record)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])

    def page(name: str) -> int | None:
        value = fields[name].removeprefix("<urn:page:").removesuffix(">")
        return int(value) if value else None

    kind = fields["WARC-Type"]
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or digest32(payload) != digest):
        raise ValueError(f"payload of page {page('WARC-Record-ID')} does not match its digest")
    return {"page_id": page("WARC-Record-ID"), "record_type": kind, "payload_bytes": size, "payload_digest": digest,
            "refers_to": page("WARC-Refers-To") if kind == "revisit" else None, "payload": payload if kind == "response" else None}


_RECORD = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read_ranges(with_payload: bool):
    names = _RECORD.names if with_payload else _RECORD.names[:-1]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, f = None, None
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            i = 0
            while i < len(rows):
                uri, begin, length = rows[i]
                end, j = begin + length, i + 1
                while j < len(rows) and rows[j][0] == uri and rows[j][1] - end <= GAP_BYTES and rows[j][1] + rows[j][2] - begin <= READ_BYTES:
                    end, j = max(end, rows[j][1] + rows[j][2]), j + 1
                if opened != uri:
                    fs, path = file_system(uri)
                    opened, f = uri, fs.open_input_file(path)
                raw = f.read_at(end - begin, begin)
                found = [_parse(raw[a - begin : a - begin + n]) for _, a, n in rows[i:j]]
                yield pa.RecordBatch.from_pydict({k: [x[k] for x in found] for k in names}, schema=pa.schema([_RECORD.field(k) for k in names]))
                i = j

    return read


def read_records(packages: DataFrame, payload: bool = True) -> DataFrame:
    """Every record of ``packages`` (package), read by its range: page_id, record_type, payload_bytes,
    payload_digest, refers_to and, if asked for, payload (null for revisits).

    Size and digest are those of the full payload; a response's are checked against its bytes.
    """
    schema = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long" + (", payload binary" if payload else "")
    listed = materialize(list_records(packages), "records")
    tasks = max(1, -(-(listed.agg(F.sum("length")).first()[0] or 0) // TASK_BYTES))
    # a number of its own, as the few bytes of the ranges say nothing of the records' sizes
    spread = listed.repartitionByRange(tasks, "package", "at")
    return spread.mapInArrow(_read_ranges(payload), schema)


def op3_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What packages of all pages, written with ZIP64 fields, say of each page when read back by ranges."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    packages = write_packages(pages, scratch(spark, "warc"), zip64=True)
    return read_records(packages, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
