"""Web archives (WARC) as a Spark data source, for reading and writing.

Reading: a partition is some whole files, up to ``partitionBytes`` together; a file is not split, as a nested archive in a
payload holds record starts of its own. Predicates on the record type and on other headers are pushed down to the reader:
from the query's own filters with the option ``pushdown``, or by the option ``where``. (Spark 4.1 keeps pushed filters with
the loaded table, so a DataFrame read with ``pushdown`` is to be used once; without it filters run after the scan.) The
reader parses a record's headers first, and the payload of a record that the predicates reject, or all payloads with the
option ``payload`` set to false, is not decoded: a plain record is jumped over by its length, a compressed one by the
member size in its gzip header (subfield ``sl``) where the writer left one, else it is inflated past. Files come through
pyarrow's file systems, so paths may name a store.

Writing: each record is a gzip member of its own. Tasks write under temporary names and the driver moves the files of
the tasks that succeeded, so retried and lost tasks leave nothing in the archive. A file is closed at ``fileBytes``.

Null payloads are empty, null headers are left out, and line ends inside headers are percent-encoded. Very long payloads
are held whole, one at a time. Of pages with equal payloads the one with the largest id is stored; equal rows give a record
each, all of them stored if theirs is that id. Columns besides page_id, url and html are not read, whatever their names. An
archive without files or records reads as an empty table. Damaged files fail with the file's name.
"""

from __future__ import annotations

import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from sparkloom.llm.arrow import bounded, pieces
from sparkloom.storage import drop_at_exit, fitted, fresh_path, materialize, scratch

SCHEMA = "record_type string, record_id string, target_uri string, warc_date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
#: Columns that are headers, all known before a payload is decoded.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "warc_date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BATCH_BYTES, READ_BYTES = 8 << 20, 1 << 16
#: Payloads shorter than this are stored even if repeated.
REVISIT_LEAST = 1000
BROADCAST_BYTES = 32 << 20


def _files(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"[a-z0-9]+://", path) else path.removeprefix("file:"))


class _Bytes:
    """Buffered bytes of a file, with jumps ahead."""

    def __init__(self, file):
        self.file, self.held, self.at, self.start = file, b"", 0, 0

    def tell(self) -> int:
        return self.start + self.at

    def some(self) -> bytes:
        """What is held, or the next bytes of the file."""
        if self.at == len(self.held):
            self.start += len(self.held)
            self.held, self.at = self.file.read(READ_BYTES), 0
        out, self.at = self.held[self.at :], len(self.held)
        return out

    def back(self, n: int) -> None:
        self.at -= n

    def exactly(self, n: int) -> bytes:
        out = []
        while n:
            if not (part := self.some()):
                raise EOFError
            if len(part) > n:
                self.back(len(part) - n)
                part = part[:n]
            out.append(part)
            n -= len(part)
        return b"".join(out)

    def jump(self, place: int) -> None:
        if self.start <= place <= self.start + len(self.held):
            self.at = place - self.start
        else:
            self.file.seek(place)
            self.held, self.at, self.start = b"", 0, place


class _Member:
    """The inflated bytes of one gzip member."""

    def __init__(self, source: _Bytes):
        self.source, self.begin = source, source.tell()
        head = source.exactly(10)
        if head[:3] != b"\x1f\x8b\x08":
            raise ValueError("no gzip member")
        self.end: int | None = None
        flags = head[3]
        if flags & 4:
            extra = source.exactly(struct.unpack("<H", source.exactly(2))[0])
            while len(extra) >= 4:
                name, size = extra[:2], struct.unpack_from("<H", extra, 2)[0]
                if name == b"sl" and size == 8:
                    self.end = self.begin + struct.unpack_from("<I", extra, 4)[0]
                extra = extra[4 + size :]
        for flag in (8, 16):
            if flags & flag:
                while source.exactly(1) != b"\0":
                    pass
        if flags & 2:
            source.exactly(2)
        self.inflater, self.held = zlib.decompressobj(-15), bytearray()

    def more(self) -> bool:
        if self.inflater.eof or not (data := self.source.some()):
            return False
        self.held += self.inflater.decompress(data)
        self.source.back(len(self.inflater.unused_data))
        return True

    def close(self) -> None:
        """Goes to the member's end, by a jump if its size is known."""
        if self.end is not None:
            self.source.jump(self.end)
            return
        while not self.inflater.eof:
            self.held.clear()
            if not self.more():
                raise EOFError
        self.source.exactly(8)


class _Plain:
    """The bytes of an uncompressed record."""

    def __init__(self, source: _Bytes):
        self.source, self.held, self.begin, self.size = source, bytearray(), source.tell(), 0

    def more(self) -> bool:
        data = self.source.some()
        self.held += data
        return bool(data)

    def close(self) -> None:
        self.source.jump(self.begin + self.size)


@dataclass
class Reading:
    """What to read: tests on headers (all must hold), and whether payloads are wanted."""

    tests: list = field(default_factory=list)
    payload: bool = True


def _until(record, mark: bytes) -> int:
    at = 0
    while (found := record.held.find(mark, max(0, at - len(mark)))) < 0:
        at = len(record.held)
        if not record.more():
            raise EOFError
    return found + len(mark)


def _parse(block: bytes) -> dict[str, str]:
    """Headers by lower-case name; lines that begin with a blank go on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in block.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records(file, reading: Reading) -> Iterator[tuple]:
    """The file's records that pass the tests, as values of SCHEMA."""
    source = _Bytes(file)
    while data := source.some():
        if data[:2] in (b"\r\n", b"\n"):
            source.back(len(data) - data.index(b"\n") - 1)
            continue
        source.back(len(data))
        packed = data[0] == 0x1F
        record = _Member(source) if packed else _Plain(source)
        size = _until(record, b"\r\n\r\n")
        head = _parse(record.held[: size - 4])
        length = int(head.get("content-length", 0))
        if not packed:
            record.size = size + length + 4
        row = {c: head.get(h) for c, h in HEADERS.items()}
        for c in ("record_id", "refers_to"):
            row[c] = row[c] and row[c].strip("<>")
        if all(test(row) for test in reading.tests):
            n, payload, begin = length, None, size
            if head.get("content-type", "").startswith("application/http"):
                begin = _until_http(record, size, length)
                fields = _parse(record.held[size:begin])
                n = int(fields.get("content-length", length - (begin - size)))
            if reading.payload and row["record_type"] != "revisit":
                while len(record.held) < size + length:
                    if not record.more():
                        raise EOFError
                payload = bytes(memoryview(record.held)[begin : size + length])
            yield (*row.values(), n, payload)
        record.close()


def _until_http(record, size: int, length: int) -> int:
    """Where the payload begins in a block that opens with HTTP headers."""
    while True:
        found = record.held.find(b"\r\n\r\n", size)
        if 0 <= found < size + length:
            return found + 4
        if len(record.held) >= size + length or not record.more():
            return size + length


def _test(f: Filter):
    """The filter as a test of a row of headers; None if it is on something else."""
    if isinstance(f, Not):
        inner = _test(f.child)
        own = getattr(f.child, "attribute", None)
        return inner and (lambda row: row[own[0]] is not None and not inner(row))
    attribute = getattr(f, "attribute", None)
    if not attribute or len(attribute) != 1 or attribute[0] not in HEADERS:
        return None
    c, v = attribute[0], getattr(f, "value", None)
    if isinstance(f, EqualNullSafe | EqualTo):
        return lambda row: row[c] == v and (v is not None or isinstance(f, EqualNullSafe))
    if isinstance(f, In):
        return lambda row: row[c] is not None and row[c] in v
    if isinstance(f, IsNull):
        return lambda row: row[c] is None
    if isinstance(f, IsNotNull):
        return lambda row: row[c] is not None
    for kind, method in ((StringStartsWith, str.startswith), (StringEndsWith, str.endswith), (StringContains, str.__contains__)):
        if isinstance(f, kind):
            return lambda row: row[c] is not None and method(row[c], v)
    return None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(None)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, path: str, options: dict[str, str]):
        self.path = path
        self.most = int(options.get("partitionbytes", 64 << 20))
        self.payload = options.get("payload", "true").lower() != "false"
        #: Values that a header must have, by column.
        self.where: dict[str, list[str]] = json.loads(options.get("where", "{}"))
        if unknown := set(self.where) - set(HEADERS):
            raise ValueError(f"no headers: {sorted(unknown)}")
        self.filters: list[Filter] = []

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        system, top = _files(self.path)
        found = system.get_file_info(fs.FileSelector(top, recursive=True)) if system.get_file_info(top).type == fs.FileType.Directory else [system.get_file_info(top)]
        out, held = [], 0
        for f in sorted((f for f in found if f.type == fs.FileType.File and re.search(r"\.warc(\.gz)?$", f.path) and "/_" not in f.path.removeprefix(top)), key=lambda f: f.path):
            if not out or held + f.size > self.most:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(f.path)
            held += f.size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _files(self.path)
        chosen = [lambda row, c=c, values=frozenset(v): row[c] in values for c, v in self.where.items()]
        reading = Reading([*chosen, *(_test(f) for f in self.filters)], self.payload)
        names = [*HEADERS, "payload_bytes", "payload"]
        kinds = [*[pa.string()] * len(HEADERS), pa.int64(), pa.binary()]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        rows: list[tuple] = []
        held = 0
        for path in partition.paths:
            with system.open_input_file(path) as file:
                try:
                    for row in records(file, reading):
                        rows.append(row)
                        held += len(row[-1] or b"") + 200
                        if held > BATCH_BYTES:
                            yield batch(rows)
                            rows, held = [], 0
                except (EOFError, ValueError, zlib.error) as e:
                    raise ValueError(f"damaged archive {path}") from e
        if rows:
            yield batch(rows)


class PushedWarcReader(WarcReader):
    """Also takes filters on headers from the query."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if _test(f) is None:
                yield f
            else:
                self.filters.append(f)


def member(data: bytes, level: int = 4) -> bytes:
    """One gzip member whose header says how long it is."""
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(data) + deflate.flush()
    size = 10 + 2 + 12 + len(body) + 8
    tail = body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)
    if max(size, len(data)) >= 1 << 32:
        return b"\x1f\x8b\x08\0\0\0\0\0\0\xff" + tail
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + tail


def _safe(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict) -> bytes:
    """A record's bytes. A revisit's block is the HTTP headers alone, which keep the payload's length."""
    payload, revisit = row.get("payload") or b"", row.get("record_type") == "revisit"
    size = row.get("payload_bytes")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload) if size is None else size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [("WARC-Type", row.get("record_type") or "response"), ("WARC-Date", row.get("warc_date")), ("WARC-Target-URI", row.get("target_uri")), ("WARC-Payload-Digest", row.get("payload_digest"))]
    head += [(n, f"<{_safe(v)}>" if v else None) for n, v in (("WARC-Record-ID", row.get("record_id")), ("WARC-Refers-To", row.get("refers_to")))]
    head += [("WARC-Profile", PROFILE if revisit else None), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "".join(f"{n}: {v if n.startswith(('WARC-Re', 'WARC-Pr', 'Content')) else _safe(v)}\r\n" for n, v in head if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, options: dict[str, str]):
        self.path, self.most = path, int(options.get("filebytes", 256 << 20))
        self.job = f"_{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, top = _files(self.path)
        system.create_dir(f"{top}/{self.job}", recursive=True)
        names, out, held = [], None, 0
        try:
            for batch in pieces(iterator, 64):
                columns = [c.to_pylist() for c in batch.columns]
                for values in zip(*columns, strict=True):
                    if out is None:
                        names.append(f"{uuid.uuid4().hex}.warc.gz")
                        out, held = system.open_output_stream(f"{top}/{self.job}/{names[-1]}", compression=None), 0
                    data = member(record(dict(zip(batch.schema.names, values, strict=True))))
                    out.write(data)
                    held += len(data)
                    if held >= self.most:
                        out.close()
                        out = None
        finally:
            if out is not None:
                out.close()
        return Written(names)

    def commit(self, messages: list[Written | None]) -> None:
        system, top = _files(self.path)
        for name in (n for m in messages if m for n in m.names):
            system.move(f"{top}/{self.job}/{name}", f"{top}/{name}")
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        system, top = _files(self.path)
        if system.get_file_info(f"{top}/{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{top}/{self.job}")


class WarcDataSource(DataSource):
    """format("warc"): options path, payload, partitionBytes (reading), fileBytes (writing)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        options = {k.lower(): v for k, v in self.options.items()}
        return (PushedWarcReader if options.get("pushdown") == "true" else WarcReader)(self.options["path"], options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options["path"], {k.lower(): v for k, v in self.options.items()})


def register(spark: SparkSession) -> None:
    """Makes the format known to the session, and lets the session push filters down to Python data sources: without that
    Spark refuses those that can take them."""
    spark.dataSource.register(WarcDataSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, payload: bool = True, pushdown: bool = False, **where: str | list[str]) -> DataFrame:
    """An archive's records, those whose headers have the given values (record_type="response", for one). pushdown: take
    the query's filters too, for a DataFrame that is used once."""
    register(spark)
    wanted = {c: [v] if isinstance(v, str) else list(v) for c, v in where.items()}
    options = {"payload": str(payload).lower(), "pushdown": str(pushdown).lower(), "where": json.dumps(wanted)}
    return spark.read.format("warc").options(**options).load(path)


def archive(pages: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each page (page_id, url, html). Of pages with equal payloads of REVISIT_LEAST bytes or more,
    the one with the largest id is stored and the others revisit it; a page without an id is never the one stored."""
    spark = pages.sparkSession
    register(spark)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = bounded(pages).select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload")).withColumn("n", F.octet_length("payload").cast("long"))
    shared = rows.filter(F.col("n") >= REVISIT_LEAST).groupBy("digest").agg(F.max("page_id").alias("stored"), F.count("*").alias("c")).filter("c > 1 and stored is not null").drop("c")
    shared = materialize(shared, "warc-shared")
    joined = rows.join(fitted(shared, BROADCAST_BYTES), "digest", "left")
    revisit = F.col("stored").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("stored"))
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    out = joined.select(
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        name("page_id").alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(date).alias("warc_date"),
        F.when(revisit, name("stored")).alias("refers_to"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("n").alias("payload_bytes"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").mode("append").save(path)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Archives the pages, reads the archives back, and gives page_id, payload_bytes, payload_digest, record_type,
    refers_to: of responses from the payload that was read, of revisits from their headers."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    with scratch(spark):
        archive(pages, path)
    drop_at_exit(spark, path)
    number = lambda c: F.substring_index(c, ":", -1).cast("long")
    # each branch loads the archive for itself, so that the filter pushed down to it is its own
    full = read(spark, path, pushdown=True).filter("record_type = 'response'")
    full = full.select(number("record_id").alias("page_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    light = read(spark, path, payload=False, pushdown=True).filter("record_type = 'revisit'")
    light = light.select(number("record_id").alias("page_id"), "payload_bytes", F.substring_index("payload_digest", ":", -1).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
    return full.unionByName(light)


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
s AS (SELECT payload_digest AS d, max(page_id) AS stored FROM p WHERE payload_bytes >= 1000 GROUP BY 1 HAVING count(*) > 1)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN stored IS NOT NULL AND page_id <> stored THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> stored THEN stored END::BIGINT AS refers_to
FROM p LEFT JOIN s ON d = payload_digest
"""
