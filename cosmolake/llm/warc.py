"""WARC archives: writing monolithic gzip files, normalising them, reading by index.

``write`` packs rows into archives that are one gzip stream each, the form in
which many crawls arrive. ``normalise`` inflates such a stream once, in
bounded pieces, rewrites every record as a gzip member of its own and writes
a sidecar index (one JSON line a record: offset, length, id, type).
``read`` seeks by that index and yields the records.

Files go to the cluster's shared folder through ``pyarrow.fs``, under names
that no other task attempt uses; only those that a finished attempt reports in
its manifest count, so lost executors and repeated attempts do no harm.

A null payload is an empty one; a null URL has no target line; any URL comes
back as it was. Repeated rows make one record each.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cosmolake.llm._shared import shared_dir

ROLL_BYTES = 64 << 20  #: An archive is closed once it holds this much before compression.
MONOLITHIC_LEVEL, MEMBER_LEVEL = 1, 3
PIECE = 1 << 20
DATE = "2024-01-01T00:00:00Z"  #: Archives carry a fixed date, so equal input gives equal records.
MANIFEST = "path string, index string, n_records long, n_bytes long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


@dataclass
class Record:
    """A record's header lines by lower-cased name, and its block."""

    head: dict[str, str]
    block: bytes


def _plain(url: str) -> bool:
    return url.isascii() and url.isprintable() and url == url.strip()


def pack(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {url}" if _plain(url) else f"X-Target-URI-Base64: {base64.b64encode(url.encode()).decode()}")
    lines += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(buffer: bytearray) -> tuple[Record, int] | None:
    """The first record in the buffer and its size in bytes, or None if it isn't all there yet."""
    cut = buffer.find(b"\r\n\r\n")
    if cut < 0:
        return None
    lines = buffer[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record where one should begin")
    head = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = cut + 4 + int(head["content-length"]) + 4
    if len(buffer) < size:
        return None
    return Record(head, bytes(buffer[cut + 4 : size - 4])), size


def inflate(source, size: int = PIECE) -> Iterator[bytes]:
    """The content of a gzip file of one or many members, piece by piece."""
    d = zlib.decompressobj(31)
    while data := source.read(size):
        while data:
            out = d.decompress(data, size)
            if out:
                yield out
            data = d.unconsumed_tail
            if d.eof:
                data, d = d.unused_data, zlib.decompressobj(31)
    if out := d.flush():
        yield out


def records(pieces: Iterator[bytes]) -> Iterator[tuple[Record, bytes]]:
    """(record, its bytes) of an inflated stream; no more than one record and a piece is held."""
    buffer, need = bytearray(), 0
    for piece in pieces:
        buffer += piece
        if len(buffer) < need:
            continue
        while buffer and (got := parse(buffer)):
            record, size = got
            yield record, bytes(buffer[:size])
            del buffer[:size]
        cut = buffer.find(b"\r\n\r\n")
        length = buffer[:cut].lower().rpartition(b"\r\ncontent-length:")[2].split(b"\r\n")[0] if cut >= 0 else b""
        need = cut + 8 + int(length) if length.strip().isdigit() else 0
    if buffer.strip():
        raise ValueError("the archive ends within a record")


def first_payloads(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, sha1, refers_to, revisit): which rows are responses and which repeat one.

    Of rows with equal payloads of at least ``least_bytes`` the one with the
    smallest page_id is the response; a second row with that very page_id is a
    response too. Rows without a page_id come last.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("sha1", F.sha1("payload"))
    again = (
        rows.where(F.octet_length("payload") >= least_bytes)
        .groupBy("sha1").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha1", "first_id")
    )
    x = rows.join(again, "sha1", "left").withColumn("revisit", F.coalesce(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.lit(False)))
    return x.select("page_id", "url", "payload", "sha1", F.when(F.col("revisit"), F.col("first_id")).alias("refers_to"), "revisit")


class _Archive:
    """One monolithic gzip file being written."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        system, path = _open(self.path)
        self.out = system.open_output_stream(path, compression=None)
        self.z = zlib.compressobj(MONOLITHIC_LEVEL, zlib.DEFLATED, 31)
        self.n = self.size = 0

    def add(self, record: bytes) -> None:
        self.out.write(self.z.compress(record))
        self.n, self.size = self.n + 1, self.size + len(record)

    def close(self) -> tuple[str, None, int, int]:
        self.out.write(self.z.flush())
        self.out.close()
        return self.path, None, self.n, self.size


def _manifest(rows: list[tuple]) -> pa.RecordBatch:
    path, index, n, size = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.record_batch([pa.array(path, pa.string()), pa.array(index, pa.string()), pa.array(n, pa.int64()), pa.array(size, pa.int64())], ["path", "index", "n_records", "n_bytes"])


def _finished(df: DataFrame, spark: SparkSession) -> DataFrame:
    """The manifest, written through Spark's commit protocol and read again."""
    path = shared_dir(spark, "warc-manifest")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write(rows: DataFrame) -> DataFrame:
    """Write monolithic archives of the rows of :func:`first_payloads`; returns their manifest."""
    spark = rows.sparkSession
    folder = shared_dir(spark, "warc")
    _ready(spark, folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for b in batches:
            for page_id, url, payload, sha1, refers_to, revisit in zip(*(c.to_pylist() for c in b.columns), strict=True):
                archive = archive or _Archive(folder)
                archive.add(pack(page_id, url, payload, base64.b32encode(bytes.fromhex(sha1)).decode(), refers_to, revisit))
                if archive.size >= ROLL_BYTES:
                    done.append(archive.close())
                    archive = None
        if archive:
            done.append(archive.close())
        yield _manifest(done)

    return _finished(rows.mapInArrow(task, MANIFEST), spark)


def _ready(spark: SparkSession, folder: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(folder)
    p.getFileSystem(conf).mkdirs(p)


def normalise(manifest: DataFrame) -> DataFrame:
    """Rewrite every archive with one member a record beside a sidecar offset index; returns the new manifest."""
    spark = manifest.sparkSession
    folder = shared_dir(spark, "warc-members")
    _ready(spark, folder)

    def one(path: str) -> tuple[str, str, int, int]:
        stem = f"{folder}/{uuid.uuid4().hex}"
        target, index = f"{stem}.warc.gz", f"{stem}.idx.jsonl"
        system, at = _open(path)
        n = offset = 0
        out_system, out_at = _open(target)
        with system.open_input_stream(at, compression=None) as source, out_system.open_output_stream(out_at, compression=None) as out, out_system.open_output_stream(_open(index)[1], compression=None) as idx:
            for record, raw in records(inflate(source)):
                z = zlib.compressobj(MEMBER_LEVEL, zlib.DEFLATED, 31)
                member = z.compress(raw) + z.flush()
                out.write(member)
                idx.write(json.dumps({"offset": offset, "length": len(member), "id": record.head["warc-record-id"], "type": record.head["warc-type"]}).encode() + b"\n")
                n, offset = n + 1, offset + len(member)
        return target, index, n, offset

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                yield _manifest([one(path)])

    return _finished(_spread(manifest.select("path")).mapInArrow(task, MANIFEST), spark)


def _spread(manifest: DataFrame) -> DataFrame:
    """One archive a task, up to four tasks a core."""
    return manifest.repartition(4 * manifest.sparkSession.sparkContext.defaultParallelism)


def _id(urn: str) -> int | None:
    return int(x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None


def read(manifest: DataFrame) -> DataFrame:
    """The records of normalised archives (columns of ``RECORD``), each inflated from its own member.

    A revisit's payload is null; its size is that of the full payload, as its
    HTTP header states, its digest the one that the record carries. A
    response's size and digest are taken from the payload itself and held
    against the record's.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, index in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                system, at = _open(path)
                with system.open_input_file(at) as f, system.open_input_stream(_open(index)[1], compression=None) as idx:
                    rows: list[tuple] = []
                    held = 0
                    for line in idx.read().splitlines():
                        x = json.loads(line)
                        f.seek(x["offset"])
                        record, _ = parse(bytearray(zlib.decompress(f.read(x["length"]), 31)))
                        rows.append(row := _row(record))
                        held += len(row[-1] or b"")
                        if held > 8 * PIECE or len(rows) >= 4096:
                            yield _batch(rows)
                            rows, held = [], 0
                    yield _batch(rows)

    return _spread(manifest.select("path", "index")).mapInArrow(task, RECORD)


def _row(record: Record) -> tuple:
    head, (http, _, payload) = record.head, record.block.partition(b"\r\n\r\n")
    digest = head["warc-payload-digest"].removeprefix("sha1:")
    size = int(http.lower().rpartition(b"\r\ncontent-length:")[2].split(b"\r\n")[0])
    url = base64.b64decode(head["x-target-uri-base64"]).decode() if "x-target-uri-base64" in head else head.get("warc-target-uri")
    revisit = head["warc-type"] == "revisit"
    if not revisit:
        size, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if found != digest:
            raise ValueError(f"record {head['warc-record-id']}: its payload doesn't have its digest")
    return _id(head["warc-record-id"]), url, size, digest, head["warc-type"], _id(head["warc-refers-to"]) if revisit else None, None if revisit else payload


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in RECORD.split(", ")]
    cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
    return pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
