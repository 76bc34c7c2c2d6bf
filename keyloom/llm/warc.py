"""Web archives: records written as one gzip member each, and read back one after another."""

from __future__ import annotations

import base64
import hashlib
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import BinaryIO
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import lookup, map_arrow, run_dir

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
READ = 1 << 16
#: Bytes of a record's header lines at most.
HEAD = 1 << 20
LEVEL = 4


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def digest_column(payload: Column) -> Column:
    """SHA-1 in upper-case base32: each 5 hexadecimal digits are 4 of base 32."""
    hexes = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexes, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page_id: int | str | None) -> str:
    return "urn:page" if page_id is None else f"urn:page:{quote(str(page_id), safe='')}"


def record_bytes(kind: str, page_id: int | str | None, url: str, payload: bytes, digest: str, refers_to: int | str | None) -> bytes:
    """One record as a gzip member. A revisit carries the length and the digest of the payload, not the payload."""
    block = b"" if kind == "revisit" else payload
    lines = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_urn(page_id)}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "Content-Type: text/html; charset=utf-8",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest_of(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <{_urn(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    lines.append(f"Content-Length: {len(block)}")
    head = VERSION + b"\r\n" + "\r\n".join(lines).encode() + b"\r\n\r\n"
    pack = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return pack.compress(head) + pack.compress(block) + pack.compress(b"\r\n\r\n") + pack.flush()


@dataclass
class Record:
    headers: dict[str, str] = field(default_factory=dict)
    block: bytes = b""


class _Member:
    """One gzip member of a stream, inflated as it is read; each piece of it has READ bytes at most."""

    def __init__(self, stream: BinaryIO, rest: bytes) -> None:
        self.stream, self.rest = stream, rest  # compressed bytes read and not used yet
        self.unpack = zlib.decompressobj(31)
        self.ready = b""

    def piece(self) -> bytes:
        """The next piece; empty at the member's end."""
        while not self.ready and not self.unpack.eof:
            rest = self.rest or self.stream.read(READ)
            if not rest:
                raise ValueError("the archive ends within a record")
            self.ready = self.unpack.decompress(rest, READ)
            self.rest = self.unpack.unused_data if self.unpack.eof else self.unpack.unconsumed_tail
        out, self.ready = self.ready, b""
        return out

    def give_back(self, data: bytes) -> None:
        self.ready = data


def _headers(member: _Member) -> dict[str, str]:
    head = b""
    while b"\r\n\r\n" not in head:
        if not (more := member.piece()) or len(head) > HEAD:
            raise ValueError("not a record of this version")
        head += more
    head, _, rest = head.partition(b"\r\n\r\n")
    member.give_back(rest)
    first, *lines = head.decode().split("\r\n")
    if first.encode() != VERSION:
        raise ValueError("not a record of this version")
    return dict(x.split(": ", 1) for x in lines)


def read_records(stream: BinaryIO, blocks: bool = True) -> Iterator[Record]:
    """The records of an archive in order; lengths, ends and digests are verified.

    A member is inflated piece by piece, and its content length says where its block ends, so that a member that
    would inflate to more is an error before it has. Without blocks no block is kept, and memory holds a piece.
    """
    rest = b""
    while rest or (rest := stream.read(READ)):
        member = _Member(stream, rest)
        headers = _headers(member)
        left, digest, parts = int(headers["Content-Length"]), hashlib.sha1(), []
        while left and (data := member.piece()):
            member.give_back(data[left:])
            digest.update(data[:left])
            parts += [data[:left]] * blocks
            left -= min(left, len(data))
        end = b""
        while len(end) <= 4 and (data := member.piece()):
            end += data
        if left or end != b"\r\n\r\n":
            raise ValueError("a record's length is wrong")
        found = f"sha1:{base64.b32encode(digest.digest()).decode()}"
        if found != headers["WARC-Block-Digest"]:
            raise ValueError("a record's block does not fit its digest")
        if headers["WARC-Type"] == "response" and headers["WARC-Payload-Digest"] != found:
            raise ValueError("a response's payload does not fit its digest")
        yield Record(headers, b"".join(parts))
        rest = member.rest


def _store(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a URI, or of a plain path."""
    return pyarrow.fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pyarrow.fs.LocalFileSystem(), folder)


def plan_records(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 0) -> DataFrame:
    """pages with payload_digest, record_type and refers_to.

    Of rows with equal payloads of at least `least` bytes the one with the largest id is the response and the others
    revisit it. Null counts as empty. Rows without id are responses; rows repeated with the largest id all are.
    """
    rows = pages.withColumn("payload_digest", digest_column(F.coalesce(F.col(payload_col), F.lit(""))))
    large = F.octet_length(F.coalesce(F.col(payload_col), F.lit(""))) >= least
    groups = rows.where(large).groupBy("payload_digest").agg(F.max(id_col).alias("first"), F.count("*").alias("n")).where("n > 1")
    rows = lookup(rows, groups, ["payload_digest"], "n", pages.count(), F.col(id_col), "_g")
    first = F.when(large & (F.col(id_col) != F.col("_g.first")), F.col("_g.first"))
    return rows.withColumn("refers_to", first).withColumn("record_type", F.when(first.isNull(), "response").otherwise("revisit")).drop("_g")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0) -> DataFrame:
    """Writes a .warc.gz per partition into folder; one row (path, records) per archive.

    A task writes to a name of its own and then moves the file to the partition's name, so that a task run again, on
    this executor or another, leaves one whole archive.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, top = _store(folder)
        store.create_dir(top, recursive=True)
        name = f"{top}/part-{context.partitionId():06d}.warc.gz"
        own = f"{top}/_{context.partitionId():06d}-{context.taskAttemptId()}-{os.getpid()}"
        n = 0
        with store.open_output_stream(own, compression=None) as out:
            for batch in batches:
                columns = [c for c in batch.columns]
                for r in range(batch.num_rows):
                    page_id, url, html, digest, kind, refers_to = (c[r].as_py() for c in columns)
                    payload = (html or "").encode()
                    if digest_of(payload) != digest:
                        raise ValueError("the payload differs from the one planned")
                    out.write(record_bytes(kind, page_id, url, payload, digest, refers_to))
                    n += 1
        store.move(own, name)
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})

    rows = plan_records(pages, id_col, payload_col, least).select(id_col, url_col, payload_col, "payload_digest", "record_type", "refers_to")
    return map_arrow(rows, run, "path string, records long")


def read_archives(spark: SparkSession, archives: DataFrame, folder: str, id_type: T.DataType | None = None, payloads: bool = False) -> DataFrame:
    """A row per record of the archives at the paths: page_id, payload_bytes, payload_digest, record_type, refers_to, and on request payload."""
    id_type = id_type or T.LongType()
    textual = isinstance(id_type, T.StringType)
    id_kind = to_arrow_type(id_type)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *["payload"] * payloads]

    def flush(got: list[tuple]) -> pa.RecordBatch:
        kinds = [id_kind, pa.int64(), pa.string(), pa.string(), id_kind, *[pa.binary()] * payloads]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*got), kinds)], names=names)

    def id_of(text: str) -> int | str | None:
        inner = text.removeprefix("<urn:page").removesuffix(">")
        if not inner:
            return None
        return unquote(inner[1:]) if textual else int(inner[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _store(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                got: list[tuple] = []
                held = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_records(stream, payloads):
                        h = r.headers
                        refers_to = id_of(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                        got.append((id_of(h["WARC-Record-ID"]), int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"], refers_to, *[r.block] * payloads))
                        held += len(r.block) * payloads
                        if len(got) == 1000 or held > 1 << 24:
                            yield flush(got)
                            got, held = [], 0
                if got:
                    yield flush(got)

    fields = [T.StructField(n, T.StringType() if n in ("payload_digest", "record_type") else T.BinaryType() if n == "payload" else T.LongType() if n == "payload_bytes" else id_type) for n in names]
    return map_arrow(archives.select("path"), run, T.StructType(fields))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes pages to archives in the shared folder and returns the records read back, one per page.

    The list of archives, a row per partition, is what the writing job leaves; each archive is read by one task.
    Ids are integers or strings. Null html is an empty payload, and empty payloads of several pages are equal ones; rows
    without id are responses and nothing refers to them; rows repeated with the largest id are all responses. Payloads of
    any length are written whole. An empty table gives an empty result; other columns of pages, whatever their names, play no part.
    """
    pages = pages.select("page_id", "url", "html")
    spark = pages.sparkSession
    folder = run_dir(spark, "warc")
    write_archives(pages, folder, least=least).write.parquet(f"{folder}-list")
    listed = spark.read.parquet(f"{folder}-list")
    n = max(1, min(listed.count(), 10_000))
    return read_archives(spark, listed.repartition(n, "path"), folder, pages.schema["page_id"].dataType)
