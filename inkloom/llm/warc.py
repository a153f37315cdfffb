"""WARC archives: write records with revisits, read them back, salvage damage.

Writing: each task streams one archive of gzip members (a record each) into
the target folder under a name of its own and returns it in a manifest. Only
archives of tasks that ended are in the manifest, so a lost or repeated task
leaves a file that nobody reads, never a record read twice.

Reading: a task takes an archive and holds one record at a time. When a check
fails (gzip CRC, version line, lengths, block or payload digest), the reader
searches for the next offset where a whole valid member or version line
begins, goes on there, and logs the bytes between as a quarantined gap.

Folders are reached with ``pyarrow.fs``: local or shared paths, and the stores
that it knows (hdfs, s3, gs).
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CRLF = b"\r\n"
DATE = "1970-01-01T00:00:00Z"
VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
MAGIC = b"\x1f\x8b\x08"
STEP = 1 << 20
MOST = (1 << 31) - 1


class Damaged(Exception):
    """A record or member fails its checks."""


@dataclass
class Record:
    headers: dict[str, str]
    block: bytes
    payload: bytes = field(default=b"")


def member(headers: list[tuple[str, str]], block: bytes, *, gzip: bool = True) -> bytes:
    """One record's bytes, as a gzip member or plain."""
    lines = [b"WARC/1.1", *(f"{k}: {v}".encode() for k, v in headers), b"Content-Length: %d" % len(block)]
    raw = CRLF.join(lines) + CRLF * 2 + block + CRLF * 2
    if not gzip:
        return raw
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def build(record_id: str, kind: str, uri: str | None, payload: bytes, digest: str, n_bytes: int, refers_to: str | None, *, gzip: bool = True) -> bytes:
    """A response (with its payload) or a revisit (HTTP headers only)."""
    http = CRLF.join([b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % n_bytes]) + CRLF * 2
    block = http if kind == "revisit" else http + payload
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{record_id}>"),
        ("WARC-Date", DATE),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("X-Payload-Length", str(n_bytes)),
    ]
    if uri is not None:
        headers.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri)))
    if kind == "revisit":
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<{refers_to}>")]
    return member(headers, block, gzip=gzip)


def parse(raw: bytes) -> tuple[Record, int]:
    """The record at the start of ``raw`` and where it ends; Damaged if it fails a check."""
    if not (v := VERSION.match(raw)):
        raise Damaged("no version line")
    end = raw.find(b"\r\n\r\n", v.end() - 2)
    if end < 0:
        raise Damaged("headers don't end")
    headers: dict[str, str] = {}
    for line in raw[v.end() : end].split(CRLF):
        name, colon, value = line.decode("utf-8", errors="replace").partition(":")
        if not colon:
            raise Damaged("bad header line")
        headers[name.strip().lower()] = value.strip()
    if not (n := headers.get("content-length", "")).isdigit():
        raise Damaged("no content length")
    start = end + 4
    stop = start + int(n)
    if len(raw) < stop + 4:
        raise Damaged("record is cut off")
    if raw[stop : stop + 4] != CRLF * 2:
        raise Damaged("record doesn't end where its length says")
    block = raw[start:stop]
    said = headers.get("warc-block-digest", "")
    if said.startswith("sha256:") and said[7:] != hashlib.sha256(block).hexdigest():
        raise Damaged("block digest differs")
    payload = block
    if headers.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    said = headers.get("warc-payload-digest", "")
    if headers.get("warc-type") != "revisit" and said.startswith("sha256:") and said[7:] != hashlib.sha256(payload).hexdigest():
        raise Damaged("payload digest differs")
    return Record(headers, block, payload), stop + 4


class Salvager:
    """Records and gaps of one archive, in order, holding one record at a time.

    A member that inflates to more than ``most`` bytes (a value of a table holds
    no more) is a gap, noticed as soon as it does.
    """

    def __init__(self, file: pa.NativeFile, size: int, most: int = MOST):
        self.file, self.size, self.most = file, size, most

    def at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(min(n, self.size - offset)) if offset < self.size else b""

    def record(self, offset: int) -> tuple[Record, int]:
        """The record that begins at ``offset`` and the offset after it."""
        head = self.at(offset, 1 << 14)
        if head.startswith(MAGIC):
            z, parts, size, data, at = zlib.decompressobj(31), [], 0, head, offset + len(head)
            try:
                while not z.eof:
                    parts.append(z.decompress(data, STEP))
                    size += len(parts[-1])
                    if size > self.most:
                        raise Damaged(f"member inflates to more than {self.most} bytes")
                    data = z.unconsumed_tail
                    if not data and not z.eof and len(parts[-1]) < STEP:
                        if not (data := self.at(at, STEP)):
                            raise Damaged("member is cut off")
                        at += len(data)
            except zlib.error as e:
                raise Damaged(f"gzip: {e}") from None
            raw = b"".join(parts)
            got, end = parse(raw)
            if raw[end:].strip(CRLF):
                raise Damaged("member goes on after its record")
            return got, at - len(z.unused_data)
        if not VERSION.match(head):
            raise Damaged("neither a member nor a version line")
        end = head.find(CRLF * 2)
        while end < 0 and offset + len(head) < self.size:
            seen = len(head)
            head += self.at(offset + seen, max(STEP, seen))
            end = head.find(CRLF * 2, seen - 3)
        m = re.search(rb"(?i)\r\ncontent-length:\s*(\d+)", head[: max(0, end)])
        if m and (stop := end + 8 + int(m[1])) > len(head):
            head = self.at(offset, min(stop, self.size - offset))
        got, end = parse(head)
        return got, offset + end

    def starts(self, offset: int) -> Iterator[int]:
        """Offsets from ``offset`` on where a member or version line may begin."""
        base = offset
        while base < self.size:
            data = self.at(base, STEP + 16)
            for m in re.finditer(rb"\x1f\x8b\x08|(?<![^\n])WARC/1\.[01]\r?\n", data):
                if m.start() < STEP:
                    yield base + m.start()
            base += STEP

    def rows(self) -> Iterator[tuple[int, int, Record | None, str | None]]:
        """(offset, length, record, None) or (offset, length, None, reason of the gap)."""
        at = 0
        while at < self.size:
            if (pad := self.at(at, 4)).strip(CRLF) == b"":
                at += len(pad)
                continue
            try:
                got, end = self.record(at)
                yield at, end - at, got, None
            except Damaged as why:
                end = self.size
                for start in self.starts(at + 1):
                    try:
                        self.record(start)
                    except Damaged:
                        continue
                    end = start
                    break
                yield at, end - at, None, str(why)
            at = end


def plan_records(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 100) -> DataFrame:
    """Rows to write: record_id, record_type, uri, payload, payload_digest, payload_bytes, refers_to.

    The smallest id of equal payloads of ``min_bytes`` or more is the response.
    That minimum is combined before its shuffle; very common payloads are
    split by the adaptive skew join. Rows that share the smallest id are all
    responses; null ids are revisits of a response that has an id, else responses.
    """
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(c.cast("string"), F.lit("null")))
    x = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("uri"), F.encode(F.coalesce(F.col(html_col), F.lit("")), "utf-8").alias("payload"))
    x = x.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    first = x.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    x = x.join(first.where("copies > 1 and first is not null").drop("copies"), "payload_digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    return x.select(
        name(F.col("id")).alias("record_id"),
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        "uri",
        F.when(~again, F.col("payload")).alias("payload"),
        "payload_digest",
        "payload_bytes",
        F.when(again, name(F.col("first"))).alias("refers_to"),
    )


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write ``records`` (as from plan_records) and return the manifest: file, members, bytes.

    The manifest is lazy; write it down (``settle``) to make the archives.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        out, members, size = None, 0, 0
        for batch in batches:
            cols = [batch.column(c) for c in range(7)]
            for i in range(batch.num_rows):
                rid, kind, uri, payload, digest, n, ref = (c[i].as_py() for c in cols)
                data = build(rid, kind, uri, payload or b"", digest, n, ref)
                out = out or store.open_output_stream(f"{path}/{name}", compression=None)
                out.write(data)
                members, size = members + 1, size + len(data)
        if out:
            out.close()
            yield pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "members": pa.array([members], pa.int64()), "bytes": pa.array([size], pa.int64())})

    return records.select("record_id", "record_type", "uri", "payload", "payload_digest", "payload_bytes", "refers_to").mapInArrow(run, "file string, members long, bytes long")


READ = "file string, offset long, length long, gap string, record_id string, record_type string, uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"


def read_archives(manifest: DataFrame, *, payloads: bool = True) -> DataFrame:
    """Records and gaps of the archives named in ``manifest.file``.

    A row has ``gap`` (the reason; offset and length give the quarantined
    bytes) or a record. The digest and length of a response are computed from
    the bytes read; a revisit has those of its headers. Null file names are
    skipped; an empty archive has no rows.
    """
    schema = pa.schema([("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), *((c, pa.string()) for c in ("gap", "record_id", "record_type", "uri", "payload_digest")), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])

    def bare(x: str | None) -> str | None:
        return x.strip("<>") if x is not None else None

    def rows(name: str):
        store, path = fs.FileSystem.from_uri(name)
        size = store.get_file_info(path).size
        with store.open_input_file(path) as file:
            for offset, length, got, gap in Salvager(file, size).rows():
                if got is None:
                    yield name, offset, length, gap, *[None] * 7
                    continue
                h = got.headers
                again = h.get("warc-type") == "revisit"
                n = h.get("x-payload-length", "") if again else ""
                yield (
                    name, offset, length, None, bare(h.get("warc-record-id")), h.get("warc-type"), h.get("warc-target-uri"),
                    h.get("warc-payload-digest", "").removeprefix("sha256:") if again else hashlib.sha256(got.payload).hexdigest(),
                    int(n) if n.isdigit() else None if again else len(got.payload),
                    bare(h.get("warc-refers-to")), got.payload if payloads and not again else None,
                )

    def batches_of(it, most=512, most_bytes=1 << 24):
        held, size = [], 0
        for r in it:
            held.append(r)
            size += len(r[-1] or b"")
            if len(held) >= most or size >= most_bytes:
                yield held
                held, size = [], 0
        if held:
            yield held

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                for held in batches_of(rows(name) if name else ()):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)

    return manifest.select("file").mapInArrow(run, READ)
