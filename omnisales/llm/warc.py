"""WARC archives: a writer, and a reader that splits compressed files.

Archives are gzip files with one member a record. The writer's tasks write files of their own to the shared
folder and return their names and sizes; only files that a finished task has returned are read, so a task that
is run again after a lost executor does no harm. Records whose payload another record already has are revisits.

The reader deals byte ranges of the files to tasks. A task looks for the gzip magic in its range and takes a place for a
member only if its decoded start is a record header and members follow it without a gap to the end of the range or
file: the bytes of an archive inside a payload look like members, too, but what follows the last of them does not. It owns the
records that start inside its range; the last one is read to its end beyond it. No index is needed, and every record
has exactly one owner. Archives of others are read as well: any record types, header lines in their several forms.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import new_folder, written

MAGIC = b"\x1f\x8b\x08"
#: A file is closed once it has so many bytes; a task reads ranges of SPLIT_BYTES, some RANGES of them where there are many.
FILE_BYTES, SPLIT_BYTES, RANGES = 1 << 30, 16 << 20, 16
BLOCK = 1 << 20
DATE = "2000-01-01T00:00:00Z"
FILES = "path string, size long, records long"
RECORDS = ("page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, "
           "refers_to long")


def payload_digest(sha1_hex: str) -> str:
    """Bare upper-case base32 of a SHA-1."""
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None,
                 revisit: bool) -> bytes:
    """One record as a gzip member. A revisit has the HTTP header of the full payload and no payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n").encode()
    block = http + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>",
            f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%-._~' + chr(39))}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    return pack.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + pack.flush()


def _write(folder: str, file_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        done: list[tuple[str, int, int]] = []
        out, path, size, records = None, "", 0, 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, records))
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                data = record_bytes(r["page_id"], r["url"], r["payload"], r["payload_bytes"], payload_digest(r["sha1"]),
                                    r["refers_to"], r["revisit"])
                if out is None:
                    path, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    store.create_dir(base, recursive=True)
                    out = store.open_output_stream(f"{base}/{path}", compression=None)
                out.write(data)
                size, records = size + len(data), records + 1
                if size >= file_bytes:
                    close()
        close()
        yield pa.RecordBatch.from_pylist([{"path": p, "size": s, "records": n} for p, s, n in done],
                                         pa.schema([("path", pa.string()), ("size", pa.int64()), ("records", pa.int64())]))
    return run


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0,
                   file_bytes: int = FILE_BYTES) -> tuple[str, DataFrame]:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``); returns the folder and its files.

    The payload is the html in UTF-8, empty if null. Of rows with equal payloads of at least ``least_bytes`` bytes,
    the one with the smallest page_id is the response and the others are revisits of it; rows that repeat that id are
    responses, and where all ids are null all rows are. Smaller payloads are responses. Payloads are equal if their SHA-1
    and length are. One record is held in memory at a time, whatever its length. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = folder or new_folder(spark, "archives")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "payload_bytes": F.octet_length("payload").cast("long")})
    same = ["sha1", "payload_bytes"]
    first = rows.where(F.col("payload_bytes") >= least_bytes).groupBy(*same).agg(F.min("page_id").alias("first"))
    first = first.where("first is not null")
    revisit = F.coalesce((F.col("first") < F.col("page_id")) | (F.col("first").isNotNull() & F.col("page_id").isNull()),
                         F.lit(False)) & (F.col("payload_bytes") >= least_bytes)
    told = (rows.join(first, same, "left").withColumn("revisit", revisit)
            .select("page_id", "url", F.when(F.col("revisit"), F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
                    "sha1", "payload_bytes", F.when(F.col("revisit"), F.col("first")).alias("refers_to"), "revisit"))
    return folder, written(told.mapInArrow(_write(folder, file_bytes), FILES), "archive-files")


class _Window:
    """A file's bytes from a place on, read in blocks."""

    def __init__(self, file: pa.NativeFile, size: int, at: int):
        self.file, self.size, self.base, self.data = file, size, at, b""
        self.file.seek(at)

    def more(self) -> bool:
        got = self.file.read(BLOCK)
        self.data += got
        return bool(got)

    def forget(self, at: int) -> None:
        self.data = self.data[at - self.base:]
        self.base = at

    def find(self, start: int, end: int) -> int | None:
        """The first gzip magic at ``start`` or later but before ``end``."""
        while True:
            at = self.data.find(MAGIC, start - self.base)
            if at >= 0:
                return self.base + at if self.base + at < end else None
            start = max(start, self.base + len(self.data) - len(MAGIC) + 1)
            if start >= end:
                return None
            self.forget(start)
            if not self.more():
                return None

    def member(self, at: int) -> tuple[bytes, int] | None:
        """The record that starts here and where its member ends; None if this is no record."""
        self.forget(at)
        unpack, parts, fed, checked = zlib.decompressobj(31), [], 0, False
        while not unpack.eof:
            if fed == len(self.data) and not self.more():
                if checked:
                    raise ValueError(f"record at byte {at} is cut off")
                return None
            piece = self.data[fed:fed + (BLOCK if checked else 512)]
            fed += len(piece)
            try:
                parts.append(unpack.decompress(piece))
            except zlib.error:
                if checked:
                    raise
                return None
            if not checked:
                head = b"".join(parts)
                if not b"WARC/1.".startswith(head[:7]):
                    return None
                checked = len(head) >= 7
        return (b"".join(parts), at + fed - len(unpack.unused_data)) if checked else None


def records_in(file: pa.NativeFile, size: int, start: int, end: int) -> Iterator[bytes]:
    """The records that start in a byte range of an archive."""
    at: int | None = start
    if start:
        window = _Window(file, size, start)
        at = window.find(start, end)
        while at is not None and not _chained(file, size, at, end):
            window = _Window(file, size, at + 1)
            at = window.find(at + 1, end)
    window = _Window(file, size, at or 0)
    while at is not None and at < end:
        got = window.member(at)
        if got is None:
            raise ValueError(f"no record at byte {at}")
        yield got[0]
        at = got[1]


def _chained(file: pa.NativeFile, size: int, at: int, end: int) -> bool:
    """Whether members of records follow each other from here to the end of the range, or of the file."""
    window = _Window(file, size, at)
    while at < end:
        try:
            got = window.member(at)
        except (ValueError, zlib.error):
            return False
        if got is None:
            return False
        at = got[1]
    return True


def _number(value: str | None) -> int | None:
    name = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name.lstrip("-").isdigit() else None


def _fields(head: bytes) -> dict[str, str]:
    """Header lines by lower-case name: white space around the colon or none, values folded over lines, line feeds alone."""
    found: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            found[name] = f"{found[name]} {line.strip()}".strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            found[name] = value.strip()
    return found


def _split(data: bytes) -> tuple[bytes, bytes]:
    """Header and what follows its empty line."""
    head, found, rest = data.partition(b"\r\n\r\n")
    bare, bare_found, bare_rest = data.partition(b"\n\n")
    return (bare, bare_rest) if bare_found and (not found or len(bare) < len(head)) else (head, rest)


def parse_record(data: bytes) -> dict:
    """A record as a row. The payload of an HTTP message is its body, of any other record its block."""
    head, rest = _split(data)
    fields = _fields(head)
    block = rest[:int(fields["content-length"])] if "content-length" in fields else rest
    kind = fields.get("warc-type", "")
    payload, http = block, {}
    if fields.get("content-type", "").lower().startswith("application/http"):
        http_head, payload = _split(block)
        http = _fields(http_head)
    revisit = kind == "revisit"
    stated = http.get("content-length", "")
    size = int(stated) if revisit and stated.isdigit() else len(payload)
    algorithm, _, digest = fields.get("warc-payload-digest", "").partition(":")
    own = hashlib.sha1(payload)
    if algorithm.lower() != "sha1" or not digest:
        digest = "" if revisit else payload_digest(own.hexdigest())
    elif not revisit and "transfer-encoding" not in http and "content-encoding" not in http:
        if digest.upper() not in (payload_digest(own.hexdigest()), own.hexdigest().upper()) or stated.isdigit() and int(stated) != size:
            raise ValueError(f"payload of {fields.get('warc-record-id')} does not fit its digest")
    return {"page_id": _number(fields.get("warc-record-id")), "url": fields.get("warc-target-uri"),
            "record_type": kind, "payload": None if revisit else payload, "payload_bytes": size,
            "payload_digest": digest or None, "refers_to": _number(fields.get("warc-refers-to"))}


RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()),
                           ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])


def _read(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for r in batch.to_pylist():
                rows, held = [], 0
                with store.open_input_file(f"{base}/{r['path']}") as file:
                    for data in records_in(file, r["size"], r["start"], r["end"]):
                        rows.append(parse_record(data))
                        held += len(data)
                        if held >= 4 * BLOCK:
                            yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, RECORD_SCHEMA)
    return run


def read_archives(folder: str, files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The records of the files (``path``, ``size``) in the folder; a response's payload is checked against its digest.

    A record cut off at a file's end or a payload that does not fit its digest is an error. No files: no records. Records
    of other writers have a null ``page_id``; where they state no payload digest it is computed (a revisit has none).
    """
    splits = (files.where("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1,
                                                                                 F.lit(split_bytes).cast("long"))).alias("start"))
              .withColumn("end", F.least(F.col("start") + split_bytes, "size")))
    n = splits.count()
    tasks = min(n, max(files.sparkSession.sparkContext.defaultParallelism, -(-n // RANGES)))
    return splits.repartition(max(1, tasks)).mapInArrow(_read(folder), RECORDS)
