"""WARC archives: a writer that stores equal payloads once, and a reader that salvages.

Writer: one gzip member per record, files of bounded size below a shared folder, and a manifest
of the files that succeeded, so what a failed attempt left is never read. Among records
with equal payloads of at least ``MIN_PAYLOAD`` bytes the one with the smallest page id is a
response; the others are revisits that name it and have no payload of their own.

Reader: a record is accepted if its member decompresses with a right check sum, its header
parses, its length fits and its block digest (if any) matches. After a failed check it looks
for the next place where a whole valid record begins (a gzip member, or a version line in an
uncompressed archive), and reports the bytes in between as a gap. It holds one record and
one chunk in memory.

Defined results: null html is an empty payload; null url or page id leave the header out; a
repeated row of a response is a response too; null page ids are never revisited; an empty
table gives no files.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns_of, in_batches, open_folder, prepare, qualified, save, shared_folder

MIN_PAYLOAD = 100
#: A new file is begun when one has this many bytes.
FILE_BYTES = 64 << 20
CHUNK = 1 << 20
LEVEL = 4
ONCE = {"warc-type", "warc-record-id", "warc-date", "content-length"}
DATE = "1970-01-01T00:00:00Z"

_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])
RECORD = "kind string, path string, start long, end long, reason string, headers map<string, string>, payload binary"
_RECORD = pa.schema([
    ("kind", pa.string()), ("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("reason", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()),
])


def with_revisits(pages: DataFrame, least: int = MIN_PAYLOAD) -> DataFrame:
    """``page_id, url, payload, payload_digest, refers_to``.

    Copies are found on digests alone: minima are summed per task before the shuffle, and the
    join that names them carries ids and digests. The payloads are dealt out by page.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("payload_digest", F.sha2("payload", 256))
    long = rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull()).select("page_id", "payload_digest")
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("times")).where("times > 1")
    revisits = long.join(first, "payload_digest").where("page_id > refers_to").select("page_id", "payload_digest", "refers_to").distinct()
    return rows.join(revisits, ["page_id", "payload_digest"], "left")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, uncompressed. A revisit has the response's head and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    name = f"<urn:page:{page_id}>" if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name), ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url)),
        ("WARC-Profile", None if refers_to is None else "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"),
        ("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block))),
    ]
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def zipped(data: bytes, level: int = LEVEL) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def write_archives(pages: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write one record per page; the manifest ``path, records, bytes``."""
    spark = pages.sparkSession
    prepare(spark)
    folder = qualified(folder or shared_folder(spark, "warc")).rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def files():
            system, root = open_folder(folder)
            out, name, records, size = None, "", 0, 0
            for row in columns_of(batches, "page_id", "url", "payload", "payload_digest", "refers_to"):
                if out is None:
                    system.create_dir(root, recursive=True)
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                member = zipped(record(*row))
                out.write(member)
                records += 1
                size += len(member)
                if size >= file_bytes:
                    out.close()
                    out = None
                    yield f"{folder}/{name}", records, size
            if out is not None:
                out.close()
                yield f"{folder}/{name}", records, size

        yield from in_batches(files(), _MANIFEST)

    return save(with_revisits(pages).mapInArrow(write, "path string, records long, bytes long"))


# --- reading -------------------------------------------------------------------------------


class Tape:
    """A window on a stream, with absolute positions."""

    def __init__(self, source, chunk: int = CHUNK):
        self.source, self.chunk = source, chunk
        self.data, self.base, self.ended = bytearray(), 0, False

    def more(self) -> bool:
        got = b"" if self.ended else self.source.read(self.chunk)
        self.ended = not got
        self.data += got
        return bool(got)

    def get(self, start: int, size: int) -> bytes:
        """Up to ``size`` bytes from ``start``; fewer only at the end."""
        while self.base + len(self.data) < start + size and self.more():
            pass
        return bytes(memoryview(self.data)[max(start - self.base, 0) : max(start - self.base + size, 0)])

    def find(self, mark: bytes, start: int) -> int:
        """The next place of ``mark`` from ``start`` on, or -1."""
        at = start
        while True:
            found = self.data.find(mark, at - self.base)
            if found >= 0:
                return self.base + found
            at = max(start, self.base + len(self.data) - len(mark) + 1)
            if not self.more():
                return -1

    def drop(self, before: int) -> None:
        if before - self.base > self.chunk:
            del self.data[: before - self.base]
            self.base = before

    def end(self) -> int:
        return self.base + len(self.data)


class Damaged(Exception):
    """A record that fails a check; the text is the reason that the log gives."""


def unzip_member(tape: Tape, start: int) -> tuple[bytes, int]:
    """Content and end of the gzip member at ``start``."""
    unpack, at, out = zlib.decompressobj(31), start, []
    try:
        while not unpack.eof:
            piece = tape.get(at, CHUNK)
            if not piece:
                raise Damaged("member is cut off")
            out.append(unpack.decompress(piece))
            at += len(piece)
            if len(out) == 1 and not out[0].startswith(b"WARC/"[: len(out[0])]):
                raise Damaged("member holds no record")
    except zlib.error as e:
        raise Damaged("member doesn't decompress") from e
    return b"".join(out), at - len(unpack.unused_data)


def parse(content: bytes, whole: bool = True) -> tuple[dict[str, str], bytes, int]:
    """Headers, block and size of the record at the start of ``content``."""
    if not _VERSION.match(content):
        raise Damaged("no version line")
    stop = content.find(b"\r\n\r\n")
    if stop < 0:
        raise Damaged("header isn't closed")
    headers: dict[str, str] = {}
    for line in content[:stop].split(b"\r\n")[1:]:
        key, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without colon")
        name = key.decode("utf-8", "replace").strip().lower()
        if name in headers and name in ONCE:  # the heads of two records have run together
            raise Damaged("header repeats a field")
        headers[name] = value.decode("utf-8", "replace").strip()
    length = headers.get("content-length", "")
    if not length.isascii() or not length.isdigit():
        raise Damaged("no content length")
    end = stop + 4 + int(length)
    if content[end : end + 4] != b"\r\n\r\n" or whole and len(content) != end + 4:
        raise Damaged("length doesn't fit")
    block = content[stop + 4 : end]
    kind, _, digest = headers.get("warc-block-digest", "").partition(":")
    if kind == "sha256" and hashlib.sha256(block).hexdigest() != digest.lower():
        raise Damaged("block digest differs")
    return headers, block, end + 4


def _plain_record(tape: Tape, start: int) -> tuple[dict[str, str], bytes, int]:
    if not _VERSION.match(tape.get(start, 10)):
        raise Damaged("no version line")
    stop = tape.find(b"\r\n\r\n", start)
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)[ \t]*\r\n", tape.get(start, stop + 4 - start)) if stop >= 0 else None
    if length is None:
        raise Damaged("no content length")
    headers, block, size = parse(tape.get(start, stop - start + 8 + int(length[1])))
    return headers, block, start + size


def _zipped_record(tape: Tape, start: int) -> tuple[dict[str, str], bytes, int]:
    content, end = unzip_member(tape, start)
    headers, block, _ = parse(content)
    return headers, block, end


def salvage(source) -> Iterator[tuple[str, int, int, str | None, dict[str, str] | None, bytes | None]]:
    """``kind, start, end, reason, headers, block`` of records and gaps, which together tile the file."""
    tape = Tape(source)
    zipped_file = tape.get(0, 2) == b"\x1f\x8b" or (not tape.get(0, 5).startswith(b"WARC/") and tape.find(b"\x1f\x8b\x08", 0) >= 0)
    mark, read = (b"\x1f\x8b\x08", _zipped_record) if zipped_file else (b"WARC/1.", _plain_record)
    at, gap, reason = 0, None, None
    while tape.get(at, 1):
        try:
            headers, block, end = read(tape, at)
        except Damaged as e:
            if gap is None:
                gap, reason = at, str(e)
            following = tape.find(mark, at + 1)
            at = following if following >= 0 else tape.end()
        else:
            if gap is not None:
                yield "gap", gap, at, reason, None, None
                gap = None
            yield "record", at, end, None, headers, block
            at = end
        tape.drop(at)  # what failed isn't read again either
    if gap is not None:
        yield "gap", gap, at, reason, None, None


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without its HTTP head, if it has one."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_archives(spark: SparkSession, paths: DataFrame) -> DataFrame:
    """Rows of kind ``record`` and ``gap`` of the archives in column ``path``.

    A gap tells which bytes of which file are quarantined, and why the first check failed.
    """
    prepare(spark)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for (path,) in columns_of(batches, "path"):
                system, place = open_folder(path)
                with system.open_input_file(place) as source:
                    for kind, start, end, reason, headers, block in salvage(source):
                        head = None if headers is None else list(headers.items())
                        if head is not None and headers.get("warc-type") == "revisit":
                            length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", block)
                            head += [("x-payload-length", length[1].decode())] if length else []
                        yield kind, path, start, end, reason, head, None if block is None else payload_of(headers, block)

        yield from in_batches(rows(), _RECORD, 5_000, weigh=lambda row: len(row[6] or b""))

    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return paths.select("path").repartition(spread).mapInArrow(read, RECORD)


def digest(read: DataFrame) -> DataFrame:
    """Page, payload and revisit columns of the records."""
    head = F.col("headers")
    kind = head["warc-type"]
    page = F.regexp_extract(head["warc-record-id"], r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    refers = F.regexp_extract(head["warc-refers-to"], r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
    return read.where("kind = 'record'").select(
        page.alias("page_id"),
        F.when(kind == "revisit", head["x-payload-length"].try_cast("long")).otherwise(F.length("payload").cast("long")).alias("payload_bytes"),
        F.when(kind == "revisit", F.regexp_replace(head["warc-payload-digest"], "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        kind.alias("record_type"), F.when(kind == "revisit", refers).alias("refers_to"),
    )
