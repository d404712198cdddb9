"""Token-id files of independent zstandard frames with a trailing seek table.

A file is a row of zstandard frames, then two skippable frames, so any zstandard reader can
decompress it whole. Frame content: ``u32`` number of pieces; per piece ``i64`` document,
``u8`` flags, ``u32`` number of ids; then the ids as ``u32``, all little-endian. Flags: 1 the
document began in an earlier frame, 2 it goes on in the next one, 4 its id is null. The first
skippable frame has each frame's first and last document; the second is the seek table of the
public seekable format: compressed size, size and checksum (low half of XXH64) per frame.

Defined results: a null or empty text is the end id alone; repeated document ids keep one
entry each, ordered by text hash; null ids come first; an empty table gives no files and no
rows. Frames are cut at ``FRAME_IDS`` ids, so memory doesn't grow with a long document.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import columns_of, in_batches, open_folder, prepare, qualified, save, shared_folder
from .tokens import default_tokenizer, encoder

FRAME_IDS = 1 << 18
LEVEL = 3
SKIPPABLE, SEEK, FOOTER = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
BEGAN, GOES_ON, NULL_ID = 1, 2, 4
PIECE = struct.Struct("<qBI")

MANIFEST = "part int, path string, documents long, ids long, frames long, bytes long"
_MANIFEST = pa.schema([("part", pa.int32()), ("path", pa.string()), ("documents", pa.int64()), ("ids", pa.int64()), ("frames", pa.int64()), ("bytes", pa.int64())])
_READ = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


class FileWriter:
    """Writes one file to a binary stream."""

    def __init__(self, out, frame_ids: int = FRAME_IDS, level: int = LEVEL):
        import zstandard

        self.out, self.frame_ids = out, frame_ids
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.pieces: list[tuple[int, int, int]] = []
        self.held: list[bytes] = []
        self.in_frame = self.documents = self.ids = self.bytes = 0
        self.table: list[tuple[int, int, int]] = []
        self.ends: list[tuple[int, int]] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        at, total, flags = 0, len(ids) // 4, 0 if doc_id is not None else NULL_ID
        while True:
            take = min(total - at, self.frame_ids - self.in_frame)
            more = at + take < total
            self.pieces.append((doc_id or 0, flags | (BEGAN if at else 0) | (GOES_ON if more else 0), take))
            self.held.append(ids[4 * at : 4 * (at + take)])
            self.in_frame += take
            at += take
            if self.in_frame >= self.frame_ids:
                self._flush()
            if not more:
                break
        self.documents += 1
        self.ids += total

    def _flush(self) -> None:
        import xxhash

        if not self.pieces:
            return
        content = b"".join([struct.pack("<I", len(self.pieces)), *(PIECE.pack(*p) for p in self.pieces), *self.held])
        frame = self.pack.compress(content)
        self.out.write(frame)
        self.bytes += len(frame)
        self.table.append((len(frame), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))
        named = [doc_id for doc_id, flags, _ in self.pieces if not flags & NULL_ID]
        self.ends.append((named[0], named[-1]) if named else (1, 0))
        self.pieces, self.held, self.in_frame = [], [], 0

    def close(self) -> None:
        self._flush()
        ends = b"".join(struct.pack("<qq", *e) for e in self.ends)
        seek = b"".join(struct.pack("<III", *e) for e in self.table) + struct.pack("<IBI", len(self.table), 0x80, FOOTER)
        tail = struct.pack("<II", SKIPPABLE, len(ends)) + ends + struct.pack("<II", SEEK, len(seek)) + seek
        self.out.write(tail)
        self.bytes += len(tail)


class FileReader:
    """Reads one file by its seek table; ``source`` can seek."""

    def __init__(self, source):
        import zstandard

        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        size = source.seek(0, 2) or source.tell()
        source.seek(size - 9)
        frames, _, footer = struct.unpack("<IBI", source.read(9))
        if footer != FOOTER:
            raise ValueError("no seek table at the end of the file")
        source.seek(size - 9 - 12 * frames)
        self.table = list(struct.iter_unpack("<III", source.read(12 * frames)))
        source.seek(size - 9 - 12 * frames - 8 - 16 * frames)
        self.ends = list(struct.iter_unpack("<qq", source.read(16 * frames)))

    def frames_with(self, doc_ids: Iterable[int] | None) -> list[int]:
        if doc_ids is None:
            return list(range(len(self.table)))
        wanted = np.sort(np.fromiter(doc_ids, dtype=np.int64))
        inside = [int(np.searchsorted(wanted, first)) < int(np.searchsorted(wanted, last, "right")) for first, last in self.ends]
        return [i for i, x in enumerate(inside) if x]

    def frame(self, number: int) -> bytes:
        import xxhash

        self.source.seek(sum(e[0] for e in self.table[:number]))
        packed, size, checksum = self.table[number]
        content = self.unpack.decompress(self.source.read(packed), max_output_size=size)
        if len(content) != size or xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != checksum:
            raise ValueError(f"frame {number} doesn't match its checksum")
        return content

    def documents(self, doc_ids: Iterable[int] | None = None) -> Iterator[tuple[int | None, int | None, bytes]]:
        """Document, its first id's place in the file (None if frames are skipped) and its ids."""
        wanted = None if doc_ids is None else set(doc_ids)
        place: int | None = 0
        begun: list[bytes] = []
        for number in self.frames_with(wanted):
            content = self.frame(number)
            (n,) = struct.unpack_from("<I", content)
            at = 4 + n * PIECE.size
            for doc_id, flags, count in PIECE.iter_unpack(content[4:at]):
                begun = begun if flags & BEGAN else []
                begun.append(content[at : at + 4 * count])
                at += 4 * count
                if not flags & GOES_ON:
                    ids = b"".join(begun)
                    name = None if flags & NULL_ID else doc_id
                    if wanted is None or name in wanted:
                        yield name, place if wanted is None else None, ids
                    place += len(ids) // 4
                    begun = []


def write_documents(documents: DataFrame, folder: str | None = None, tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """Encode every text and write the ids in ascending document order; the manifest of the files.

    The texts are range partitioned by document, so files follow each other in document order
    and no task holds more than its range. A file that a failed attempt left isn't in the
    manifest and so is never read.
    """
    spark = documents.sparkSession
    prepare(spark)
    tokenizer = tokenizer or default_tokenizer()
    folder = qualified(folder or shared_folder(spark, "token-ids"))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")
    end = np.array([end_id], dtype="<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        files, root = open_folder(folder)
        writer = stream = None
        path = f"{root}/{uuid.uuid4().hex}.ids.zst"
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                files.create_dir(root, recursive=True)
                stream = files.open_output_stream(path, compression=None)
                writer = FileWriter(stream)
            names = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(names, encoder(tokenizer).encode_column(batch.column("text")), strict=True):
                writer.add(doc_id, ids + end)
        if writer is not None:
            writer.close()
            stream.close()
            uri = folder.rstrip("/") + "/" + path.rpartition("/")[2]
            row = TaskContext.get().partitionId(), uri, writer.documents, writer.ids, len(writer.table), writer.bytes
            yield from in_batches([row], _MANIFEST)

    return save(ordered.mapInArrow(write, MANIFEST))


def read_documents(spark: SparkSession, manifest: DataFrame, doc_ids: Iterable[int] | None = None) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of all documents, or of some, reading only frames that may hold them.

    ``start`` counts the ids of all documents before; it is null when only some are asked for.
    """
    prepare(spark)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    files = save(manifest.withColumn("base", before).select("path", "base"))  # one row per file
    wanted = None if doc_ids is None else list(doc_ids)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for path, base in columns_of(batches, "path", "base"):
                system, place = open_folder(path)
                with system.open_input_file(place) as source:
                    for doc_id, start, ids in FileReader(source).documents(wanted):
                        yield doc_id, None if start is None else base + start, len(ids) // 4, ids

        yield from in_batches(rows(), _READ, weigh=lambda row: len(row[3]))

    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return files.repartition(spread).mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def digest(read: DataFrame) -> DataFrame:
    return read.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
