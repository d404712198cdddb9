"""Target-distribution importance resampling on hashed n-grams, by prefix CRCs.

A document is normalised to its words joined by one space and scanned once. The scan keeps
the running CRC-32 before and after each word. As CRCs are linear over GF(2), the CRC of any
run of words follows from two of these: with ``A`` what precedes the run ``B``,
``crc(B) = crc(AB) ^ shift(crc(A), len(B))``, where ``shift`` appends zero bytes. So runs of
every length are hashed without touching the text again. A run's CRC modulo the number of
buckets is its feature.

Buckets are counted over all documents and over the target's texts. A bucket's gain is the
floor of a thousand times the logarithm of its smoothed share in the target by its share in the
documents; a document's weight is the sum over its features. Weights plus hashed Gumbel noise
rank the documents, so that the highest ones are a draw without replacement in proportion to
the exponentials of their weights.

Bounds: a task holds one flush of words and one count per bucket; the driver holds one gain
per bucket and one row count per partition. Feature lists are written once, beside the ids.

Defined results: a null or empty text has no features and weight 0; repeated rows are rows of
their own, with the same score; equal scores go by the smaller doc_id, null ids last, repeated
rows in any order; a null id counts as empty in the noise; an empty table gives no rows; an
empty target has even shares; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, prepare, save

BUCKETS = 10_000
LONGEST = 1  # words in the longest run
LEAST_WORDS = 20
PERCENT = 10
SEED = "2024"
#: Bytes of text that are split into words at once, and words that are hashed at once.
BLOCK, FLUSH = 1 << 20, 1 << 18

FEATURES = "doc_id long, n_words long, n_features long, buckets binary"


# --- CRC-32 over GF(2) -----------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    """The register after one more byte, for each low byte of it."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> 1) ^ (np.uint32(0xEDB88320) * (table & 1))
    return table


def _apply(operator: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """A linear operator, given by its value for each byte at each of the four places."""
    return operator[0][crcs & 255] ^ operator[1][crcs >> 8 & 255] ^ operator[2][crcs >> 16 & 255] ^ operator[3][crcs >> 24]


def _zero_bytes() -> Iterator[np.ndarray]:
    """Operators that append 1, 2, 4, 8, ... zero bytes."""
    table, low = _byte_table(), np.arange(256, dtype=np.uint32)
    values = np.stack([low << np.uint32(8 * k) for k in range(4)])
    operator = table[values & 255] ^ (values >> 8)
    while True:
        yield operator
        operator = _apply(operator, operator)


_powers: list[np.ndarray] = []
_more = _zero_bytes()


def shift(crcs: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each CRC after as many zero bytes as its length says, by the binary digits of the length."""
    out, bit = crcs.astype(np.uint32), 0
    while (lengths >> bit).any():
        if bit == len(_powers):
            _powers.append(next(_more))
        odd = np.flatnonzero(lengths >> bit & 1)
        out[odd] = _apply(_powers[bit], out[odd])
        bit += 1
    return out


# --- words and features ------------------------------------------------------------------------

# Letters A to Z in lower case; every other ASCII character that isn't a letter or a digit is a space.
_NORMAL = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def word_blocks(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text in blocks, so that a long text isn't split as a whole."""
    data = (text or "").encode().translate(_NORMAL)
    at = 0
    while at < len(data):
        end = at + BLOCK
        if end < len(data):
            space = data.rfind(b" ", at, end)
            end = space if space > at else data.find(b" ", end)
            end = len(data) if end < 0 else end
        words = data[at:end].split()
        if words:
            yield words
        at = max(end, at + 1)


class Scanner:
    """Feature buckets of a stream of documents, hashed many words at a time.

    ``add`` takes a document and returns finished ``(number, buckets)`` parts of this and earlier
    documents, ``close`` the rest. The last words of a flush stay, as runs may go on.
    """

    def __init__(self, longest: int = LONGEST, buckets: int = BUCKETS):
        self.longest, self.buckets = longest, buckets
        self.kind = "<u2" if buckets <= 1 << 16 else "<u4"
        self.before: list[int] = []  # running CRC before each word, after it, and where the word ends
        self.after: list[int] = []
        self.sizes: list[int] = []
        self.owners: list[tuple[int, int]] = []  # document number and words
        self.carry = [np.zeros(0, dtype=t) for t in (np.uint32, np.uint32, np.int64, np.int64, np.int64)]

    def add(self, number: int, text: str | None) -> tuple[int, list[tuple[int, np.ndarray]]]:
        """Number of words of the document, and what flushes have finished."""
        crc, n, started, done = 0, 0, False, []
        for words in word_blocks(text):
            before, after = self.before.append, self.after.append
            for word in words:
                crc = crc32(b" ", crc) if started else crc
                before(crc)
                crc = crc32(word, crc)
                after(crc)
                started = True
            n += len(words)
            self.sizes.extend(map(len, words))
            self.owners.append((number, len(words)))
            if len(self.before) >= FLUSH:
                done += self.flush()
        return n, done

    def flush(self) -> list[tuple[int, np.ndarray]]:
        if not self.before:
            return []
        number = np.repeat(*np.array(self.owners, dtype=np.int64).T)
        size = np.array(self.sizes, dtype=np.int64)
        # Offsets are only ever subtracted within a document, so they may run on over all of them.
        base = self.carry[3][-1] + 1 if len(self.carry[3]) else 0
        end = base + np.cumsum(size + 1) - 1
        fresh = [np.array(self.before, dtype=np.uint32), np.array(self.after, dtype=np.uint32), end - size, end, number]
        old = len(self.carry[0])
        before, after, start, end, number = (np.concatenate(p) for p in zip(self.carry, fresh, strict=True))
        found, owner = [], []
        for run in range(1, self.longest + 1):
            first = np.arange(max(0, old - run + 1), len(before) - run + 1)
            last = first + run - 1
            same = number[first] == number[last]
            first, last = first[same], last[same]
            found.append((after[last] ^ shift(before[first], end[last] - start[first])) % np.uint32(self.buckets))
            owner.append(number[first])
        keep = self.longest - 1
        self.carry = [a[len(a) - keep :] if keep else a[:0] for a in (before, after, start, end, number)]
        self.before, self.after, self.sizes, self.owners = [], [], [], []
        owner_all, found_all = np.concatenate(owner), np.concatenate(found).astype(self.kind)
        if self.longest > 1:
            order = np.argsort(owner_all, kind="stable")
            owner_all, found_all = owner_all[order], found_all[order]
        cuts = np.flatnonzero(np.diff(owner_all)) + 1
        return [(int(owner_all[a]), found_all[a:b]) for a, b in zip([0, *cuts], [*cuts, len(owner_all)], strict=True) if b > a]


def features(texts: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` of every row of ``doc_id, text``, scanned once.

    ``buckets`` are the features' numbers as little-endian unsigned integers of two bytes, of
    four if there are more than 65 536.
    """
    prepare(texts.sparkSession)
    fields = [("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_features", pa.int64()), ("buckets", pa.binary())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scanner = Scanner(longest, buckets)
            names = batch.column("doc_id")
            parts: list[list[bytes]] = [[] for _ in range(len(names))]
            words = np.zeros(len(names), dtype=np.int64)
            for number, text in enumerate(batch.column("text")):
                words[number], done = scanner.add(number, text.as_py())
                for k, found in done:
                    parts[k].append(found.tobytes())
            for k, found in scanner.flush():
                parts[k].append(found.tobytes())
            data = [b"".join(p) for p in parts]
            n = np.array([len(d) for d in data], dtype=np.int64) // np.dtype(scanner.kind).itemsize
            yield pa.record_batch([names, pa.array(words), pa.array(n), pa.array(data, pa.binary())], schema=pa.schema(fields))
            del scanner, parts, data
            give_back()

    return texts.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(scan, FEATURES)


def _values(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers in a binary column, without a copy, and where each row's begin and the last ends."""
    width = np.dtype(kind).itemsize
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=kind, count=(offsets[-1] - offsets[0]) // width, offset=offsets[0]) if data and offsets[-1] > offsets[0] else np.zeros(0, dtype=kind)
    return whole, (offsets - offsets[0]).astype(np.int64) // width


def bucket_counts(table: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """``bucket, n``: features of all rows; each task adds up its own before the shuffle."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            if len(batch):
                total += np.bincount(_values(batch.column("buckets"), kind)[0], minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return table.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Gain of every bucket from the counts of documents and target, a row per bucket each."""
    counts = np.zeros((2, buckets))
    for side, table in enumerate((source, target)):
        for row in table.collect():
            counts[side, row["bucket"]] = row["n"]
    (s, t), (all_s, all_t) = counts, counts.sum(axis=1)
    return np.floor(1000 * np.log((t + 1) * (all_s + buckets) / ((s + 1) * (all_t + buckets)))).astype(np.int64)


def weights(table: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of the gains of a row's features."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            values, at = _values(batch.column("buckets"), kind)
            sums = np.concatenate([[0], np.cumsum(gain[values])])
            yield pa.record_batch([*(batch.column(c) for c in ("doc_id", "n_words", "n_features")), pa.array(sums[at[1:]] - sums[at[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return table.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")


# --- the draw ------------------------------------------------------------------------------------


def gumbel(doc_id: Column, seed: str = SEED) -> Column:
    """Hashed noise in thousandths, the same for the same id and seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def draw(scored: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """``scored`` with ``rank``: 1, 2, 3 ... of the drawn rows by falling score, null for others.

    The rank is a place in a range-partitioned order plus the rows of the partitions before it,
    so no task sees more than its share, however many scores are equal.
    """
    able = F.col("n_words") >= least_words
    order = [able.desc(), F.desc("score"), F.asc_nulls_last("doc_id")]
    placed = save(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # One row per partition comes to the driver.
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.count(F.when(able, 1)).alias("able")).collect())
    total = sum(r["able"] for r in counts)
    rows, at = [], 0
    for r in counts:
        rows.append((r["part"], at - (r["part"] << 33) + 1))
        at += r["n"]
    firsts = scored.sparkSession.createDataFrame(rows, "part long, first long")
    rank = F.col("place") + F.col("first")
    drawn = F.when(able & (rank <= percent * total // 100), rank)
    return placed.join(F.broadcast(firsts), part == F.col("part")).withColumn("rank", drawn).drop("place", "part", "first")


def resample(
    documents: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST,
    buckets: int = BUCKETS, seed: str = SEED,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of all documents.

    ``documents`` has ``doc_id, text``, ``target`` has ``text``. ``percent`` of the documents
    with ``least_words`` words are drawn; the others have a null rank.
    """
    table = save(features(documents, longest, buckets))
    wanted = features(target.select(F.lit(None).alias("doc_id"), "text"), longest, buckets)
    gain = gains(bucket_counts(table, buckets), bucket_counts(wanted, buckets), buckets)
    scored = weights(table, gain).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    return draw(scored, percent, least_words)


def digest(drawn: DataFrame) -> DataFrame:
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
