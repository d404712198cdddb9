"""Benchmark decontamination by Wu-Manber search over words.

The symbols of the search are words, so a pattern is a window of words. For every window
length there is one table: ``shift`` tells for a block of two words how far the search may
move on, ``bucket`` lists the windows by their last block, further divided by their first
block. A candidate is confirmed by comparing all of its words.

Texts are lower-cased in A-Z; a word is a run of ASCII letters, digits and characters
beyond ASCII. Defined results: a null or wordless text has no words and no hits; a null or
wordless item has no windows; an item without id counts for hits, but is in no list of items;
items that share a window are all reported; repeated rows are reported once per row; other
columns of the inputs are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, give_back, in_batches, prepare, save

WINDOW = 10
#: Windows that are searched in one pass; a larger benchmark takes several passes, so that no
#: broadcast grows with it.
WINDOWS_PER_PASS = 400_000

_SPACE = [*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]
_FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else 0x20 if c in _SPACE else c for c in range(256))

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("item_ids", pa.list_(pa.string()))])
DDL = "doc_id long, n_words long, hits array<struct<start: long, end: long>>, item_ids array<string>"


def words_of(text: str | None) -> list[bytes]:
    return [] if text is None else text.encode("utf-8", "surrogatepass").translate(_FOLD).split()


class WuManber:
    """Search tables of windows that all have ``length`` words."""

    def __init__(self, length: int, windows: dict[tuple, list[str]]):
        self.length, self.block = length, min(2, length)
        self.windows = windows
        self.shift: dict = {}
        self.bucket: dict = {}
        for window in windows:
            for end in range(self.block, length + 1):
                key, room = window[end - self.block : end], length - end
                if room < self.shift.get(key, length):
                    self.shift[key] = room
            last, first = window[length - self.block :], window[: self.block]
            self.bucket.setdefault(last, {}).setdefault(first, []).append(window)

    def find(self, words: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """Start and item ids of every occurrence, from left to right."""
        length, block, n = self.length, self.block, len(words)
        skip, shift, bucket, windows = length - block + 1, self.shift.get, self.bucket, self.windows
        end = length
        while end <= n:
            key = tuple(words[end - block : end])
            step = shift(key, skip)
            if step:
                end += step
                continue
            start = end - length
            for window in bucket[key].get(tuple(words[start : start + block]), ()):
                if tuple(words[start:end]) == window:
                    yield start, windows[window]
            end += 1


def search(words: list[bytes], tables: list[WuManber]) -> tuple[list[tuple[int, int]], set[str]]:
    """Disjoint word ranges covered by occurrences, and the items that occur."""
    found: list[tuple[int, int]] = []
    items: set[str] = set()
    for table in tables:
        for start, names in table.find(words):
            found.append((start, start + table.length))
            items.update(names)
    return merged(found), items


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _passes(benchmark: DataFrame, window: int, limit: int) -> Iterator[dict[int, dict[tuple, list[str]]]]:
    """The windows by length, in parts of at most ``limit`` windows; items come one by one, and a
    long one may go on in the next part."""
    part: dict[int, dict[tuple, list[str]]] = {}
    size = 0
    for row in benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null").toLocalIterator():
        words = words_of(row["text"])
        length = min(window, len(words))
        for start in range(len(words) - length + 1 if length else 0):
            names = part.setdefault(length, {}).setdefault(tuple(words[start : start + length]), [])
            if row["item_id"] is not None and row["item_id"] not in names:
                names.append(row["item_id"])
            size += 1
            if size >= limit:
                yield part
                part, size = {}, 0
    yield part


def find_passages(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """Per document: ``doc_id, n_words, hits`` (disjoint ranges of word positions), ``item_ids``.

    The benchmark is a stated query set: all documents are searched for all of it, in passes of
    bounded size. One scan of the documents per pass and, with one pass, no shuffle at all.
    """
    spark = documents.sparkSession
    prepare(spark)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(rows_in: DataFrame, windows: dict[int, dict[tuple, list[str]]], keep_text: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(windows)
        before = "hits" in rows_in.columns
        schema = SCHEMA.append(pa.field("text", pa.string())) if keep_text else SCHEMA

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tables = [WuManber(length, found) for length, found in sorted(shared.value.items())]

            def rows():
                for doc_id, text, *earlier in columns_of(batches, "doc_id", "text", *(["hits", "item_ids"] if before else [])):
                    words = words_of(text)
                    ranges, items = search(words, tables)
                    if before:
                        ranges = merged(ranges + [(hit["start"], hit["end"]) for hit in earlier[0]])
                        items.update(earlier[1])
                    row = doc_id, len(words), [{"start": a, "end": b} for a, b in ranges], sorted(items)
                    yield (*row, text) if keep_text else row

            yield from in_batches(rows(), schema, 2_000 if keep_text else 20_000)

        return rows_in.mapInArrow(scan, DDL + (", text string" if keep_text else ""))

    parts = _passes(benchmark, window, per_pass)
    part = next(parts)
    for following in parts:
        texts, part = save(run(texts, part, True)), following
    return run(texts, part, False)


def digest(found: DataFrame) -> DataFrame:
    """Counts and item digest of what ``find_passages`` returns."""
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, hit: total + hit["end"] - hit["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def keep_clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, per_pass: int = WINDOWS_PER_PASS) -> DataFrame:
    """The documents, with their own columns, that hold no window of the benchmark.

    One scan per pass over what the passes before it kept, and no shuffle.
    """
    spark = documents.sparkSession
    prepare(spark)

    def clean(rows: DataFrame, windows: dict[int, dict[tuple, list[str]]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(windows)
        built: list[list[WuManber]] = []

        @F.pandas_udf("boolean")
        def has_none(text):
            if not built:
                built.append([WuManber(length, found) for length, found in sorted(shared.value.items())])
            found = text.map(lambda t: not any(True for table in built[0] for _ in table.find(words_of(t))))
            give_back()
            return found

        return rows.where(has_none(F.col("text").cast("string")))

    parts = _passes(benchmark, window, per_pass)
    part = next(parts)
    for following in parts:
        documents, part = save(clean(documents, part)), following
    return clean(documents, part)


def sha_of(items: list[str]) -> str:
    """What ``items_sha256`` holds, for tests and readers."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
