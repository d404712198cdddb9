"""Lines that repeat across documents, dropped from all but one of them. Column expressions only.

A line's key is the line without white space at its ends and with A to Z in lower case. Keys of
at least ``least_chars`` characters that stand in at least ``least_docs`` documents keep their
lines only in the largest doc_id that holds them.

Lines are written once as 128-bit hashes with document and position. The hashes are
range-partitioned and sorted by document within a hash, so that one pass over a partition sees the
first occurrence, which stays, before the others. The range of a hash isn't split between tasks,
so a hash with more than one in ``HOT`` of all rows leaves beforehand: there are fewer than
``HOT`` of these. They are found by counts per slot of the hash space and then per hash, and are
counted by document before they meet, so no task holds a frequent line as a whole.

What comes back is no text but a bitmap per document: 64 lines a word, a set bit for a kept
line, and words left out that keep all their lines. ``kept_text`` applies it.

Defined results: a null or empty text is one empty line; a null doc_id is smaller than any
other; rows with the same doc_id are one document when documents are counted; repeated rows get
the same bitmap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import save

LEAST_CHARS = 20
LEAST_DOCS = 3
#: A hash with more than one in so many rows is counted by document instead of sorted.
HOT = 1000
SLOTS = 1 << 16
SPACE = " \t\n\x0b\x0c\r"  # [\x20\x09-\x0D]

_HASH = ["hash", "hash2"]
_DOC = ["doc_id", "fingerprint"]


def _lines() -> Column:
    return F.split(F.coalesce("text", F.lit("")), "\n", -1)


def ascii_lower(text: Column) -> Column:
    """A to Z in lower case; ``lower`` is quicker, but also changes other letters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def identified(documents: DataFrame) -> DataFrame:
    """``doc_id, text, fingerprint``; id and fingerprint together tell rows apart."""
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.withColumn("fingerprint", F.xxhash64("text"))


def hashed_lines(documents: DataFrame, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``hash, hash2, doc_id, fingerprint, position`` of every line that is long enough."""
    rows = identified(documents).select(*_DOC, F.posexplode(_lines()).alias("position", "line"))
    key = F.btrim(F.col("line"), F.lit(SPACE))
    keyed = rows.select(*_DOC, "position", key.alias("key")).where(F.char_length("key") >= least_chars)
    lowered = keyed.select(*_DOC, "position", ascii_lower(F.col("key")).alias("key"))
    return lowered.select(F.xxhash64("key").alias("hash"), F.xxhash64(F.lit(1), "key").alias("hash2"), *_DOC, "position")


def frequent(lines: DataFrame) -> DataFrame:
    """``hash, hash2, docs, top``: number of documents and the largest of each hash in more than one of ``HOT`` rows.

    At most ``SLOTS`` counts and fewer than ``HOT`` slots come to the driver.
    """
    slot = F.pmod("hash", F.lit(SLOTS))
    slots = lines.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n")).collect()
    total = sum(r["n"] for r in slots)
    full = [r["slot"] for r in slots if r["n"] * HOT > total]
    by_doc = lines.where(slot.isin(full)).groupBy(*_HASH, "doc_id").agg(F.count(F.lit(1)).alias("n"))
    by_hash = by_doc.groupBy(*_HASH).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("top"))
    return by_hash.where(F.col("n") * HOT > total).select(*_HASH, "docs", "top")


def dropped_lines(lines: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """``doc_id, fingerprint, position`` of the lines to drop; ``lines`` should be a table, as it is read several times."""
    hot = F.broadcast(save(frequent(lines)))  # fewer than HOT rows
    rare = lines.join(hot.select(*_HASH), _HASH, "left_anti")
    newest = Window.partitionBy(*_HASH).orderBy(F.desc_nulls_last("doc_id"))
    streamed = rare.repartitionByRange("hash").withColumn("place", F.dense_rank().over(newest))
    streamed = streamed.withColumn("docs", F.max("place").over(Window.partitionBy(*_HASH)))
    cold = streamed.where((F.col("docs") >= least_docs) & (F.col("place") > 1)).select(*_DOC, "position")
    common = lines.join(hot, _HASH).where((F.col("docs") >= least_docs) & ~F.col("doc_id").eqNullSafe(F.col("top")))
    return cold.unionByName(common.select(*_DOC, "position"))


def bitmaps(dropped: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, n_dropped, keep``: words of 64 lines as ``struct<word, bits>``, only those that lose lines."""
    bit = F.expr("shiftleft(1L, position % 64)")
    words = dropped.groupBy(*_DOC, F.expr("position div 64").cast("int").alias("word")).agg(F.bit_or(bit).alias("lost"))
    entry = F.struct("word", F.bitwise_not("lost").alias("bits"))
    return words.groupBy(*_DOC).agg(F.sum(F.bit_count("lost")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(entry)).alias("keep"))


def keep_maps(documents: DataFrame, least_chars: int = LEAST_CHARS, least_docs: int = LEAST_DOCS) -> DataFrame:
    """Bitmaps of the documents that lose lines; all others keep all."""
    return save(bitmaps(dropped_lines(save(hashed_lines(documents, least_chars)), least_docs)))


def _kept_positions() -> Column:
    def lost(entry: Column) -> Column:
        bits = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(entry["bits"], b) == 0)
        return F.transform(bits, lambda b: entry["word"] * 64 + b)

    every = F.sequence(F.lit(0), F.size("lines") - 1)
    return F.array_except(every, F.flatten(F.transform("keep", lost)))  # by hashing, so linear


def kept_text(documents: DataFrame, maps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, text`` of every row, with the lines that its bitmap keeps.

    Bitmaps grow with the documents, so the two always meet by a shuffle.
    """
    rows, given = identified(documents).alias("d"), maps.hint("merge").alias("m")
    same = F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d.fingerprint") == F.col("m.fingerprint"))
    joined = rows.join(given, same, "left").select("d.doc_id", "d.text", "m.n_dropped", "m.keep").withColumn("lines", _lines())
    kept = F.array_join(F.transform(_kept_positions(), lambda i: F.get("lines", i)), "\n")
    return joined.select(
        "doc_id", F.size("lines").cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("n_dropped"),
        F.when(F.col("keep").isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text"),
    )


def digest(texts: DataFrame) -> DataFrame:
    return texts.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
