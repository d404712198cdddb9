"""Near-duplicate groups by an n-gram Jaccard join with prefix filtering.

A document's set holds its distinct five-word shingles as 64-bit hashes. All sets are put in
one order, rare shingles first: by a table of counters that sums the shingles of all documents,
then by hash. Two sets with a Jaccard similarity of at least 80 % share a shingle among their
first ``n - ceil(0.8 n) + 1``, so only this prefix is joined on. Pairs that meet there pass
the length filter, the positional filter (what can still follow the shared shingle) and the
suffix filter (shingles counted in cells by hash: no more can be shared than the smaller count of
each cell), and are then verified once, on the whole texts.

Groups are what is asked for, so a list of documents that share a shingle isn't expanded into
all its pairs. Each list is first compared with one member, the one with the fewest rarer
shingles before the shared one (an original stands before its edited copies). Lists whose
documents then belong to one group need nothing more. Other lists are joined in full, but
only across groups, until no pair is left; so no link between groups is lost.

Defined results: null, empty and wordless texts have an empty set and are linked with nothing;
a text of fewer than five words is one shingle; rows that share a ``doc_id`` are one document
for linking (each row is returned with its own set size); a null ``doc_id`` is linked with
nothing and has a null component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import columns_of, give_back, in_batches, prepare, save
from .components import connected_components

WORDS = 5
PERCENT = 80
#: Counters of the table that orders shingles by frequency; one byte each is broadcast.
COUNTERS = 1 << 22
BLOCK = 1 << 12
CELLS = 64
BITS = 1 << 23
#: Documents that one task compares with one other document.
PER_GROUP = 256

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)

_PROFILE = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("cells", pa.binary()), ("block", pa.int32()), ("counts", pa.binary())])
_POSTING = pa.schema([("shingle", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
POSTING = "shingle long, doc_id long, n int, pos int"


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _byte_hashes(keys: np.ndarray) -> np.ndarray:
    return _mixed((keys.astype(np.uint64) + np.uint64(1)) * _FACTORS[0])


_SOLID = np.ones(256, dtype=bool)
_SOLID[[0x20, *range(0x09, 0x0E)]] = False
#: Bytes of a word whose hashes are looked up; longer words have theirs computed.
PLACES = 64
_TABLE = _byte_hashes(np.arange(PLACES * 256))
#: Bytes of words that are hashed at a time, which bounds the memory that a long text takes.
RUN = 1 << 20


def word_codes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words, in order: the sum of a hash of each byte and its place in the word."""
    data = np.frombuffer(b" %b " % text, dtype=np.uint8)
    solid = _SOLID[data]
    edges = np.flatnonzero(solid[1:] != solid[:-1]) + 1
    begins, ends = edges[::2], edges[1::2]
    codes = np.empty(len(begins), dtype=np.uint64)
    if not len(begins):
        return codes
    lengths = ends - begins
    first = np.cumsum(lengths) - lengths
    runs = [0, len(first)] if first[-1] < RUN else np.unique([*np.searchsorted(first, np.arange(0, first[-1] + 1, RUN)), len(first)])
    for low, high in zip(runs[:-1], runs[1:], strict=True):
        size, at, part = lengths[low:high], first[low:high] - first[low], slice(begins[low], ends[high - 1])
        keys = np.arange(size.sum()) - np.repeat(at, size)
        keys *= 256
        keys += data[part][solid[part]]
        codes[low:high] = np.add.reduceat(_TABLE[keys] if size.max() <= PLACES else _byte_hashes(keys), at)
    return codes


def shingles(text: str | None) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    codes = word_codes(b"" if text is None else text.encode("utf-8", "surrogatepass").translate(_LOWER))
    if not len(codes):
        return codes
    width = min(WORDS, len(codes))
    total = np.full(len(codes) - width + 1, width, dtype=np.uint64)
    for k in range(width):
        total += codes[k : len(codes) - width + 1 + k] * _FACTORS[k]
    total = np.sort(_mixed(total))
    return total[np.concatenate(([True], total[1:] != total[:-1]))]


def least_overlap(a: np.ndarray | int, b: np.ndarray | int):
    """Shared shingles that sets of sizes ``a`` and ``b`` need: 100 i >= 80 (a + b - i)."""
    return -(-PERCENT * (a + b) // (100 + PERCENT))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1 if n else 0


# --- counting ------------------------------------------------------------------------------


def profiled(documents: DataFrame) -> DataFrame:
    """Rows ``doc_id, n, cells`` of all documents, and the tasks' counters as rows ``block, counts``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(COUNTERS, dtype=np.uint32)

        def rows():
            for doc_id, text in columns_of(batches, "doc_id", "text"):
                found = shingles(text)
                np.add.at(table, (found >> np.uint64(64 - 22)).astype(np.int64), 1)
                yield doc_id, len(found), cells_of(found).tobytes() if len(found) else None, None, None

        def blocks():
            if table.any():
                for block in range(COUNTERS // BLOCK):
                    yield None, None, None, block, np.minimum(table[block * BLOCK : (block + 1) * BLOCK], 65535).astype("<u2").tobytes()

        yield from in_batches(rows(), _PROFILE)
        yield from in_batches(blocks(), _PROFILE, 256)

    return documents.mapInArrow(scan, "doc_id long, n long, cells binary, block int, counts binary")


def frequency_ranks(profile: DataFrame) -> np.ndarray:
    """One byte per counter: eight steps for each doubling of the count over all documents.

    Counters are added within groups of tasks first and then over the groups, so no task gathers
    the counters of all tasks; the driver gets ``COUNTERS`` bytes.
    """

    def added(rows: DataFrame, keys: list[str], last: bool) -> DataFrame:
        def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(BLOCK, dtype=np.int64)
            for batch in batches:
                for counts in batch.column("counts").to_pylist():
                    total += np.frombuffer(counts, dtype="<i8" if last else "<u2")
            out = np.minimum(8 * np.log2(1 + total), 255).astype(np.uint8) if last else total.astype("<i8")
            yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["block", "counts"])

        return rows.groupBy(*keys).applyInArrow(add, "block int, counts binary")

    counts = profile.where("block is not null").select("block", "counts", (F.spark_partition_id() % 32).alias("team"))
    ranks = np.zeros(COUNTERS, dtype=np.uint8)
    for r in added(added(counts, ["block", "team"], False), ["block"], True).toLocalIterator():
        ranks[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["counts"], dtype=np.uint8)
    return ranks


def postings(documents: DataFrame, ranks: np.ndarray) -> DataFrame:
    """The prefix of every set: ``shingle, doc_id, n, pos``."""
    shared = documents.sparkSession.sparkContext.broadcast(ranks)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, names, sizes, places = [], [], [], []
            for doc_id, text in columns_of(iter([batch]), "doc_id", "text"):
                codes = shingles(text)
                take = prefix_length(len(codes))
                if doc_id is None or not take:
                    continue
                rank = shared.value[(codes >> np.uint64(64 - 22)).astype(np.int64)]
                first = codes[np.argsort(rank, kind="stable")[:take]]  # codes ascend, so ties go by hash
                found.append(first.view(np.int64))
                names.append(np.full(take, doc_id))
                sizes.append(np.full(take, len(codes), dtype=np.int32))
                places.append(np.arange(take, dtype=np.int32))
            if found:
                columns = [np.concatenate(x) for x in (found, names, sizes, places)]
                whole = pa.record_batch([pa.array(c) for c in columns], schema=_POSTING)
                for at in range(0, whole.num_rows, 100_000):
                    yield whole.slice(at, 100_000)
            del found, names, sizes, places
            give_back()

    return documents.mapInArrow(scan, POSTING)


# --- candidates and links ------------------------------------------------------------------


def shared_lists(rows: DataFrame) -> DataFrame:
    """Prefix rows whose shingle stands in the prefix of another document too.

    A first pass counts 32-bit hash values, which takes little shuffling as the counts are
    summed before it; only rows whose value occurs twice go on to the second shuffle.
    ``rows`` is read twice, so it should be a saved table: shingling costs most of the time.
    """
    short = rows.withColumn("short", F.shiftright("shingle", 32).cast("int"))
    twice = short.groupBy("short").agg(F.count(F.lit(1)).alias("times")).where("times > 1").select("short")
    return short.join(twice, "short", "left_semi").drop("short")


def passes(a_n, a_pos, b_n, b_pos):
    """Length and positional filter of two rows of one list."""
    small, large = F.least(a_n, b_n), F.greatest(a_n, b_n)
    need = F.ceil(PERCENT * (a_n + b_n) / F.lit(float(100 + PERCENT)) - F.lit(1e-9))
    return (100 * small >= PERCENT * large) & (1 + F.least(a_n - a_pos - 1, b_n - b_pos - 1) >= need)


def stars(lists: DataFrame) -> DataFrame:
    """All rows of lists but the first member's, with that member and the list's size."""
    first = lists.groupBy("shingle").agg(F.min(F.struct("pos", "doc_id", "n")).alias("first"), F.count(F.lit(1)).alias("size")).where("size > 1")
    return lists.join(first, "shingle").where(F.col("doc_id") != F.col("first.doc_id"))


def star_pairs(rows: DataFrame) -> DataFrame:
    """Every document of a list with the list's first member, once per pair."""
    kept = rows.where(passes(F.col("n"), F.col("pos"), F.col("first.n"), F.col("first.pos")))
    return kept.select(F.col("first.doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def crossing_pairs(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs of one list, without its first member, whose documents are in different groups.

    A list of two documents has no such pair: the star has compared them.
    """
    rest = rows.where("size > 2").select("shingle", "doc_id", "n", "pos")
    named = rest.join(groups.select("doc_id", "component"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
    mixed = named.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("shingle")
    open_lists = save(named.join(mixed, "shingle", "left_semi"))
    left = open_lists.select("shingle", *(F.col(c).alias(f"l_{c}") for c in ("doc_id", "n", "pos", "component")))
    pairs = left.join(open_lists, "shingle").where((F.col("l_doc_id") < F.col("doc_id")) & (F.col("l_component") != F.col("component")))
    pairs = pairs.where(passes(F.col("l_n"), F.col("l_pos"), F.col("n"), F.col("pos")))
    return pairs.select(F.col("l_doc_id").alias("a"), F.col("doc_id").alias("b")).distinct()


def suffix_filtered(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Pairs whose cell counts allow enough shared shingles; ids and counts are all that is joined.

    An id with several rows keeps its pairs if any of its rows allows it.
    """
    cells = profile.where("cells is not null and doc_id is not null").select("doc_id", "cells")
    one, other = (cells.withColumnsRenamed({"doc_id": side, "cells": f"{side}_cells"}) for side in ("a", "b"))

    @F.pandas_udf("boolean")
    def enough(a, b):
        out = []
        for x, y in zip(a, b, strict=True):
            x, y = np.frombuffer(x, dtype="<u4").astype(np.int64), np.frombuffer(y, dtype="<u4").astype(np.int64)
            out.append(int(np.minimum(x, y).sum()) >= least_overlap(int(x.sum()), int(y.sum())))
        return type(a)(out, dtype=bool)

    return pairs.join(one, "a").join(other, "b").where(enough("a_cells", "b_cells")).select("a", "b").distinct()


def cells_of(codes: np.ndarray) -> np.ndarray:
    return np.bincount((codes & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS).astype("<u4")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Length bound, then the exact comparison of two sorted sets."""
    need = least_overlap(len(a), len(b))
    if min(len(a), len(b)) < need:
        return False
    at = np.searchsorted(a, b)
    at[at == len(a)] = 0
    return int((a[at] == b).sum()) >= need


def wanted_only(documents: DataFrame, pairs: DataFrame) -> DataFrame:
    """``documents`` without most of those that stand in no pair, before their texts are shuffled.

    A table of ``BITS`` bits, whatever the number of pairs, says which ids can't be wanted. It
    only saves shuffling: what it lets pass is joined by id afterwards.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    ids = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).select(bit.alias("bit"))
    words = ids.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    table = np.zeros(BITS // 64, dtype=np.int64)
    found = words.toPandas()
    table[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    shared = documents.sparkSession.sparkContext.broadcast(table)

    @F.pandas_udf("boolean")
    def may_be_wanted(bits):
        at = bits.to_numpy()
        return type(bits)((shared.value[at >> 6] >> (at & 63)) & 1 == 1)

    return documents.where(F.col("doc_id").isNotNull()).where(may_be_wanted(bit))


def verified(pairs: DataFrame, documents: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that are similar.

    Documents to compare with the same ``a`` are dealt out to tasks in lots, so its text is
    sent once per lot and not once per pair, and no lot grows with its number of copies.
    """
    lot = F.pmod(F.xxhash64("b"), F.greatest(F.ceil(F.col("size") / PER_GROUP), F.lit(1)))
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("size"))
    lots = save(pairs.join(sizes, "a").select("a", "b", lot.alias("lot")))
    wanted = lots.select(F.col("b").alias("doc_id"), "a", "lot", F.lit(1).alias("side")).unionByName(
        lots.select(F.col("a").alias("doc_id"), "a", "lot", F.lit(0).alias("side")).distinct()
    )
    rows = wanted_only(documents, lots).join(wanted, "doc_id")
    dealt = rows.repartition("a", "lot").sortWithinPartitions("a", "lot", "side")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            now, sets = None, []
            for doc_id, text, a, lot, side in columns_of(batches, "doc_id", "text", "a", "lot", "side"):
                codes = shingles(text)
                if (a, lot) != now:
                    now, sets = (a, lot), []
                if side == 0:
                    sets.append(codes)
                elif any(similar(x, codes) for x in sets if len(x) and len(codes)):
                    yield a, doc_id

        yield from in_batches(rows(), schema)

    return dealt.mapInArrow(compare, "a long, b long")


def link_groups(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``doc_id, n`` of every row, and ``doc_id, component`` of documents with links."""
    prepare(documents.sparkSession)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = save(profiled(texts))
    rows = save(stars(save(shared_lists(save(postings(texts, frequency_ranks(profile)))))))
    links = save(verified(save(suffix_filtered(star_pairs(rows), profile)), texts).distinct())
    groups = connected_components(links)
    crossing = save(suffix_filtered(crossing_pairs(rows, groups), profile))
    if not crossing.isEmpty():
        more = save(verified(crossing, texts).distinct())
        groups = connected_components(links.unionByName(more))
    return profile.where("block is null").select("doc_id", "n"), groups


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row."""
    sizes, groups = link_groups(documents)
    both = sizes.join(groups, "doc_id", "left")
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame) -> DataFrame:
    """The documents, with their own columns, without all but the first of each group.

    Of rows that share an id, all stay if that id stays; rows with a null id stay.
    """
    _, groups = link_groups(documents)
    gone = groups.where("component < doc_id").select("doc_id")
    return documents.join(gone, "doc_id", "left_anti").select(*documents.columns)
