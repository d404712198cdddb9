"""Sequence packing as a cutting-stock problem, solved by column generation.

Documents are cut into whole sequences of ``capacity`` tokens and one remainder. Remainders
are counted by length class over all documents: short ones by their exact length, longer ones
in classes that widen up to ``unit`` tokens. This histogram, of fewer than ``capacity / unit`` +
32 ``unit`` rows, is all that the linear programs see, so their size doesn't grow with the
corpus. A pattern says how many pieces of each class fill one sequence. New patterns
are priced by a knapsack dynamic program; fractional pattern counts are rounded down and what
is left over is packed largest first. Long pieces are planned first, short ones fill what room
that leaves, largest first, and a program of their own packs the rest if their classes are few. Pieces are then ranked
within their class, and the rank tells pattern, sequence and slot.

Defined results: a null or empty text is the end id alone; repeated rows are packed once per
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import in_batches, prepare, save
from .tokens import default_tokenizer, encoder

CAPACITY = 4096
#: Width of the widest length class. Pieces of ``EXACT * UNIT`` tokens and more are in classes so
#: wide if twice that long, else half as wide; shorter ones leave nothing unused.
UNIT = 16
EXACT = 16
#: With more classes of short pieces than this, what is left of them is packed largest first: the
#: small ones close the gaps of the others, and the program would take minutes.
PROGRAM_CLASSES = 128
#: The linear program ends when its bound shows that no more than this share can be gained.
GAP = 2e-4

_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
PIECES = "doc_id long, start long, length long, ids binary, ids_crc32 long, doc_tokens long"


# --- linear program ------------------------------------------------------------------------


def best_pattern(values: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: the most valuable multiset of ``sizes`` within ``room``."""
    best = np.zeros(room + 1)
    choice = np.full(room + 1, -1)
    for space in range(1, room + 1):
        n = int(np.searchsorted(sizes, space, "right"))
        best[space] = best[space - 1]
        if n:
            worth = best[space - sizes[:n]] + values[:n]
            k = int(worth.argmax())
            if worth[k] > best[space]:
                best[space], choice[space] = worth[k], k
    counts = np.zeros(len(sizes), dtype=np.int64)
    space = room
    while space > 0:
        k = choice[space]
        if k < 0:
            space -= 1
        else:
            counts[k] += 1
            space -= int(sizes[k])
    return float(best[room]), counts


def cutting_stock(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = GAP) -> list[tuple[np.ndarray, int]]:
    """Patterns and how often each is cut, together covering ``demand`` pieces of each size.

    ``sizes`` ascend. The master program is solved by the revised simplex method with one
    basic pattern per size; each round prices a new pattern by the duals. It ends at the bound,
    or when ties keep the number of sequences as it is for twenty rounds per size.
    """
    if not len(sizes):
        return []
    per = room // sizes
    patterns = [np.where(np.arange(len(sizes)) == i, per[i], 0).astype(np.int64) for i in range(len(sizes))]
    inverse = np.diag(1.0 / per)
    amount = demand / per
    least, since = np.inf, 0
    for number in count():
        since = 0 if amount.sum() < least - 1e-9 else since + 1
        least = min(least, amount.sum())
        if since > 20 * len(sizes):
            break
        duals = np.maximum(inverse.sum(axis=0), 0.0)
        value, column = best_pattern(duals, sizes, room)
        if value <= 1 + 1e-9 or amount.sum() * (1 - 1 / value) <= max(0.5, gap * amount.sum()):
            break
        step = inverse @ column
        usable = step > 1e-9
        if not usable.any():
            break
        ratio = np.where(usable, amount / np.where(usable, step, 1.0), np.inf)
        out = int(ratio.argmin())
        inverse[out] /= step[out]
        others = np.arange(len(sizes)) != out
        inverse[others] -= np.outer(step[others], inverse[out])
        patterns[out] = column
        if number % 200 == 199:  # undo rounding errors by Newton steps: products only, no factorisation
            basis = np.array(patterns, dtype=float).T
            for _ in range(2):
                inverse = inverse @ (2 * np.eye(len(sizes)) - basis @ inverse)
            amount = np.maximum(inverse @ demand, 0.0)
        else:
            amount = np.maximum(amount - ratio[out] * step, 0.0)
            amount[out] = ratio[out]
    cut = [(p, int(x + 1e-6)) for p, x in zip(patterns, amount, strict=True) if x + 1e-6 >= 1]
    left = demand - sum((p * x for p, x in cut), np.zeros(len(sizes), dtype=np.int64))
    return cut + _largest_first(sizes, np.maximum(left, 0), room)


def _largest_first(sizes: np.ndarray, left: np.ndarray, room: int) -> list[tuple[np.ndarray, int]]:
    """Fill one sequence after the other with the largest sizes that fit."""
    left, out = left.copy(), []
    while left.any():
        space, counts = room, np.zeros(len(sizes), dtype=np.int64)
        for k in np.flatnonzero(left)[::-1]:
            n = min(int(left[k]), space // int(sizes[k]))
            counts[k] += n
            space -= n * int(sizes[k])
        times = max(1, int((left[counts > 0] // counts[counts > 0]).min()))
        left -= counts * times
        out.append((counts, times))
    return out


def _fill(plan: list[tuple[np.ndarray, int]], sizes: np.ndarray, left: np.ndarray, room: int) -> tuple[list[tuple[np.ndarray, int]], np.ndarray]:
    """The plan with pieces of ``left`` in the room of its patterns, largest first, and what is left then."""
    left, out = left.copy(), []
    for counts, times in plan:
        while times:
            space, more = room - int(counts @ sizes), np.zeros(len(sizes), dtype=np.int64)
            for k in np.flatnonzero(left)[::-1]:
                n = min(int(left[k]), space // int(sizes[k]))
                more[k] += n
                space -= n * int(sizes[k])
            used = more > 0
            some = min(times, int((left[used] // more[used]).min())) if used.any() else times
            left -= more * some
            times -= some
            out.append((counts + more, some))
    return out, left


def plan_of(sizes: np.ndarray, demand: np.ndarray, capacity: int, unit: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over all length classes, and how often each is cut."""
    long = sizes >= 2 * EXACT * unit

    def program(part: np.ndarray, wanted: np.ndarray, step: int) -> list[tuple[np.ndarray, int]]:
        out = []
        solve = cutting_stock if part is long or part.sum() <= PROGRAM_CLASSES else _largest_first
        for counts, times in solve(sizes[part] // step, wanted[part], capacity // step):
            whole = np.zeros(len(sizes), dtype=np.int64)
            whole[part] = counts
            out.append((whole, times))
        return out

    plan, left = _fill(program(long, demand, unit), sizes, np.where(long, 0, demand), capacity)
    return plan + program(left > 0, left, 1)


# --- pieces, ranks and places --------------------------------------------------------------


def cut_documents(documents: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Pieces of every document with their ids: whole sequences, then the remainder."""
    prepare(documents.sparkSession)
    tokenizer = tokenizer or default_tokenizer()
    end = np.array([end_id], dtype="<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                names = batch.column("doc_id").to_pylist()
                for doc_id, ids in zip(names, encoder(tokenizer).encode_column(batch.column("text")), strict=True):
                    ids += end
                    total = len(ids) // 4
                    for start in range(0, total, capacity):
                        piece = ids[4 * start : 4 * (start + capacity)]
                        yield doc_id, start, len(piece) // 4, piece, zlib.crc32(piece), total

        yield from in_batches(rows(), _PIECES, weigh=lambda row: len(row[3]))

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


def class_of(length: Column, unit: int) -> Column:
    """The length that pieces of a class count as."""
    def up(width: int) -> Column:
        return (F.ceil(length / width) * width).cast("int")

    return F.when(length < EXACT * unit, length.cast("int")).when(length < 2 * EXACT * unit, up(max(1, unit // 2))).otherwise(up(unit))


def ranked(pieces: DataFrame, unit: int) -> DataFrame:
    """``pieces`` with ``size`` (length class) and ``rank`` from 0 within the class.

    The rank is the place in a range-partitioned order, less where the class begins. So no
    task holds a class as a whole, however many pieces have the same length.
    """
    keys = ["size", "doc_id", "start", "ids_crc32"]
    spread = pieces.withColumn("size", class_of(F.col("length"), unit)).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = save(spread.withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    # At most one row per partition and class that meet: partitions plus classes in all.
    runs = placed.groupBy(part.alias("part"), "size").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    runs = runs.withColumn("before", before).select("part", F.col("size").alias("class"), "first", "before")
    joined = placed.join(F.broadcast(runs), (part == F.col("part")) & (F.col("size") == F.col("class")))
    return joined.withColumn("rank", F.col("place") - F.col("first") + F.col("before")).drop("place", "part", "class", "first", "before")


def place(ranks: DataFrame, plan: list[tuple[np.ndarray, int]], sizes: np.ndarray) -> DataFrame:
    """``ranks`` with the ``sequence_id`` that the plan gives to each rank."""
    spans: dict[int, list[tuple[int, int, int]]] = {int(s): [] for s in sizes}  # first rank, pieces per sequence, first sequence
    taken = dict.fromkeys(spans, 0)
    sequence = 0
    for counts, times in plan:
        for k in np.flatnonzero(counts):
            size = int(sizes[k])
            spans[size].append((taken[size], int(counts[k]), sequence))
            taken[size] += int(counts[k]) * times
        sequence += times
    tables = {size: np.array(rows, dtype=np.int64).T for size, rows in spans.items() if rows}

    @F.pandas_udf("long")
    def sequence_of(size, rank):
        out = np.zeros(len(size), dtype=np.int64)
        sizes_here, ranks_here = size.to_numpy(), rank.to_numpy()
        for one in np.unique(sizes_here):
            first, per, base = tables[int(one)]
            mine = sizes_here == one
            k = np.searchsorted(first, ranks_here[mine], "right") - 1
            out[mine] = base[k] + (ranks_here[mine] - first[k]) // per[k]
        return type(size)(out)

    return ranks.withColumn("sequence_id", sequence_of("size", "rank"))


def pack(pieces: DataFrame, capacity: int = CAPACITY, unit: int = UNIT) -> DataFrame:
    """Sequence and offset of every piece; ``pieces`` should be a table, as it is read twice.

    Driver work is bounded by the number of length classes. Pieces of one sequence stand
    largest first; there are at most ``capacity`` of them.
    """
    narrow = pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens")
    ranks = ranked(narrow, unit)
    histogram = sorted((r["size"], r["n"]) for r in ranks.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())
    sizes = np.array([s for s, _ in histogram], dtype=np.int64)
    demand = np.array([n for _, n in histogram], dtype=np.int64)
    placed = place(ranks, plan_of(sizes, demand, capacity, unit), sizes)
    order = Window.partitionBy("sequence_id").orderBy(F.desc("size"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0))
    return placed.withColumn("offset", offset).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def sequences(pieces: DataFrame, places: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """``sequence_id, used, ids`` with the ids of each sequence, padded to ``capacity``.

    A sequence whose length is a power of two isn't padded.
    """
    keys = ["doc_id", "start", "ids_crc32"]
    both = pieces.select(*keys, "ids").join(places.dropDuplicates([*keys, "sequence_id", "offset"]), keys)
    pad = np.array([pad_id], dtype="<u4").tobytes()
    rows = both.groupBy("sequence_id").agg(F.sum("length").alias("used"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("pieces"))

    @F.pandas_udf("binary")
    def joined(parts, used):
        out = []
        for row, n in zip(parts, used, strict=True):
            ids = b"".join(p["ids"] for p in row)
            out.append(ids if n & (n - 1) == 0 else ids + pad * (capacity - n))
        return type(parts)(out)

    return rows.select("sequence_id", "used", joined("pieces", "used").alias("ids"))


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, unit: int = UNIT, tokenizer: str | None = None, end_id: int = 2) -> tuple[DataFrame, DataFrame]:
    """Pieces with their ids, as a table, and their places."""
    pieces = save(cut_documents(documents, capacity, tokenizer, end_id))
    return pieces, pack(pieces, capacity, unit)
