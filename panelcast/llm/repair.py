"""Cheapest repair of a conversation's structure, by Knuth's lightest-derivation agenda.

A sound conversation has the role initials ``(s?(ua)+)?``. Rows may be kept, given another role
(user or assistant) or deleted, and empty user or assistant messages may be inserted. Blank rows and
repeated ones must go; keeping a truncated row costs one more.

An item ``[entry, i, state]`` says that ``i`` rows are read and the grammar went from ``entry`` to ``state``;
its weight is ``(cost, audit)``, where the audit holds the edits' initials. A deduction joins an
item with a row (weight nothing) or with nothing (an insertion) and appends an edit. Two derivations of the
same item of equal cost are never prefixes of one another, as the letters other than ``I`` number
``i`` in both and an ``I`` has a price; so appending keeps their order, weights never fall, and an
item popped from the agenda is final. A span ends when its goal items are.

Conversations may be longer than a task can hold. Rows get a place in a range-partitioned
order; a conversation is cut at every ``BLOCK`` places, and each span is solved by itself, from
all states where it may be a later one. Spans are then joined in order by the same deduction, one
conversation after the other in a stream. The repaired text is hashed by span; only texts of cut
conversations go on, in chunks of bounded size, to a stream that hashes them in order.

Defined results: a null role or text is one space, a null id or turn is one space where rows are
hashed; an empty role can't be kept; null turns come first; rows of one turn go by role, the text's first 64 characters and its
SHA-256; a null conv_id is a conversation; one without rows left has zeros, an empty audit and the
hash of nothing; repeated rows are duplicates; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterable, Iterator
from itertools import groupby
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import columns_of, in_batches, prepare, save

BLOCK = 1024  # places per span at most
CHUNK = 1 << 20  # bytes of a cut conversation's repaired text per row
SPACE = " \t\n\x0b\x0c\r"
INITIALS = "suax"  # x: any other role
FAULTS = ["", "blank", "duplicate", "truncated"]
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1

START, SYSTEM, USER, ASSISTANT = range(4)  # what the grammar has read last
ACCEPTED = (START, ASSISTANT)
ROLE = {USER: "user", ASSISTANT: "assistant"}
#: The role that a new message takes after each state, and where an initial leads.
SPOKEN = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
READ = {(START, "s"): SYSTEM, **{(q, "sua"[to - 1]): to for q, to in SPOKEN.items()}}

Path = tuple[int, str]  # cost and audit


# --- damage -----------------------------------------------------------------------------------


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` with rows lost, emptied, cut, doubled or given to the user, by their hash."""
    def blank_if_null(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(" "))

    kind = F.pmod(F.crc32(F.concat(blank_if_null("conv_id"), F.lit(":"), blank_if_null("turn")).cast("binary")), F.lit(20))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        blank_if_null("role").alias("role"), blank_if_null("text").alias("text"), kind.alias("kind"),
    ).where("kind <> 0")
    text = F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("kind") == 3, 2).otherwise(1)
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), times))).select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text")
    )


# --- rows in order and their faults -------------------------------------------------------------


def placed_rows(rows: DataFrame) -> DataFrame:
    """Rows as a table with ``place``, ascending in the order of conversation and turn.

    The last key tells equal rows apart, so that any number of them spreads over partitions.
    """
    keyed = rows.withColumns({"head": F.substring("text", 1, 64), "digest": F.sha2("text", 256), "copy": F.monotonically_increasing_id()})
    order = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "head", "digest", "copy")]
    spread = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return save(spread.select("conv_id", "turn", "role", "text", "digest", F.monotonically_increasing_id().alias("place")))


def spans(placed: DataFrame) -> DataFrame:
    """One row per conversation and block of places: ``codes`` has a letter per row, for initial and fault.

    A repeated row is one whose place isn't the first of its role and text; first places are
    found by a grouping that adds up before the shuffle, and joined by place, which is unique.
    """
    firsts = placed.groupBy("conv_id", "role", "digest").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    core = F.btrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    at = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    fault = F.when(core == "", 1).when(~F.substring(core, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    narrow = placed.select("place", "conv_id", "turn", at.alias("at"), fault.alias("fault")).join(firsts, "place", "left")
    fault = F.when((F.col("fault") != 1) & F.col("first").isNull(), 2).otherwise(F.col("fault"))
    code = F.char(65 + F.col("at") + 4 * fault)
    rows = F.array_sort(F.collect_list(F.struct("place", code.alias("code"))))
    return narrow.groupBy("conv_id", F.expr(f"place div {BLOCK}").alias("block")).agg(
        F.array_join(F.transform(rows, lambda r: r["code"]), "").alias("codes"), F.min("place").alias("start"),
        F.min("turn").alias("low"), F.max("turn").alias("high"), F.size(F.collect_set("turn")).alias("turns"),
    )


# --- the agenda ----------------------------------------------------------------------------------


def decoded(codes: str) -> list[tuple[str, str]]:
    """Initial and fault of each row."""
    return [(INITIALS[(ord(c) - 65) % 4], FAULTS[(ord(c) - 65) // 4]) for c in codes]


def lightest(rows: list[tuple[str, str]], entries: Iterable[int] = (START,)) -> dict[tuple[int, int], Path]:
    """The lightest ``(cost, audit)`` of each ``(entry, state)`` over all rows."""
    n, out = len(rows), {}
    for entry in entries:
        goals = {entry, USER, ASSISTANT}
        if entry == START and any(r == ("s", "") or r == ("s", "truncated") for r in rows):
            goals.add(SYSTEM)
        agenda: list[tuple[int, str, int, int]] = [(0, "", 0, entry)]
        final = set()
        while goals:
            cost, audit, i, state = heapq.heappop(agenda)
            if (i, state) in final:
                continue
            final.add((i, state))
            if i == n and state in goals:
                out[entry, state] = cost, audit
                goals.discard(state)
            spoken = SPOKEN[state]
            deduced = [(cost + INSERT, audit + "I", i, spoken)]
            if i < n:
                initial, fault = rows[i]
                deduced.append((cost + DELETE, audit + "D", i + 1, state))
                if fault in ("", "truncated"):
                    more = cost + (TRUNCATED if fault else 0)
                    deduced.append((more + REROLE, audit + "R", i + 1, spoken))
                    if (state, initial) in READ:
                        deduced.append((more + KEEP, audit + "K", i + 1, READ[state, initial]))
            for item in deduced:
                if item[2:] not in final:
                    heapq.heappush(agenda, item)
    return out


_SPAN = "conv_id long, block long, start long, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, first string, last string, entries array<int>, exits array<int>, costs array<long>, audits array<string>"
_SPAN_ARROW = pa.schema(
    [(c, pa.int64()) for c in ("conv_id", "block", "start", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal")]
    + [("first", pa.string()), ("last", pa.string()), ("entries", pa.list_(pa.int32())), ("exits", pa.list_(pa.int32())), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)


def legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


def solved(spans: DataFrame) -> DataFrame:
    """Counts and lightest paths of every span; only one at the head of a block may go on an earlier one."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for conv, block, codes, start, low, high, turns in columns_of(batches, "conv_id", "block", "codes", "start", "low", "high", "turns"):
            found = decoded(codes)
            entries = range(4) if start % BLOCK == 0 else (START,)
            paths = [(e, q, *path) for (e, q), path in lightest(found, entries).items()]
            faults = [f for _, f in found]
            illegal = sum(not legal(a + b) for (a, _), (b, _) in zip(found, found[1:], strict=False))
            counts = (faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal)
            yield (conv, block, start, low, high, turns, *counts, found[0][0], found[-1][0], *map(list, zip(*paths, strict=True)))

    return spans.mapInArrow(lambda batches: in_batches(rows(batches), _SPAN_ARROW, 2000), _SPAN)


class Joined:
    """The lightest paths over the spans of one conversation so far.

    What all paths have in common at their beginning is set aside, so that only the ends where they
    differ are compared. ``chains`` lead back to each span's entry and audit.
    """

    def __init__(self):
        self.sure: list[str] = []
        self.ends: dict[int, Path] = {START: (0, "")}
        self.chains: dict[int, tuple | None] = {START: None}

    def add(self, span: int, paths: Iterable[tuple[int, int, int, str]]) -> None:
        best: dict[int, tuple[int, str, int, str]] = {}
        for entry, state, cost, audit in paths:
            if entry in self.ends:
                before, end = self.ends[entry]
                new = (before + cost, end + audit, entry, audit)
                best[state] = min(best.get(state, new), new)
        self.chains = {q: (self.chains[e], span, e, audit) for q, (_, _, e, audit) in best.items()}
        common = commonprefix([end for _, end, _, _ in best.values()])
        self.sure.append(common)
        self.ends = {q: (cost, end[len(common) :]) for q, (cost, end, _, _) in best.items()}

    def goal(self) -> tuple[int, str, list[tuple[int, int, str]]]:
        """Cost and audit, and entry and audit of each span."""
        (cost, end), state = min((self.ends[q], q) for q in ACCEPTED if q in self.ends)
        back, chain = [], self.chains[state]
        while chain:
            chain, *link = chain
            back.append(tuple(link))
        return cost, "".join(self.sure) + end, back[::-1]


_PLAN = "conv_id long, start long, entry int, edits string, n_spans long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PLAN_ARROW = pa.schema([("conv_id", pa.int64()), ("start", pa.int64()), ("entry", pa.int32()), ("edits", pa.string()), ("n_spans", pa.int64())] + [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] + [("audit", pa.string())])


def planned(solutions: DataFrame) -> DataFrame:
    """Entry and edits of every span; the row of a conversation's last span has its figures.

    A conversation's spans, one per ``BLOCK`` rows, pass in order through one task, which
    keeps their edits: a letter per row, as the audit itself.
    """
    names = _SPAN_ARROW.names

    def rows(batches: Iterator[pa.RecordBatch]):
        for conv, group in groupby(columns_of(batches, *names), key=lambda r: r[0]):
            paths, starts, totals, last = Joined(), [], [0, 0, 0, 0], ""
            low = high = None
            turns = 0
            for _, _, start, first_turn, last_turn, n, *counts, first, final, entries, exits, costs, audits in group:
                paths.add(len(starts), zip(entries, exits, costs, audits, strict=True))
                starts.append(start)
                totals = [a + b for a, b in zip(totals, counts, strict=True)]
                totals[3] += bool(last) and not legal(last + first)
                last = final
                if n:
                    turns += n - (high is not None and first_turn == high)
                    low, high = first_turn if low is None else low, last_turn
            cost, audit, links = paths.goal()
            gaps = 0 if low is None else high - low + 1 - turns
            for span, entry, edits in links:
                whole = span == len(starts) - 1
                yield (conv, starts[span], entry, edits, len(starts), *((gaps, *totals, cost, audit) if whole else [None] * 7))

    dealt = solutions.repartition("conv_id").sortWithinPartitions("conv_id", "block")
    return dealt.mapInArrow(lambda batches: in_batches(rows(batches), _PLAN_ARROW, 2000, lambda r: len(r[3]) + len(r[-1] or "")), _PLAN)


# --- repaired text --------------------------------------------------------------------------------


def repaired(edits: str, entry: int, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """``role, text`` of the messages that the edits make of the rows."""
    state = entry
    for edit in edits:
        if edit == "I":
            state = SPOKEN[state]
            yield ROLE[state], ""
            continue
        role, text = next(rows)
        if edit == "R":
            state = SPOKEN[state]
            yield ROLE[state], text
        elif edit == "K":
            state = READ[state, role[0]]
            yield role, text


def _together(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """Plans and rows by block, in the order of places; a plan stands before its first row."""
    block = F.expr(f"place div {BLOCK}").alias("block")
    texts = placed.select(block, "place", F.lit(1).alias("kind"), "conv_id", "role", "text", F.lit(None).cast("int").alias("entry"), F.lit(False).alias("cut"))
    heads = plan.select("conv_id", F.col("start").alias("place"), F.lit(0).alias("kind"), F.lit("").alias("role"), F.col("edits").alias("text"), "entry", (F.col("n_spans") > 1).alias("cut"))
    both = texts.unionByName(heads.withColumn("block", block))
    return both.repartition("block").sortWithinPartitions("block", "place", "kind")


def _spans_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Conversation, start, whether it is cut, and the messages of each span, to be read in turn."""
    stream = columns_of(batches, "kind", "conv_id", "place", "role", "text", "entry", "cut")
    for _, conv, start, _, edits, entry, cut in stream:
        yield conv, start, cut, repaired(edits, entry, ((row[3], row[4]) for row in stream))


_MESSAGES_ARROW = pa.schema([("conv_id", pa.int64()), ("start", pa.int64()), ("number", pa.int64()), ("role", pa.string()), ("text", pa.string())])


def repaired_messages(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """``conv_id, start, number, role, text``: the repaired messages, in order of ``start, number`` within a conversation."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for conv, start, _, messages in _spans_of(batches):
            for number, (role, text) in enumerate(messages):
                yield conv, start, number, role, text

    schema = "conv_id long, start long, number long, role string, text string"
    return _together(placed, plan).mapInArrow(lambda batches: in_batches(rows(batches), _MESSAGES_ARROW, 5000, lambda r: len(r[4])), schema)


_PARTS = "conv_id long, start long, part long, data binary, sha string"
_PARTS_ARROW = pa.schema([("conv_id", pa.int64()), ("start", pa.int64()), ("part", pa.int64()), ("data", pa.binary()), ("sha", pa.string())])


def repaired_parts(placed: DataFrame, plan: DataFrame) -> DataFrame:
    """The hash of each conversation that is one span, and chunks of the text of the others.

    Every message in a chunk begins with a newline.
    """
    def rows(batches: Iterator[pa.RecordBatch]):
        for conv, start, cut, messages in _spans_of(batches):
            sha, part, kept, size, first = hashlib.sha256(), 0, [], 0, True
            for role, text in messages:
                data = f"{role}:{text}".encode()
                if not cut:
                    sha.update(data if first else b"\n" + data)
                    first = False
                    continue
                kept += [b"\n", data]
                size += len(data) + 1
                if size >= CHUNK:
                    yield conv, start, part, b"".join(kept), None
                    part, kept, size = part + 1, [], 0
            if kept:
                yield conv, start, part, b"".join(kept), None
            if not cut:
                yield conv, start, 0, None, sha.hexdigest()

    return _together(placed, plan).mapInArrow(lambda batches: in_batches(rows(batches), _PARTS_ARROW, 5000, lambda r: len(r[3] or b"")), _PARTS)


def hashes(parts: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256``; chunks of one conversation pass in order through one task, as a hash needs."""
    def rows(batches: Iterator[pa.RecordBatch]):
        for conv, group in groupby(columns_of(batches, "conv_id", "data"), key=lambda r: r[0]):
            sha, skip = hashlib.sha256(), 1
            for _, data in group:
                sha.update(data[skip:])
                skip = 0
            yield conv, sha.hexdigest()

    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    cut = parts.where("sha is null").select("conv_id", "start", "part", "data").repartition("conv_id").sortWithinPartitions("conv_id", "start", "part")
    joined = cut.mapInArrow(lambda batches: in_batches(rows(batches), schema), "conv_id long, repaired_sha256 string")
    return parts.where("sha is not null").select("conv_id", F.col("sha").alias("repaired_sha256")).unionByName(joined)


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows in order, the plan of edits per span, and the repaired text's hash or chunks, as tables."""
    prepare(rows.sparkSession)
    placed = placed_rows(rows)
    plan = save(planned(solved(spans(placed))))
    return placed, plan, save(repaired_parts(placed, plan))


def report(conversations: DataFrame, plan: DataFrame, parts: DataFrame) -> DataFrame:
    """A row per conversation of ``conversations``, also of those that the plan doesn't have."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("id")).distinct()
    figures = plan.where("cost is not null").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit").alias("p")
    texts = hashes(parts).alias("h")
    out = ids.join(figures, F.col("id").eqNullSafe(F.col("p.conv_id")), "left").join(texts, F.col("id").eqNullSafe(F.col("h.conv_id")), "left")
    zero, nothing = F.lit(0).cast("long"), hashlib.sha256().hexdigest()
    return out.select(
        F.col("id").alias("conv_id"), *[F.coalesce(c, zero).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
