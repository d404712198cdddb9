"""Conversation repair against the enumeration of all edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from panelcast.llm import repair

SOUND = re.compile(r"(s?(ua)+)?")
BLANKS = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """Cost, audit and messages of ``(role, text, fault)`` rows, by trying everything."""
    best = None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u")]
    options = []
    for role, text, fault in rows:
        more = 1 if fault == "truncated" else 0
        some = [(3, "D", None)]
        if fault not in ("blank", "duplicate"):
            some += [(more, "K", (role, text)), (2 + more, "R", ("user", text)), (2 + more, "R", ("assistant", text))]
        options.append(some)
    for edits in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for k, insert in enumerate(inserts):
                for c in insert:
                    cost, audit = cost + 2, audit + "I"
                    out.append(({"u": "user", "a": "assistant"}[c], ""))
                if k < len(rows):
                    price, letter, message = edits[k]
                    cost, audit = cost + price, audit + letter
                    out += [message] if message else []
            if (best is None or (cost, audit) < best[:2]) and SOUND.fullmatch("".join(r[:1] or "-" for r, _ in out)):
                best = (cost, audit, out)
    return best


def brute(rows):
    """The report of damaged ``(conv_id, turn, role, text)`` rows, by conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, faulty = set(), []
        for _, role, text in mine:
            core = text.strip(BLANKS)
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "" if core[-1] in ".!?" else "truncated"
            seen.add((role, text))
            faulty.append((role, text, fault))
        turns = [t for t, _, _ in mine if t is not None]
        cost, audit, messages = cheapest(faulty)
        faults = [f for _, _, f in faulty]
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(faulty))
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest(),
        )
    return out


def reported(conversations, rows=None):
    _, plan, parts = repair.repair(conversations if rows is None else rows)
    return {r[0]: tuple(r)[1:] for r in repair.report(conversations, plan, parts).collect()}


SCHEMA = "conv_id long, turn long, role string, text string, place long, cost string"


def frame_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.fixture
def some_rows():
    rng = random.Random(11)
    rows = []
    for conv in [*range(60), None]:
        for _ in range(rng.randint(1, 4)):
            role = rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", "User"])
            rows.append((conv, rng.choice([None, 0, 1, 2, 3, 9, -4]), role, rng.choice(["Yes.", "Yes.", "why?", "cut off", " ", "", "né!\n", "x" * 70 + "."])))
    return rows + rows[:5]


@pytest.mark.parametrize("block", [1024, 2])
def test_repairs_equal_enumeration(spark, some_rows, monkeypatch, block):
    """Whole conversations, and ones cut at every second place."""
    monkeypatch.setattr(repair, "BLOCK", block)
    monkeypatch.setattr(repair, "CHUNK", 50)
    small = [r for r in some_rows if sum(o[0] == r[0] for o in some_rows) <= 4]
    assert reported(frame_of(spark, small)) == brute(small)


def test_agenda_on_spans_equals_the_whole():
    rng = random.Random(3)
    for _ in range(200):
        rows = [(rng.choice("suax"), rng.choice(["", "", "blank", "duplicate", "truncated"])) for _ in range(rng.randint(0, 9))]
        whole = repair.lightest(rows)
        cost, audit = min(whole[0, q] for q in repair.ACCEPTED if (0, q) in whole)
        joined, at, number = repair.Joined(), 0, 0
        while at < len(rows) or not number:
            size = rng.randint(1, 3)
            joined.add(number, [(e, q, *p) for (e, q), p in repair.lightest(rows[at : at + size], range(4)).items()])
            at, number = at + size, number + 1
        found = joined.goal()
        assert found[:2] == (cost, audit) and "".join(x for _, _, x in found[2]) == audit


def test_damage_by_hash(spark):
    rows = [(c, t, r, x) for c in [*range(40), None] for t in [0, 1, 2, None] for r, x in [("assistant", "A. b! c?"), (None, None)]]
    expected = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = r or " ", x or " "
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        expected += [(c, t, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    assert sorted(map(tuple, repair.damaged(frame_of(spark, rows)).collect()), key=str) == sorted(expected, key=str)


def test_long_conversations_and_empty_tables(spark, monkeypatch):
    """A conversation with most of all rows, many of them equal, is cut; its texts pass in chunks."""
    monkeypatch.setattr(repair, "BLOCK", 64)
    monkeypatch.setattr(repair, "CHUNK", 1000)
    rows = [(1, i if i % 5 else None, "user" if i % 2 else "assistant", f"{'same' if i % 3 else i}.") for i in range(1500)]
    rows += [(c, 0, "user", "x" * 50_000 + ".") for c in range(2, 40)] + [(50, 0, "assistant", "")]
    frame = frame_of(spark, rows)
    more = frame.unionByName(frame_of(spark, [(77, 0, "user", "gone")]))  # a conversation without rows after damage
    got = reported(more, frame.repartition(5))
    assert got[77] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest()) and set(got) == {1, 50, 77, *range(2, 40)}
    assert got[50][1] == 1 and got[50][5:7] == (3, "D")
    ordered = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3], hashlib.sha256(r[3].encode()).hexdigest()))
    seen, codes = set(), []
    for _, _, role, text in ordered:
        codes.append((role[0], "duplicate" if (role, text) in seen else ""))
        seen.add((role, text))
    exits = repair.lightest(codes)
    cost, audit = min(exits[0, q] for q in repair.ACCEPTED if (0, q) in exits)
    messages = list(repair.repaired(audit, 0, ((r[2], r[3]) for r in ordered)))
    assert got[1][5:] == (cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in messages).encode()).hexdigest())
    placed, plan, _ = repair.repair(frame)
    told = [(r.role, r.text) for r in repair.repaired_messages(placed, plan).where("conv_id = 1").orderBy("start", "number").collect()]
    assert told == messages
    empty = frame.where("false")
    assert reported(empty) == {}
