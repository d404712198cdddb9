"""Line removal against plain Python, and what its plan does without."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from panelcast.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def brute(rows, least_chars=20, least_docs=3):
    def key(line):
        return line.strip(BLANKS).translate({c: c + 32 for c in range(65, 91)})

    holders = {}
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc_id)
    order = lambda d: (d is not None, d or 0)
    top = {k: max(v, key=order) for k, v in holders.items() if len(k) >= least_chars and len(v) >= least_docs}
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in top or top[key(x)] == doc_id]
        out.append((doc_id, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def found(frame, **more):
    return sorted(map(tuple, line_dedup.digest(line_dedup.kept_text(frame, line_dedup.keep_maps(frame, **more))).collect()), key=str)


LINES = ["A Line of Thirty-odd Characters É", "x" * 20, "y" * 19, "short", "", "   ", "\ta line of thirty-odd characters É \r", "Zeile, die öfter vorkommt", "once in a while a line like this"]


@pytest.fixture
def rows(odd_texts):
    rng = random.Random(5)
    texts = ["\n".join(rng.choices([*LINES, f"{i} is a line of its own, no other"], k=rng.randint(1, 150))) for i in range(60)]
    texts += [*odd_texts, "\n", "\n\n" + "x" * 20, LINES[0] + "\n" + LINES[6]]
    ids = [*range(len(texts))]
    texts += [texts[3], texts[4], "x" * 20 + "\nanother text under a used id", "x" * 20]  # a repeated row, a copy, a used id, no id
    return list(zip([*ids, 3, 999, 5, None], texts, strict=True))


@pytest.mark.parametrize("hot", [1000, 1, 20])
def test_lines_go_as_by_brute_force(spark, documents_of, rows, monkeypatch, hot):
    """With all hashes counted, all sorted, and some of each."""
    monkeypatch.setattr(line_dedup, "HOT", hot)
    frame = documents_of([t for _, t in rows], ids=[i for i, _ in rows])
    assert found(frame) == brute(rows)
    assert found(frame, least_chars=1, least_docs=2) == brute(rows, 1, 2)


def test_empty_tables_and_bitmaps(spark, documents_of):
    frame = documents_of(["\n".join([f"{i:020d}", "z" * 30, *["w" * 25] * 70, "end"]) for i in range(4)])
    assert found(frame.where("false")) == []
    maps = {r.doc_id: r for r in line_dedup.keep_maps(frame).collect()}
    assert set(maps) == {0, 1, 2} and all(m.n_dropped == 71 for m in maps.values())
    words = {w.word: w.bits & (2**64 - 1) for w in maps[0].keep}
    assert words[0] == 1 and words[1] == 2**64 - 1 - 0xFF  # lines 0 and 72 stay, of 73


def test_lines_are_shuffled_once_by_range(spark, documents_of, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT", 1)
    lines = line_dedup.save(line_dedup.hashed_lines(documents_of([t for _, t in rows])))
    plan = line_dedup.dropped_lines(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning") == 1 and "hashpartitioning(hash" not in plan
    assert "Python" not in plan and "Arrow" not in plan
    assert lines.agg(F.count(F.lit(1))).first()[0] > 0
