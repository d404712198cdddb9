"""Importance resampling: derived CRCs and the whole draw against plain Python."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from panelcast.llm import resample


def words_of(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def features_of(text, longest, buckets):
    words = words_of(text)
    runs = [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]
    return [zlib.crc32(r.encode()) % buckets for r in runs]


def brute(rows, target, percent, least, longest, buckets):
    source, wanted = Counter(), Counter()
    for _, text in rows:
        source.update(features_of(text, longest, buckets))
    for text in target:
        wanted.update(features_of(text, longest, buckets))
    s, t = sum(source.values()), sum(wanted.values())
    gain = [math.floor(1000 * math.log((wanted[b] + 1) * (s + buckets) / ((source[b] + 1) * (t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        found = features_of(text, longest, buckets)
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in found)
        out.append((doc_id, len(words_of(text)), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {}
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        drawn.setdefault(r, []).append(rank)
    return sorted(((*r, drawn[r].pop(0) if drawn.get(r) else None) for r in out), key=str)


def test_crcs_of_runs_follow_from_prefixes(monkeypatch, odd_texts, prose):
    data = [b"", b"a", b"xyz" * 70, bytes(range(256)) * 5]
    for first in data:
        for second in data:
            crc = np.array([zlib.crc32(first)], dtype=np.uint32)
            assert int(resample.shift(crc, np.array([len(second)]))[0]) ^ zlib.crc32(second) == zlib.crc32(first + second)
    monkeypatch.setattr(resample, "BLOCK", 40)
    monkeypatch.setattr(resample, "FLUSH", 17)
    texts = [*odd_texts, "Ünï-CODE's ÀÉ 12a", "a" * 100 + " b", *(prose(i, 90) for i in range(3))]
    for longest in (1, 3):
        scanner = resample.Scanner(longest, 1000)
        found, words = {i: [] for i in range(len(texts))}, {}
        for i, text in enumerate(texts):
            words[i], done = scanner.add(i, text)
            for k, part in done:
                found[k].extend(part.tolist())
        for k, part in scanner.flush():
            found[k].extend(part.tolist())
        for i, text in enumerate(texts):
            assert words[i] == len(words_of(text))
            assert sorted(found[i]) == sorted(features_of(text, longest, 1000))


@pytest.mark.parametrize("longest, buckets", [(1, 10_000), (2, 100_000)])
def test_draw_equals_brute_force(spark, documents_of, odd_texts, prose, longest, buckets):
    texts = [*odd_texts, *(prose(i, 5 + 3 * i) for i in range(25)), prose(7, 40), prose(7, 40), prose(8, 40)]
    ids = [*range(len(texts) - 4), 3, 900, 900, None]  # repeated ids, a repeated row and a null id
    texts[-2] = texts[-3]
    target = [None, "", prose(3, 60), prose(4, 30)]
    frame = documents_of(texts, ids=ids)
    wanted = spark.createDataFrame([(t, 1, "x") for t in target], "text string, doc_id long, rank string")
    got = resample.resample(frame, wanted, 50, 20, longest, buckets)
    assert got.columns == ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(list(zip(ids, texts, strict=True)), target, 50, 20, longest, buckets)
    flat = resample.resample(frame, wanted.where("false"), 50, 20, longest, buckets)
    assert sorted(map(tuple, flat.collect()), key=str) == brute(list(zip(ids, texts, strict=True)), [], 50, 20, longest, buckets)
    assert resample.resample(frame.where("false"), wanted).count() == 0
    short = resample.resample(frame.where("text is null or text = ''"), wanted)
    assert {(r.n_features, r.weight, r.rank) for r in short.collect()} == {(0, 0, None)}


def test_equal_scores_go_by_id_over_many_partitions(spark):
    rows = spark.range(1000).selectExpr("999 - id AS doc_id", "30L AS n_words", "30L AS n_features", "0L AS weight", "id div 400 AS score")
    got = {r.doc_id: r.rank for r in resample.draw(rows.repartition(7), 30).collect()}
    order = sorted(got, key=lambda d: (-((999 - d) // 400), d))
    assert got == {d: i + 1 if i < 300 else None for i, d in enumerate(order)}
