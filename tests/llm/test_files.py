"""Token files, packing and WARC archives: round trips and damage."""

import hashlib
import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from panelcast.llm import packing, token_files, tokens, warc

TOKENIZER = Tokenizer.from_file(tokens.default_tokenizer())
TRICKY = ["Don't 'quote' x's!", "<|endoftext|> a<|STARTOFTEXT|>b", "É́cole ﬁ Ǆ ΟΔΥΣΣΕΥΣ.", "a\x1cb\x85c 12,5% “q”,", "日本語、 İI ß ẞ", "b'&& a&&&"]


def ids_of(text, end):
    return np.array([*TOKENIZER.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


def test_words_give_the_ids_of_whole_texts(odd_texts, prose, monkeypatch):
    coder = tokens.WordEncoder(tokens.default_tokenizer(), kept=50)
    texts = [*odd_texts, *TRICKY, *(prose(i) for i in range(5))]
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids == ids_of(text, 0)[:-1].tobytes()
    column = pa.array(["skipped", *texts, None, "  edge\x0b\x0c words\r\n"]).slice(1)
    assert list(coder.encode_column(column)) == [ids_of(t, 0)[:-1].tobytes() for t in column.to_pylist()]
    assert list(coder.encode_column(column.slice(0, 0))) == []
    monkeypatch.setattr(tokens, "RUN", 30)
    assert list(coder.encode_column(column)) == [ids_of(t, 0)[:-1].tobytes() for t in column.to_pylist()]


def test_token_files_round_trip(spark, documents_of, odd_texts):
    texts = [*odd_texts, *TRICKY]
    order = list(range(len(texts)))
    random.Random(1).shuffle(order)
    frame = documents_of(texts, ids=order)
    manifest = token_files.write_documents(frame)
    rows = {r.doc_id: r for r in token_files.digest(token_files.read_documents(spark, manifest)).collect()}
    at = 0
    for doc_id, text in sorted(zip(order, texts, strict=True)):
        ids = ids_of(text, 1)
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    some = {r.doc_id: r.ids for r in token_files.read_documents(spark, manifest, [3, 5, 999]).collect()}
    assert {k: bytes(v) for k, v in some.items()} == {d: ids_of(t, 1).tobytes() for d, t in zip(order, texts, strict=True) if d in (3, 5)}
    assert token_files.read_documents(spark, token_files.write_documents(frame.where("false"))).count() == 0


def test_frames_are_independent_and_checked():
    import zstandard

    out = io.BytesIO()
    writer = token_files.FileWriter(out, frame_ids=5)
    docs = [(None, 2), (1, 12), (4, 0), (9, 5)]
    for doc_id, n in docs:
        writer.add(doc_id, np.arange(n, dtype="<u4").tobytes())
    writer.close()
    read = token_files.FileReader(out)
    assert [(d, len(ids) // 4) for d, _, ids in read.documents()] == docs and len(read.table) == 4
    assert read.frames_with([4]) != read.frames_with(None) and [d for d, _, _ in read.documents([4, 9])] == [4, 9]
    assert len(zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read()) == sum(e[1] for e in read.table)
    broken = bytearray(out.getvalue())
    broken[20] ^= 255
    with pytest.raises(Exception):
        list(token_files.FileReader(io.BytesIO(bytes(broken))).documents())


def test_packing_keeps_every_id_once(spark, documents_of, odd_texts, prose):
    texts = [*odd_texts, *(prose(i, 30 + 37 * i) for i in range(40))]
    pieces, places = packing.pack_documents(documents_of(texts), capacity=256, unit=4)
    rows = places.collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for doc_id, text in enumerate(texts):
        ids, at = ids_of(text, 2), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= 1.1 * total / 256 + 2
    for r in packing.sequences(pieces, places, capacity=256).collect():
        used = sum(length for _, length in by_sequence[r.sequence_id])
        assert r.used == used and len(r.ids) == 4 * (used if used & (used - 1) == 0 else 256)
    assert packing.pack_documents(documents_of(["x"]).where("false"))[1].count() == 0


def test_short_rows_are_packed_without_padding(spark, documents_of):
    word = next(w for w in ("a", "x", "the") if len(ids_of(" ".join([w] * 16), 2)) == 17)
    for texts in ([None, ""] * 700, [" ".join([word] * 16)] * 300):
        places = packing.pack_documents(documents_of(texts), capacity=512)[1].groupBy("sequence_id").sum("length").collect()
        tokens = sum(r[1] for r in places)
        assert max(r[1] for r in places) <= 512 and len(places) <= 1.02 * tokens / 512 + 1


def test_short_pieces_fill_what_long_ones_leave():
    rng = np.random.default_rng(2)
    sizes = np.array([*range(1, 256), *range(256, 512, 8), *range(512, 4097, 16)])
    for mean in (2, 30, 300):
        found, n = np.unique(sizes[np.searchsorted(sizes, np.clip(rng.geometric(1 / mean, 30_000), 1, 4096))], return_counts=True)
        plan = packing.plan_of(found, n, 4096, 16)
        assert (sum(p * x for p, x in plan) >= n).all() and all(p @ found <= 4096 for p, _ in plan)
        assert sum(x for _, x in plan) <= 1.01 * (found @ n) / 4096 + 1


def test_long_programs_end_beside_a_session(spark, monkeypatch):
    """Several hundred pricing rounds, so that rounding errors are undone on the way."""
    spark.range(10).count()
    rounds, price = [0], packing.best_pattern
    monkeypatch.setattr(packing, "best_pattern", lambda *a: (rounds.__setitem__(0, rounds[0] + 1), price(*a))[1])
    rng = np.random.default_rng(3)
    sizes = np.arange(9, 140)
    demand = rng.integers(1, 900, len(sizes))
    plan = packing.cutting_stock(sizes, demand, 400, gap=0.0)
    assert rounds[0] > 200
    assert (sum(p * n for p, n in plan) >= demand).all() and all(p @ sizes <= 400 for p, _ in plan)
    assert sum(n for _, n in plan) <= 1.01 * (sizes @ demand) / 400 + 2


def test_column_generation_comes_near_the_bound():
    rng = np.random.default_rng(1)
    sizes, demand = np.unique(rng.integers(3, 60, 5000), return_counts=True)
    plan = packing.cutting_stock(sizes, demand, 64)
    assert all((p @ sizes) <= 64 for p, _ in plan)
    assert (sum(p * n for p, n in plan) >= demand).all()
    from itertools import combinations_with_replacement as some

    value, counts = packing.best_pattern(np.array([2.0, 3.1, 4.6]), np.array([2, 3, 4]), 9)
    best = max(sum({2: 2.0, 3: 3.1, 4: 4.6}[s] for s in c) for n in range(5) for c in some([2, 3, 4], n) if sum(c) <= 9)
    assert abs(value - best) < 1e-9 and counts @ np.array([2, 3, 4]) <= 9
    halves, n = np.array([20, 32, 44]), np.array([300, 500, 300])
    assert sum(x for _, x in packing.cutting_stock(halves, n, 64)) <= 552


PAYLOADS = [b"<p>%d</p>" % i * 30 for i in range(8)]


def archive(zipped):
    parts = [warc.record(i, f"http://x/{i} y", p, hashlib.sha256(p).hexdigest(), None) for i, p in enumerate(PAYLOADS)]
    return [warc.zipped(p) if zipped else p for p in parts]


@pytest.mark.parametrize("zipped", [True, False])
@pytest.mark.parametrize("damage", ["none", "flip", "cut", "junk", "head", "lost", "length"])
def test_salvage_recovers_all_undamaged_records(zipped, damage):
    parts = archive(zipped)
    bad = {2, 5} if damage != "none" else set()
    for k in bad:
        p = bytearray(parts[k])
        if damage == "flip":
            p[-60] ^= 0x55
        elif damage == "cut":
            p = p[: len(p) // 2]
        elif damage == "junk":
            p = bytearray(b"\x00junk\x1f\x8b\x08 WARC/1.1 nope" * 9)
        elif damage == "head":
            p[:6] = b"XXXXXX"
        elif damage == "lost":
            p = bytearray()
        elif damage == "length":
            p = bytearray(warc.zipped(b"WARC/1.1\r\nContent-Length: 99999\r\n\r\nshort\r\n\r\n") if zipped else bytes(p).replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1))
        parts[k] = bytes(p)
    whole = b"".join(parts)
    found = list(warc.salvage(io.BytesIO(whole)))
    good = [warc.payload_of(r[4], r[5]) for r in found if r[0] == "record"]
    assert good == [p for i, p in enumerate(PAYLOADS) if i not in bad]
    at = 0
    for _, start, end, *_ in found:  # records and gaps tile the file
        assert start == at
        at = end
    assert at == len(whole)
    if damage not in ("none", "lost"):
        assert sum(r[0] == "gap" and bool(r[3]) for r in found) == 2


def test_archives_round_trip(spark):
    same, short = "x" * 200, "tiny"
    pages = [(5, "u", same), (3, None, same), (9, "u\r\nv", same), (1, "u", short), (2, "u", short), (4, "u", None), (6, "u", "é" * 60), (None, "u", same), (3, None, same)]
    frame = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, payload string")
    manifest = warc.write_archives(frame, file_bytes=200)
    read = warc.read_archives(spark, manifest)
    assert read.where("kind = 'gap'").count() == 0
    rows = sorted(warc.digest(read).collect(), key=str)
    expected = []
    for page, _, text in pages:
        data = (text or "").encode()
        revisit = data == same.encode() and page in (5, 9)
        expected.append((page, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", 3 if revisit else None))
    assert sorted((tuple(r) for r in rows), key=str) == sorted(expected, key=str)
    assert warc.read_archives(spark, warc.write_archives(frame.where("false"))).count() == 0
