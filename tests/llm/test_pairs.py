"""Near duplicates and benchmark passages against brute force."""

import re

import pytest

from panelcast.llm import decontaminate, ngram_join
from panelcast.llm.components import connected_components

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_groups(rows):
    sets = {}
    for i, t in rows:
        w = SPACE.findall(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and group[a] != group[b]:
                    group[a] = group[b] = min(group[a], group[b])
                    changed = True
    return {i: (len(sets[i]), group[i]) for i in sets}


def edited(text, places):
    words = text.split()
    for p in places:
        words[p] = f"edit{p}"
    return " ".join(words)


def test_near_duplicates_match_brute_force(spark, documents_of, prose, odd_texts):
    base, passage = prose(1, 300), prose(2, 60, "xyz")
    texts = [base, base.upper(), edited(base, [10]), edited(base, [10, 90, 170]), edited(base, [5, 60, 120, 180, 240, 290])]
    # copies that are similar to the original but not to each other
    texts += [edited(base, range(s, 300, 60)) for s in range(1, 20, 3)]
    texts += [f"{prose(i, 80)} {passage}" for i in range(10, 20)] + [prose(99, 4), prose(99, 4)] + odd_texts
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents_of(texts)).collect()}
    assert got == brute_groups(rows)


def test_chains_that_only_cross_a_list_are_found(spark, documents_of, prose):
    """A is like B and B like C, but A isn't like C, with other documents in the same lists."""
    base = prose(5, 200)
    steps = [edited(base, range(3, 3 + 7 * k, 7)) for k in range(0, 9)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(documents_of(steps[::-1])).collect()}
    assert got == brute_groups(list(enumerate(steps[::-1])))


def test_words_have_one_hash_each(monkeypatch):
    """Equal words, and only those, get equal hashes, wherever they stand and however long they are."""
    long = "x" * 70
    text = f" a ab\tba\n\nb {long} a\x0b{long}y ab\x00 ab \u00e9\x1ca {long} b".encode()
    words = text.split()
    assert words.count(b"ab") == 2 and long.encode() in words
    for run in (1 << 20, 5, 1):
        monkeypatch.setattr(ngram_join, "RUN", run)
        codes = ngram_join.word_codes(text).tolist()
        assert codes == [ngram_join.word_codes(w)[0] for w in words]
        assert len(set(codes)) == len(set(words))
    assert not len(ngram_join.word_codes(b"")) and not len(ngram_join.word_codes(b" \n "))


def test_prefixes_are_made_once(documents_of, prose, monkeypatch):
    """The lists are made from saved postings, as each Python pass over the texts shingles them anew."""
    plans, lists = [], ngram_join.shared_lists
    monkeypatch.setattr(ngram_join, "shared_lists", lambda rows: (plans.append(rows._jdf.queryExecution().toString()), lists(rows))[1])
    ngram_join.near_duplicates(documents_of([prose(1, 50), prose(1, 50), prose(2, 50)]))
    assert len(plans) == 1 and "MapInArrow" not in plans[0]


def test_near_duplicates_of_odd_rows(spark, documents_of, prose):
    text = prose(3, 50)
    frame = documents_of([text, text, text, None], ids=[7, 7, None, 9])
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(frame).collect()), key=str)
    assert got == sorted([(7, 46, 7), (7, 46, 7), (None, 46, None), (9, 0, 9)], key=str)
    empty = documents_of([text]).where("false")
    assert ngram_join.near_duplicates(empty).count() == 0
    assert ngram_join.keep_one(frame).columns == frame.columns
    assert ngram_join.keep_one(documents_of([text, text, "other"])).count() == 2


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(30)], [(5, 1), (5, 9), (2, 3), (3, 2), (4, 4)]])
def test_components(spark, edges):
    found = {r.doc_id: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    parent = {n: n for e in edges for n in e}
    for _ in parent:
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    assert {n: found.get(n, n) for n in parent} == parent


def brute_hits(text, items):
    words, hit, found = ALNUM.findall(lower(text)), set(), set()
    for name, item in items:
        w = ALNUM.findall(lower(item))
        size = min(10, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            for p in range(len(words) - size + 1):
                if words[p : p + size] == w[k : k + size]:
                    hit.update(range(p, p + size))
                    found.update([] if name is None else [str(name)])
    return len(words), len(hit), len(found), decontaminate.sha_of(list(found)), bool(hit)


@pytest.mark.parametrize("per_pass", [1, 400_000])
def test_decontamination_matches_brute_force(spark, documents_of, prose, odd_texts, per_pass):
    item = prose(1, 30)
    items = [(1, item), (2, "Short, item!"), (3, None), (4, "--"), (10, item), (11, "one"), (None, "null item here")]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    w = item.split()
    texts = [f"{prose(7)} {' '.join(w[4:17])} {prose(8)}", " ".join(w[:9]), "A short ITEM; and short item", "See: null item, null item here.", " ".join(w[:10] + w[3:14]), *odd_texts]
    got = decontaminate.digest(decontaminate.find_passages(documents_of(texts), benchmark, per_pass=per_pass)).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == {i: brute_hits(t, items) for i, t in enumerate(texts)}
    kept = decontaminate.keep_clean(documents_of(texts), benchmark, per_pass=per_pass)
    assert {r.doc_id for r in kept.collect()} == {i for i, t in enumerate(texts) if not brute_hits(t, items)[1]}
    nothing = decontaminate.find_passages(documents_of(texts), benchmark.where("false"))
    assert nothing.where("size(hits) > 0").count() == 0
