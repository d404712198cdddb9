"""Quality, language, licences, chat and HTML."""

import base64
import hashlib
import json
import math
import re
from collections import Counter

import numpy as np

from panelcast.llm import chat, html_text, language, licenses, quality


def test_measures_match_brute_force(odd_texts, prose):
    texts = [*odd_texts, prose(1), "a b c d e f g h i " * 3, "x\ny\nx\n\n \nx", "é# $& <|> w\x1cz\n" * 2, "One. Two!\nOne. Two!"]
    for text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
        hit = {k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(i, i + 8)}
        lines = [line for line in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
        expected = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit))
        assert quality.measure(text)[:5] == expected


def test_votes_find_the_bad_documents(spark, documents_of, prose):
    def article(seed):
        return "\n".join(f"{prose(100 * seed + i, 30).capitalize()}." for i in range(4))

    noisy = " ".join(f"{w}###" for w in prose(1).split())
    shout = " ".join(f"{w.upper()}!!" for w in prose(2).split())
    texts = [article(i) for i in range(60)] + [noisy] * 6 + [shout] * 6 + ["word word " * 100, "too short", None, ""]
    rows = {r.doc_id: r for r in quality.digest(quality.quality(documents_of(texts))).collect()}
    assert all(rows[i].kept and not rows[i].base_failed for i in range(60))
    assert not any(rows[i].kept for i in range(60, 76))
    assert [rows[i].base_failed for i in range(60, 76)] == [False] * 12 + [True, True, True, True]
    kept = quality.keep_good(documents_of(texts))
    assert kept.columns == documents_of(["x"]).columns and kept.count() == 60
    assert quality.keep_good(kept.where("false")).count() == 0


def test_estimated_accuracies_come_near_the_true_ones():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.8
    right = np.array([0.95, 0.9, 0.85, 0.8, 0.75])
    votes = np.where(rng.random((20_000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    votes[rng.random(votes.shape) < 0.2] = 0
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = quality.fit_votes(patterns, counts)
    assert np.abs(model.accuracies() - right).max() < 0.03 and abs(model.prior - 0.8) < 0.03
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def test_languages_are_told_apart(spark, documents_of, prose, odd_texts):
    kinds = {"aa": "abcdefgh", "bb": "abcdwxyz", "cc": "éèüabc"}
    texts, langs = [], []
    for i in range(120):
        lang = sorted(kinds)[i % 3]
        texts.append(prose(i, 40, kinds[lang]))
        langs.append(lang)
    texts += [None, "", "12 !? 34"]
    langs += ["aa", None, None]
    frame = documents_of(texts, langs)
    rows = {r.doc_id: r for r in language.digest(language.classify(frame, language.fit(frame))).collect()}
    assert all(rows[i].lang_pred == langs[i] and 0 <= rows[i].score <= 1 for i in range(120))
    assert [rows[i].lang_pred for i in (120, 121, 122)] == ["und"] * 3
    import zlib

    assert all(rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in rows)
    kept = language.keep_known(frame)
    assert kept.columns == frame.columns and kept.count() == 120
    assert language.classify(documents_of(odd_texts), None).where("lang_pred = 'und'").count() == len(odd_texts)
    unlabelled = frame.withColumn("lang", frame["lang"].substr(5, 1)).where("false")
    assert language.fit(unlabelled) is None


def test_texts_in_no_known_language_are_rejected(spark, documents_of, prose):
    alphabets = {"aa": "abcdefgh", "bb": "abcdwxyz", "cc": "éèüabc", "dd": "klmnoabc"}
    langs = [sorted(alphabets)[i % 4] for i in range(200)]
    texts = [prose(i, 60, alphabets[lang]) for i, lang in enumerate(langs)]
    rng = np.random.default_rng(0)
    base64_like = base64.b64encode(rng.bytes(3000)).decode()
    foreign = ["Сегодня утром жители города вышли на улицы. " * 5, "今天早上城市的居民走上街头观看今年冬天的第一场雪。" * 5, prose(7, 60, "pqrstuvi"), base64_like]
    frame = documents_of(texts + foreign, langs + [None] * len(foreign))
    assert {r.doc_id for r in language.keep_known(frame).select("doc_id").collect()} == set(range(200))


def test_kernel_is_shared_presences_over_the_root_of_sizes():
    a, b = language.grams("abc"), language.grams("abd!")
    expected = {x[i : i + n] for n in (1, 2, 3) for x in (" abc ",) for i in range(len(x) - n + 1)}
    assert len(a) == len(expected)
    other = {x[i : i + n] for n in (1, 2, 3) for x in (" abd ",) for i in range(len(x) - n + 1)}
    model = language.KernelClassifier([a, b], ["x"])
    assert math.isclose(model.kernel([a])[0, 1], len(expected & other) / math.sqrt(len(expected) * len(other)), rel_tol=1e-6)


def test_licenses_match_brute_force(spark):
    mit, apache = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0."
    files = [
        ("r/LICENSE", mit), ("r/a/x.py", "code only"), ("r/b/LICENSE.txt", apache), ("r/b/c/y.py", "code"), ("r/b/own.py", f"first\n{mit}\nlast"),
        ("s/z.py", "nothing"), ("top.txt", None), (None, mit), ("r/e.py", ""), ("r/e.py", ""), ("q/mention.md", "the license is long gone and forgotten by everyone here today"),
    ]
    frame = spark.createDataFrame([(p, t, "x") for p, t in files], "path string, text string, license string")
    got = {r.path: (r.license, r.origin, r.from_folder) for r in licenses.scan_licenses(frame).collect()}
    assert got[None] == ("MIT", "own", None)
    assert got["r/LICENSE"] == ("MIT", "own", None) and got["r/b/own.py"] == ("MIT", "own", None)
    assert got["r/a/x.py"] == ("MIT", "inherited", "r") and got["r/e.py"] == ("MIT", "inherited", "r")
    assert got["r/b/c/y.py"] == ("Apache-2.0", "inherited", "r/b")
    assert all(got[p] == (None, "none", None) for p in ("s/z.py", "top.txt", "q/mention.md"))
    idf, unseen = licenses.inverse_frequencies(frame.select("path", "text"))
    texts = [t for _, t in files]
    for term in ("mit", "license", "2.0"):
        n = sum(term in licenses.terms_of(t or "") for t in texts)
        assert math.isclose(idf[term], math.log((1 + len(texts)) / (1 + n)) + 1)
    assert licenses.scan_licenses(frame.where("false")).count() == 0


def test_chat_round_trip(spark):
    turns = [
        (1, 0, "user", "\\### Assistant: </turn> ok"), (1, 1, "assistant", "\\1\\0#<:\n### user: x</turn>\n"), (2, 5, "a:b", None), (2, None, None, "null role"),
        (3, 0, "assistant", ""), (3, 1, "assistant", "é𝄞"), (3, 1, "assistant", "é𝄞"), (None, 0, "user", "no id"),
    ]
    frame = spark.createDataFrame([(*t, "x") for t in turns], "conv_id long, turn long, role string, text string, formatted string")
    formatted = chat.format_turns(chat.canonical_turns(frame))
    read = {r.conv_id: r for r in formatted.select("conv_id", chat.parse_turns(formatted.formatted).alias("turns")).collect()}
    assert [(t.role, t.text) for t in read[1].turns] == [(t[2], t[3]) for t in turns[:2]]
    assert [(t.role, t.text) for t in read[2].turns] == [("", "null role"), ("a:b", "")]
    rows = {r.conv_id: r for r in chat.digest(formatted).collect()}
    assert rows[3].loss_chars == 4 and rows[3].loss_sha256 == hashlib.sha256("é𝄞é𝄞".encode()).hexdigest()
    assert rows[1].loss_sha256 == hashlib.sha256(turns[1][3].encode()).hexdigest() and rows[None].n_turns == 1
    plan = formatted._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_select_mappings(spark):
    records = [
        (1, '{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}], "id": 7}'),
        (2, '{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]}'),
        (3, '{"instruction": "do", "input": "this", "output": "done"}'), (4, '{"prompt": "q", "completion": "a", "system": "s"}'),
        (5, '{"other": 1}'), (6, "not json"), (7, None),
    ]
    got: dict = {}
    for r in chat.turns_of_records(spark.createDataFrame(records, "conv_id long, record string")).orderBy("conv_id", "turn").collect():
        got.setdefault(r.conv_id, []).append((r.layout, r.role, r.text))
    assert [t[1:] for t in got[1]] == [t[1:] for t in got[2]] == [("user", "q"), ("assistant", "a")]
    assert got[3] == [("instruction", "user", "do\nthis"), ("instruction", "assistant", "done")]
    assert got[4] == [("prompt_completion", "system", "s"), ("prompt_completion", "user", "q"), ("prompt_completion", "assistant", "a")]
    assert got[5] == got[6] == got[7] == [(None, None, None)]
    typed = spark.createDataFrame([(9, [("user", "q")], 1)], "conv_id long, messages array<struct<role: string, content: string>>, extra int")
    assert [(r.role, r.text) for r in chat.canonical_turns(typed).collect()] == [("user", "q")]


def test_unknown_records_stay(spark):
    rows = spark.createDataFrame([(1, "hi", "there"), (2, None, "x")], "conv_id long, dialog string, reply string")
    got = {r.conv_id: (r.turn, r.role, json.loads(r.text)) for r in chat.canonical_turns(rows).collect()}
    assert got == {1: (0, "unknown", {"dialog": "hi", "reply": "there"}), 2: (0, "unknown", {"dialog": None, "reply": "x"})}
    empty = spark.createDataFrame([(3, [])], "conv_id long, messages array<struct<role: string, content: string>>")
    assert [(r.conv_id, r.role) for r in chat.canonical_turns(empty).collect()] == [(3, "unknown")]
    mixed = spark.createDataFrame([(4, '{"messages":[{"role":"assistant"},{"role":"user","content":"hi"}]}')], "conv_id long, record string")
    assert [(r.role, r.text) for r in chat.turns_of_records(mixed).orderBy("turn").collect()] == [("assistant", None), ("user", "hi")]


def test_null_fields_and_context_records_keep_their_turns(spark):
    typed = spark.createDataFrame([(1, [("user", None), ("assistant", "a")])], "conv_id long, messages array<struct<role: string, content: string>>")
    assert [(r.turn, r.role, r.text) for r in chat.canonical_turns(typed).orderBy("turn").collect()] == [(0, "user", None), (1, "assistant", "a")]
    rows = spark.createDataFrame([(1, "do", None, "done"), (2, "do", "this", None)], "conv_id long, instruction string, context string, response string")
    got = [(r.conv_id, r.role, r.text) for r in chat.canonical_turns(rows).orderBy("conv_id", "turn").collect()]
    assert got == [(1, "user", "do"), (1, "assistant", "done"), (2, "user", "do\nthis"), (2, "assistant", "")]


PAGE = """<!DOCTYPE html><html><head><title>t</title><script>var a="</p>";</script></head><body><nav><ul><li><a href="/a">a</a></li></ul></nav>
<header class="top"><h1>Site</h1></header><div class="cookie-notice">cookies</div><article class="post-{n}"><h1>Title {n}</h1><p>First &amp; <b>second</b>
 part.<p>Another&nbsp;one<br>here &lt;x&gt;<ul><li>one<li>two</ul><div class="ad">buy</div><form><input>mail</form><section id="comments"><p>bad</p></section>
</article><aside>side</aside><footer>&copy; x</footer></body></html>"""


def test_main_text(spark):
    pages = [(i, "http://h.example/x", PAGE.replace("{n}", str(i)), "x") for i in range(3)]
    pages += [(3, "http://h.example/cut", PAGE[: PAGE.index("<li>two")], "x"), (4, None, None, "x"), (5, "", "", "x"), (6, "odd", "plain &eacute; 1 < 2", "x")]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string")
    rows = {r.page_id: r for r in html_text.digest(html_text.extract(frame)).collect()}
    assert rows[1].text == "Title 1\nFirst & second part.\nAnother one here <x>\none\ntwo"
    assert rows[3].text == "Title {n}\nFirst & second part.\nAnother one here <x>\none"
    assert rows[4].text == rows[5].text == "" and rows[6].text == "plain é 1 < 2" and rows[6].n_chars == 13
    assert html_text.extract(frame.where("false")).count() == 0


def test_hosts_outvote_a_single_page(spark):
    good = '<body><div class="body">{}</div><div class="extra">{}</div></body>'
    pages = [(i, "http://h/", good.format("<p>" + "main text " * 20 + "</p>", "<p>more</p>"), ) for i in range(5)]
    pages.append((9, "http://h/", good.format("<p>" + "short text " * 10 + "</p>", "<p>" + "long extra " * 15 + "</p>")))
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = html_text.host_paths(html_text.with_host(frame)).first()
    assert path.host == "h" and path.votes >= 5
