"""Operators against brute force, exact values and held-out accuracy."""

import hashlib
import json
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from zonewise.llm import chat, decontaminate, html, language, licenses, mixing, pii, rules, simhash
from zonewise.llm.sql import ORACLES

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def sql(sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con.sql(ORACLES[name])


# mixing


def test_mix_equals_sql(docs, sf):
    want = sql(sf, "op1_mix")
    got = mixing.mix(docs, bucket_rows=7).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=str) == sorted(want.fetchall(), key=str)


def test_many_sources_equal_brute_force(spark):
    """Targets against sharing out round by round; sources are ranked and summed by ranges."""
    from fractions import Fraction

    r = np.random.default_rng(3)
    names = [None, *(f"s{k}" for k in range(300)), "é", ""]
    sizes = [(s, int(r.integers(0, 50) ** 3)) for s in names]
    got = {x["source"]: x for x in mixing.targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    ranked = sorted(sizes, key=lambda x: (x[0] is None, (x[0] or "").encode()))
    weight = {s: (5, 2, 1)[k % 3] for k, (s, _) in enumerate(ranked)}
    left, stopped = Fraction(sum(n for _, n in sizes)), {}
    while True:
        still = [(s, n) for s, n in sizes if s not in stopped]
        total = sum(weight[s] for s, _ in still)
        over = [(s, n) for s, n in still if left * weight[s] / total >= 3 * n]
        if not over:
            break
        for s, n in over:
            stopped[s] = Fraction(3 * n)
        left -= sum(3 * n for _, n in over)
    for s, _ in sizes:
        want = stopped.get(s, left * weight[s] / max(total, 1))
        assert abs(got[s]["target"] - float(want)) <= 1e-9 * float(want) and got[s]["weight"] == weight[s]


def test_mix_meets_targets(spark):
    rows = [(i, "w " * (1 + i % 9), s) for s, n in (("a", 30), ("b", 400), (None, 3), ("c", 200)) for i in range(n)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), bucket_rows=20)
    by = got.groupBy("source_size", "target").agg(F.sum("taken").alias("taken")).collect()
    assert len(by) == 4
    for r in by:
        assert r["target"] <= 3 * r["source_size"] and abs(r["taken"] - r["target"]) <= 9
    assert abs(sum(r["target"] for r in by) - sum(r["source_size"] for r in by)) < 1e-6
    assert got.where("taken > 3 * size").count() == 0


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, s) for s in ("a", "b", "c") for i in range(600)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"), weights=(1,))
    order = [r["position"] for r in mixing.training_order(mixed).collect()]
    assert order == sorted(order) and 0 <= order[0] and order[-1] <= 1
    early = mixed.select(F.explode("positions").alias("p")).where("p < 0.5").count()
    assert abs(early - 900) < 20  # level, early and late schedules balance


# chat


def call(i, name, args):
    return {"id": i, "name": name, "arguments": args}


def test_chat_links_orders_and_checks(spark):
    rows = [
        (1, 0, "user", "hi"), (1, 1, "assistant", json.dumps({"content": "x", "tool_calls": [call("a", "search", {"query": "x", "limit": 3}), call("b", "weather", {"days": "2", "zz": 1})]})), (1, 2, "tool", json.dumps({"tool_call_id": "a", "content": "found"})),
        (2, 0, "tool", json.dumps({"tool_call_id": "k", "content": {"z": 1}})), (2, 1, "assistant", json.dumps({"tool_calls": [call("k", "calculator", {"expression": "1+1"})]})), (2, 2, "assistant", json.dumps({"tool_calls": [call("m", "fetch", {"url": "${k}", "headers": {"b": 1, "a": 2}})]})),
        (3, 0, "assistant", json.dumps({"tool_calls": [call("p", "fetch", {"url": "${q}"})]})), (3, 1, "tool", json.dumps({"tool_call_id": "p", "content": "x"})), (3, 2, "assistant", json.dumps({"tool_calls": [call("q", "fetch", {"url": "${p}"})]})), (3, 3, "tool", json.dumps({"tool_call_id": "q", "content": "x"})),
        (4, 0, "assistant", json.dumps({"tool_calls": [call("p", "nope", 5), call("p", "nope", {})]})), (4, 1, "tool", json.dumps({"tool_call_id": "nn", "content": "x"})), (None, None, None, None), (5, 0, "user", '{"a":1,"a":2}'), (5, 1, "user", '{"x": 1}'), (5, 1, "user", '{"x": 1}'),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chat(df).orderBy("conv_id", "anchor", "depth", "turn").collect()
    assert len(got) == len(rows)
    by = {(r["conv_id"], r["turn"]): r for r in got}
    assert by[1, 1]["status"] == "b:extra:zz,b:missing:city,b:type:days,b:unanswered" and by[1, 2]["status"] == ""
    assert [r["turn"] for r in got if r["conv_id"] == 2] == [1, 0, 2]
    assert {by[3, t]["status"] for t in range(4)} == {"cyclic"}
    assert by[4, 0]["status"] == "p:duplicate_id,p:not_object,p:unanswered,p:unknown_tool" and by[4, 1]["status"] == "nn:unlinked"
    assert by[2, 2]["json"].startswith('{"role":"assistant","tool_calls":[{"arguments":{"headers":{"a":2,"b":1},"url":"${k}"}')
    assert json.loads(by[5, 0]["json"])["content"] == '{"a":1,"a":2}'
    assert chat.format_chat(df.limit(0)).count() == 0


def test_chat_keeps_plain_conversations(spark, sf):
    table = spark.read.parquet(f"{sf}/conversations.parquet")
    want = sorted((r["conv_id"], r["turn"], r["role"], r["text"]) for r in table.collect())
    got = sorted((r["conv_id"], r["turn"], r["role"], json.loads(r["json"])["content"]) for r in chat.format_chat(table).collect())
    assert got == want


# quality rules


def brute_statistics(text):
    words = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é#%\n\t 😀", max_size=80))
def test_statistics(text):
    assert rules.statistics(text.encode())[:5] == brute_statistics(text)


def test_statistics_of_documents(docs):
    want = {r["doc_id"]: brute_statistics(r["text"] or "") for r in docs.collect()}
    got = {r["doc_id"]: tuple(r[s] for s in rules.STATS[:5]) for r in rules.measure(docs).collect()}
    assert got == want


def test_covering_finds_planted_rules():
    r = np.random.default_rng(1)
    x = {k: r.uniform(0, 100, 4000) for k in rules.FEATURES}
    bad = (x["symbol_share"] > 80) | ((x["repeat_share"] > 70) & (x["mean_word"] <= 20))
    found = rules.learn(x, bad, np.arange(4000) % 3 == 0)
    caught = np.zeros(4000, bool)
    for rule in found:
        caught |= rules.covers(rule, x)
    assert (caught == bad).mean() > 0.97 and len(found) <= 5
    assert rules.learn(x, np.zeros(4000, bool), np.arange(4000) % 3 == 0) == []


def test_rules_hold_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    got = rules.judge(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed")
    assert got.where((F.col("quality") == 1) == F.col("kept")).count() >= 0.97 * got.count()


# pages


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><header>Site</header><nav><a>Home</a></nav><div class="ad-box">Buy</div>
<article><h1>Head &amp; shoulders</h1><p><b>One  two<br>three<p>Four &lt;5 &copy 6</p><aside>side</aside><div class="share-bar social">share</div><table><tr><td>a<td>b</table><ul><li>x<li>y</ul><form>f</form><pre> p
q </pre><div id="comments"><p>first!</p></div></article><div>{footer}</div><footer>f</footer>"""


def test_main_text(spark):
    want = "Head & shoulders\nOne two three\nFour <5 © 6\na b\nx\ny\np q"
    # without an article, only recurrence tells the template
    bare = "<body><div><p>Menu of the site</p></div><div><p>Own text {}</p></div><div>Bottom</div>"
    rows = [(i, "https://A.example.com/x", bare.format(i)) for i in range(20)] + [(50, "http://b.org/", PAGE.format(footer="z")), (51, None, PAGE.format(footer="z")), (52, "http://[", None), (None, "http://b.org", ""), (53, "http://b.org", "<p>cut <b>off <i cla"), (53, "http://b.org", "a < b &am")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = html.main_text(pages)
    by = {r["page_id"]: r["text"] for r in got.collect()}
    assert by[50] == want and by[51] == want and by[52] == "" and by[None] == ""
    assert [by[i] for i in range(20)] == [f"Own text {i}" for i in range(20)]
    assert sorted(r["text"] for r in got.where("page_id = 53").collect()) == ["a < b &am", "cut off"]
    assert got.where("n_chars <> length(text)").count() == 0
    assert got.exceptAll(html.main_text(pages, max_broadcast=-1)).count() == 0
    assert html.main_text(pages.limit(0)).count() == 0


def test_recurring_parts_of_articles_go(spark):
    box = '<div class="x7"><p>Get our letter each week</p></div>'
    page = "<body><div>Day {}</div><article><h1>Title {}</h1><p>Recurring line</p><div><p>Story {} {}</p></div>{}</article></body>"
    own = [(i, "http://a.org/", page.format(i, i, i, "long " * 30, box)) for i in range(12)]
    copies = [(100 + i, "http://b.org/", page.format(i, 0, 0, "long " * 30, box)) for i in range(12)]
    few = [(200 + i, "http://c.org/", page.format(i, i, i, "long " * 30, box)) for i in range(7)]
    short = [(300, "http://a.org/", f"<article><p>Ha</p>{box}</article>")]
    large = [(1000 + i, "http://d.org/", f"<body>{'<div>Side bar</div>' if i < 40 else ''}<div>Own {i}</div></body>") for i in range(1000)]
    df = spark.createDataFrame(own + copies + few + short + large, "page_id long, url string, html string")
    for limit in (html.MAX_BROADCAST, -1):
        by = {r["page_id"]: r["text"] for r in html.main_text(df, max_broadcast=limit).collect()}
        story = "Title {0}\nRecurring line\nStory {0} " + "long " * 29 + "long"
        assert [by[i] for i in range(12)] == [story.format(i) for i in range(12)] and by[300] == "Ha"
        assert {by[100 + i] for i in range(12)} == {story.format(0) + "\nGet our letter each week"}, "copies of one article"
        assert all(by[200 + i].endswith("each week") for i in range(7))
        assert [by[1000 + i] for i in range(1000)] == [f"Own {i}" for i in range(1000)], "4 % of a host"


def test_words_of_ids_keep_article_text(spark):
    kept = ['<section id="related-work"><p>kept 1</p></section>', '<p class="ad-hoc">kept 2</p>', '<div class="comment-free notice-period"><p>kept 3</p></div>', "<header><h1>kept 4</h1></header>"]
    gone = ['<div class="ad">no</div>', '<div class="comment-list">no</div>', '<div id="newsletterSignup">no</div>', '<ul class="x nav-links"><li>no</ul>', '<div class="cookie_banner">no</div>']
    (row,) = html.main_text(spark.createDataFrame([(1, "http://a.org", f"<article>{''.join(kept + gone)}</article>")], "page_id long, url string, html string")).collect()
    assert row["text"] == "kept 1\nkept 2\nkept 3\nkept 4"


@pytest.mark.parametrize("page", ["<div>" * 20_000 + "</b>" * 20_000, "<article>" * 8_000 + "x", "<li><ul>" + "<div>" * 20_000 + "<li></li>" * 20_000, "<p>" + "<b>" * 20_000 + "<p>x" * 20_000, "<td>" + "<b>" * 20_000 + "<div></div>" * 20_000, "<" * 100_000, "<a b=" * 30_000, "&" * 200_000])
def test_broken_pages_take_linear_time(page):
    import time

    began = time.process_time()
    html.extract(page, "http://a.org", lambda keys: np.zeros(keys.size, bool))
    assert time.process_time() - began < 5


def test_repeated_pages_keep_their_text(spark):
    rows = [(i, "http://a.org/", "<body><div><p>One story</p></div><div>Its end</div></body>") for i in range(30)]
    got = html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in got} == {"One story\nIts end"} and len(got) == 30


def test_templates_equal_brute_force(spark):
    """Which blocks go, counted page by page: those beside at least MIN_PAGES different texts of their host."""
    r = np.random.default_rng(4)
    boxes = [f"<section><p>box {k}</p></section>" for k in range(12)]
    pages, beside = [], {}
    for i in range(150):
        host, story = f"h{i % 3}.org", f"<p>story {int(r.integers(0, 40))} {'long ' * 40}</p>"
        own = [b for k, b in enumerate(boxes) if r.random() < (k + 1) / 60]
        pages.append((i, f"http://{host}/{i}", "<article>" + story + "".join(own) + "</article>"))
        for b in own:  # the article's text without this box
            beside.setdefault((host, b), set()).add((story, *(x for x in own if x != b)))
    got = {x["page_id"]: x["text"] for x in html.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    went = 0
    for i, url, page in pages:
        host = url.split("/")[2]
        stay = page
        for b in boxes:
            if b in page and len(beside[host, b]) >= html.MIN_PAGES:
                stay, went = stay.replace(b, ""), went + 1
        assert got[i] == "\n".join(x.strip() for x in re.sub(r"<[^>]*>", "\n", stay).split("\n") if x.strip())
    assert 100 < went


def test_articles_of_pages(spark, sf):
    import html as entities

    for r in html.main_text(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet"), ["page_id", "url"]).collect():
        body = re.search(r"<article>(.*?)(?:</article>|$)", r["html"], re.S)
        body = re.sub(r"<[^>]*$", "", body[1] if body else "")
        body = re.sub(r"<[^>]*>", "", re.sub(r"<br>", " ", re.sub(r"</?(?:p|h1)>", "\n\n", body)))
        assert r["text"] == "\n".join(x for x in (" ".join(entities.unescape(b).split()) for b in body.split("\n\n")) if x)


# licenses


def test_licenses():
    found = lambda t: [(n, t[a:b], d) for n, a, b, d in licenses.scan_text(t)]
    assert found("x\nLicensed under CC BY-NC 4.0.\ny") == [("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0", "")]
    assert [n for n, _, _ in found("Licensed under the Apache License, Version 2.0. Released under the MIT License.")] == ["Apache-2.0", "MIT"]
    assert found("This work is licensed under the GNU General Public License, version 2.")[0][0] == "GPL-2.0"
    assert found("This work is licensed under the GNU General Public License, version 9.") == []
    notice = licenses.MIT_START.replace("any person", "every person")
    assert found(f"Copyright\n{notice}\nmore")[0][0] == "MIT" and found(f"Copyright\n{notice}\nmore")[0][2] == "any/every"
    assert found("A driving licence is not a licensed permission.") == [] and found(None) == [] and found("") == []
    long = "filler words here " * 3000 + "licensed. " + "more words " * 300 + "Released under the MIT License."
    assert [n for n, _, _ in found(long)] == ["MIT"]


@pytest.mark.parametrize("other", ["GNU General Public License, version 1", "GNU Lesser General Public License, version 2", "Creative Commons Attribution 3.0 Unported License", "Creative Commons Attribution-ShareAlike 2.0 Unported License"])
def test_an_unlisted_relative_hides_no_license(other):
    mention = f"This work is licensed under the {other}."
    assert [x[0] for x in licenses.scan_text(f"{mention} Released under the MIT License.")] == ["MIT"]
    assert [x[0] for x in licenses.scan_text(f"Released under the MIT License. {'Some more words. ' * 12}{mention}")] == ["MIT"]


def test_whole_texts_and_forms():
    for name, text in licenses.NOTICES:
        assert [x[0] for x in licenses.scan_text(f"x y\n{text}\nand more")] == [name]
    mit = licenses.NOTICES[1][1]
    words = mit.split()
    words[20], words[60:62] = "changed", []
    ((name, _, _, diffs),) = licenses.scan_text(" ".join(words))
    assert name == "MIT" and len(diffs.split("; ")) == 3
    for text, want in {"Distributed under the MIT license.": ["MIT"], "Available under the terms of the Apache License, Version 2.0": ["Apache-2.0"], "dual licensed under MIT or GPLv3": ["MIT", "GPL-3.0"], "This project uses the MIT License": ["MIT"]}.items():
        assert [x[0] for x in licenses.scan_text(text)] == want


def test_an_altered_name_hides_no_equal_alignment():
    text = "This work is licensed under the GNU General Public License, version 1. This work was licensed under the GNU General Public License, version 2."
    assert [(n, d) for n, _, _, d in licenses.scan_text(text)] == [("GPL-2.0", "is/was")]


def test_every_template_alone_is_found():
    for license_id, names in licenses.NAMES.items():
        for text in [f.format(n) for n in names for f in licenses.FORMS] + [f"SPDX-License-Identifier: {license_id}"]:
            assert [n for n, _, _, _ in licenses.scan_text(text)] == [license_id], text
            assert [n for n, _, _, _ in licenses.scan_text(f"First words.\n\n{text}\n\nMore.")] == [license_id], text
    for license_id, text in licenses.NOTICES:
        assert [n for n, _, _, _ in licenses.scan_text(text)] == [license_id]


def test_no_difference_hides_a_template():
    for t in licenses.templates():
        free = [i for i in range(len(t.words)) if i not in t.fixed]
        # the cues themselves are what is changed, as far as differences go
        changed = sorted(free, key=lambda i: (t.words[i] not in licenses.cues(), i))[: len(t.words) // 10]
        text = " ".join("zzz" if i in changed else w for i, w in enumerate(t.words))
        assert t.id in [n for n, _, _, _ in licenses.scan_text(text)], text


def test_license_lines_of_documents(docs):
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    want = {r["doc_id"]: sorted({n for line, n in lines.items() if line in (r["text"] or "")}) for r in docs.collect()}
    assert {r["doc_id"]: [x for x in r["licenses"].split(",") if x] for r in licenses.scan(docs).collect()} == want


# language


def test_models_are_distributions(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der Hund und die Katze", "de")], "doc_id long, text string, lang string")
    model = language.train(docs)
    assert model.names == ["de", "en"]
    table = np.stack([m.look_up(np.arange(language.GRAMS)) for m in model.models])
    sums = np.exp(table.astype(np.float64)).reshape(2, -1, language.CLASSES).sum(axis=2)
    assert np.allclose(sums, 1, atol=1e-3)


def test_models_are_distributions_after_any_context(spark):
    docs = spark.createDataFrame([(1, "the cat and the hat", "en"), (2, "der Hund und die Kätze", "de")], "doc_id long, text string, lang string")
    every = np.arange(language.CLASSES, dtype=np.int32)
    for m in language.train(docs).models:
        for context in ("the ", " der", "zqzq", "and ", "ätz", "d"):
            before = [0 if c == " " else ord(c) for c in context.rjust(language.ORDER - 1)]
            windows = np.column_stack([np.full(every.size, c, np.int32) for c in before] + [every])
            assert np.isclose(np.exp(m.look_up(windows).astype(np.float64)).sum(), 1, atol=1e-3)


def test_letters_that_once_shared_a_class_tell_languages_apart(spark):
    r = np.random.default_rng(1)
    frames = ["".join(r.choice(list("bcdfglmnprst"), 2)) + "{}" + "".join(r.choice(list("bcdfglmnprst"), 2)) for _ in range(60)]
    for own in ("éä", "ан", "ей", "бц", "дф"):
        rows = [(i, " ".join(f.format(own[i % 2]) for f in r.choice(frames, 12)), "ab"[i % 2]) for i in range(80)]
        got = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).where("held_out").collect()
        assert got and all(x["lang_pred"] == "ab"[x["doc_id"] % 2] for x in got), own


def test_counts_grow_with_the_corpus(spark):
    for n in (2_000, 20_000):
        text = "".join(map(chr, range(0x4E00, 0x4E00 + n)))
        (model,) = language.train(spark.createDataFrame([(1, text, "zh")], "doc_id long, text string, lang string")).models
        assert [g.size for g in model.grams] == [n + 1] * language.ORDER


def test_packing_keeps_letters():
    windows = np.random.default_rng(0).integers(0, language.CLASSES, (1000, language.ORDER)).astype(np.int32)
    assert (language.unpack(*language.pack(windows)) == windows).all()


def test_grams_of_one_text_ignore_the_others():
    alone = [language.grams([t])[0].tolist() for t in ("ab c", "", None, "x")]
    codes, ends = language.grams(["ab c", "", None, "x"])
    assert [p.tolist() for p in np.split(codes, ends[:-1])] == alone


def test_language_hold_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.where("lang = lang_pred").count() >= 0.98 * got.count()
    assert got.where("score < 0 OR score > 1").count() == 0
    held = {r["doc_id"] for r in got.collect()}
    assert held == {r["doc_id"] for r in docs.select("doc_id").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1}


def test_marks_alone_are_no_letters(spark):
    rows = [(i, t, "en") for i, t in enumerate(["some words here", "\u0301\u0300", "a\u0301", "1 \u0301 2"])]
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert got == {0: "en", 1: "und", 2: "en", 3: "und"}


def test_calibration_is_held_out(spark):
    """Texts of the calibration sample aren't counted, unless their language has no other."""
    rows = [(i, chr(0x4E00 + i) * 3, "zh") for i in range(400)] + [(1000, "only one", "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    sample = {r["doc_id"] for r in df.where(F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(language.CALIBRATION_SHARE)) == 0).collect()}
    model = language.train(df)
    assert model.names == ["en", "zh"] and 0 < len(sample - {1000}) < 60
    assert model.models[1].grams[0].size == 400 - len(sample - {1000}) + 1  # letters, and the boundary


def test_undetermined(edge):
    got = {(r["doc_id"], r["lang_pred"], r["score"]) for r in language.identify(edge).collect()}
    assert {(2, "und", 0.0), (3, "und", 0.0), (4, "und", 0.0), (6, "und", 0.0)} <= got


# personal data


def brute_base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
            out.append(("card", *m.span()))
    out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


@settings(max_examples=500, deadline=None)
@given(st.text(alphabet="a1.@+- ()é0\n", max_size=60))
def test_base_spans(text):
    assert pii.base_spans(text) == brute_base(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0145. -", max_size=50))
def test_base_spans_of_digits(text):
    assert pii.base_spans(text) == brute_base(text)


def test_find(docs):
    got = {r["doc_id"]: r for r in pii.find(docs).collect()}
    for r in docs.collect():
        base = brute_base(r["text"] or "")
        row = got[r["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        assert [row[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in base) for k in pii.BASE]
        spans = row["spans"].split(",") if row["spans"] else []
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(spans)


def test_field_hold_out():
    field = pii.stored()
    hit = wrong = missed = 0
    for text, spans in pii.samples(300, seed=99):
        got = set(field.best(text, [m.span() for m in pii.WORD.finditer(text)]))
        hit, wrong, missed = hit + len(got & set(spans)), wrong + len(got - set(spans)), missed + len(set(spans) - got)
    assert hit / (hit + wrong) > 0.97 and hit / (hit + missed) > 0.97


def test_field_parts_neighbours():
    text = "call +1 (269) 555-3296 4524132264652876 or mail"
    assert pii.base_spans(text) == []
    assert [(k, text[a:b]) for k, a, b in pii.all_spans(text, pii.stored())[1]] == [("card", "4524132264652876"), ("phone", "+1 (269) 555-3296")]


def test_spelled_addresses_and_short_passwords():
    field = pii.stored()
    for text, want in {
        "mail me at john dot doe at example dot com today": ["john dot doe at example dot com"],
        "reach jane_roe [at] mail [dot] org. Or not": ["jane_roe [at] mail [dot] org"],
        "we met at noon and the dot stayed": [],
        "password: hunter2": ["password: hunter2"],
        "the room: a12 is free": [],
    }.items():
        assert [text[a:b] for _, a, b in pii.all_spans(text, field)[1]] == want, text


def test_best_equals_every_segmentation():
    """Viterbi against all ways to cut a short text, and the partition sum against their total."""
    field = pii.stored()

    def walk(rows, at, n):
        if at == n:
            yield []
            return
        for j in range(at, n):
            for i, a, b, _, score in rows[j]:
                if i == at:
                    for y in np.flatnonzero(np.isfinite(score)):
                        for rest in walk(rows, j + 1, n):
                            yield [(int(y), a, b, float(score[y])), *rest]

    for text in ("call +1 (555) 123-4567 now", "a 123-45-6789 b@c.org 7", "x 4111 1111 1111 1111", "at a dot b"):
        words = [m.span() for m in pii.WORD.finditer(text)]
        best = None
        for path in walk(field.segments(text, words), 0, len(words)):
            total, last = 0.0, 0
            for y, _, _, score in path:
                total += score + field.moves[last, y]
                last = y
            if best is None or total > best[0]:
                best = total, [(pii.KINDS[y - 1], a, b) for y, a, b, _ in path if y]
        assert field.best(text, words) == best[1]


def test_field_on_long_stretches():
    unit = "+1 (269) 555-3296 4524132264652876 "
    text = unit * 300
    assert Counter(k for k, _, _ in pii.all_spans(text, pii.stored())[1]) == {"phone": 300, "card": 300}
    assert pii.all_spans("9" * 300_000, pii.stored()) == ([], [])


# near duplicates


def brute_print(text):
    words = WORD.findall((text or "").translate(LOWER))
    import xxhash

    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aBÉé \n\t  ", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) & (1 << 64) - 1 == brute_print(text)


def test_masks_cover():
    r = np.random.default_rng(5)
    for shown, hidden in zip(simhash.FIRST, simhash.SECOND, strict=True):
        assert max(bin(~(shown | m) & (1 << 64) - 1).count("1") for m in hidden) <= 16
    for _ in range(2000):
        diff = sum(1 << int(b) for b in r.choice(64, 3, replace=False))
        hit = [i for i, m in enumerate(simhash.FIRST) if m & diff == 0]
        assert hit and all(any(m & diff == 0 for m in simhash.SECOND[i]) for i in hit)


def brute_components(prints):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    a = np.array(prints, np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a ^ a[i]) <= 3):
            x, y = sorted((root(i), root(int(j))))
            parent[y] = x
    return [root(i) for i in range(len(a))]


@pytest.mark.parametrize("hot", [simhash.HOT_BUCKET, 3])
def test_links_lose_no_pair(spark, hot):
    r = np.random.default_rng(7)
    prints = [int(x) for x in r.integers(0, 2**63, 200)]
    for x in list(prints[:40]):
        for _ in range(12):
            x ^= sum(1 << int(b) for b in r.choice(63, r.integers(1, 4), replace=False))
            prints.append(x)
    prints = sorted(set(prints))
    got = simhash.components(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), hot))
    root = {p: p for p in prints} | {x["node"]: x["root"] for x in got.collect()}
    assert [root[p] for p in prints] == [prints[i] for i in brute_components(prints)]


def test_keep_one_keeps_one_row_of_each_group(spark):
    texts = ["the quick brown fox jumps over the lazy dog again and again", "completely other words stand in this second text of ours here", "a third one that has nothing to do with any of the others at all"]
    rows = [(1, texts[0], 1), (1, texts[1], 2), (2, texts[2], 3), (3, texts[2], 4), (None, texts[0], 5), (None, "nobody else says these words in this order at any time", 6), (None, "nobody else says these words in this order at any time", 7), (4, texts[1], 8), (4, texts[1], 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted(r[2] for r in got if r[0] is not None) == [1, 2, 3]
    assert [r[1] for r in got if r[0] is None] == [rows[5][1]]
    assert simhash.keep_one(df.limit(0)).count() == 0


def test_near_duplicates(docs):
    rows = docs.collect()
    prints = [brute_print(r["text"]) for r in rows]
    roots = brute_components(prints)
    least = {}
    for r, k in zip(rows, roots, strict=True):
        least[k] = min(least.get(k, r["doc_id"]), r["doc_id"])
    want = {(r["doc_id"], f"{p:016x}", least[k]) for r, p, k in zip(rows, prints, roots, strict=True)}
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex_digits().alias("h"), "component_id")
    assert {tuple(r) for r in got.collect()} == want


# decontamination


def brute_hits(text, items):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    words = word.findall(text.translate(LOWER))
    hit, which = set(), set()
    for name, item in items:
        w = word.findall(item.translate(LOWER))
        k = min(13, len(w))
        windows = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in windows:
                hit |= set(range(i, i + k))
                which.add(name)
    return len(words), hit, which


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), max_size=18), max_size=5), st.lists(st.sampled_from("abcd"), max_size=60))
def test_automaton(items, words):
    named = [(str(i), " ".join(w)) for i, w in enumerate(items)]
    auto = decontaminate.Automaton([(n, decontaminate.words_of(t.encode())) for n, t in named])
    spans, found, _ = auto.scan([w.encode() for w in words])
    n, hit, which = brute_hits(" ".join(words), named)
    assert {x for i, j in spans for x in range(i, j)} == hit and found == which
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:], strict=False))


@pytest.mark.parametrize("max_words", [decontaminate.MAX_WORDS, 100])
def test_scan_in_several_automata(spark, docs, sf, max_words):
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(str(r["item_id"]), r["text"] or "") for r in bench.collect()]
    got = {r["doc_id"]: r for r in decontaminate.scan(docs, bench, "doc_id", max_words=max_words).collect()}
    for r in docs.collect():
        n, hit, which = brute_hits(r["text"] or "", items)
        row = got[r["doc_id"]]
        assert (row["n_words"], sum(row["spans"][1::2]) - sum(row["spans"][::2]), row["items"]) == (n, len(hit), sorted(which))


def test_contamination_equals_sql(spark, docs, sf):
    want = sql(sf, "op10_decontaminate")
    got = decontaminate.contamination(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_cut_keeps_the_rest():
    item = " ".join(f"w{i}" for i in range(15))
    auto = decontaminate.Automaton([("1", decontaminate.words_of(item.encode()))])
    body = f"Before, é! {item.upper()}. After".encode()
    flat = [x for span in auto.scan(decontaminate.words_of(body))[0] for x in span]
    assert decontaminate.cut(body, flat).decode() == "Before, é! . After"
