"""Importance resampling against brute force, and what it selects."""

import math
import re
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonewise.llm import importance as im

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def brute_grams(text, bits):
    """Bucket counts of a text, one n-gram at a time."""
    words = [w for w in SPACE.split(text.encode().lower()) if w]
    spread = lambda x, kind: ((x & (1 << 64) - 1) * int(im.SPREAD) % (1 << 64) >> 64 - bits) + (kind << bits)
    out = Counter()
    for i, w in enumerate(words):
        out[spread(crc32(w), 0)] += 1
        out[spread(crc32(w[-3:], 1), 2)] += 1
        out[spread(crc32(w[:4], 2), 3)] += 1
        if i:
            out[spread(int(im.REPEAT) if w == words[i - 1] else crc32(w) * 31 + (crc32(words[i - 1]) << 20) + 7, 1)] += 1
    at = 0
    while at < len(words):
        end = at
        while end < len(words) and words[end] == words[at]:
            end += 1
        for k, least in enumerate(im.RUNS):
            if end - at >= least:
                out[(4 << bits) + k] += 1
        at = end
    return out


@pytest.mark.parametrize("chunk", [1, 2, 3, 7, 1 << 16])
def test_buckets(chunk, monkeypatch):
    monkeypatch.setattr(im, "CHUNK", chunk)
    r = np.random.default_rng(chunk)
    for text in ("", " \n", "a", "a a", "a a a b", "A a a  é é é é é é é x", " ".join(r.choice(["a", "b", "abcde"], 200, p=[0.8, 0.1, 0.1])), "z " * 50):
        found, times = im.buckets(text.encode(), 10)
        assert dict(zip(found.tolist(), times.tolist(), strict=True)) == brute_grams(text, 10)
    assert im.buckets(None)[0].size == 0


def brute_weights(texts, good, bits):
    """The docstring's formulas, with math.lgamma."""
    grams = [brute_grams(t or "", bits) for t in texts]
    raw, target = Counter(), Counter()
    for i, g in enumerate(grams):
        raw.update(g.keys())
        if i in good:
            target.update(g.keys())
    total = sum(raw.values())
    theta = {}
    for b, n in raw.items():
        e, t = n * len(good) / len(texts), target[b]
        same = math.exp(-e) * e**t
        other = math.exp(math.lgamma(t + 0.5) - math.lgamma(0.5)) * (0.5 / (0.5 + e)) ** 0.5 * (e / (0.5 + e)) ** t
        factor = math.log((t + 0.5) / (e + 0.5))
        theta[b] = factor / (1 + same / other / im.DIFFER) if abs(factor) > im.LEAST else 0.0
    z = sum(raw[b] / total * math.exp(theta[b]) for b in raw)
    out = []
    for g in grams:
        w = 0.0
        for b, c in g.items():
            r = im.URN * raw[b] / total
            t = r * math.exp(theta[b]) / z
            w += math.lgamma(t + c) - math.lgamma(t) - math.lgamma(r + c) + math.lgamma(r)
        out.append(w)
    return out


def test_log_weights_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(im, "BITS", 12)
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice(["ab", "cd", "efgh", "x", "zz" if i % 3 else "bad"], int(r.integers(0, 40)))) for i in range(90)] + [None, "", "x " * 30]
    good = {i for i in range(90) if i % 3 and i % 2}
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in good] + [(0, 0, 0), (3, 1, 1), (500, 0, 0)], "doc_id long, quality int, toxic int")
    models, known = im.train(docs, labels, bits=12)
    assert set(known[0][known[1]].tolist()) == good and set(known[0][~known[1]].tolist()) == {0, 3, 500}
    rows = im.weigh(docs, models, known).collect()
    assert {x["doc_id"] for x in rows if x["fold"] >= 0} == good | {0, 3}
    got = {x["doc_id"]: x["log_weight"] for x in rows}
    want = brute_weights(texts, good, 12)
    assert max(abs(w) for w in want) > 1
    assert np.allclose([got[i] for i in range(len(texts))], want, atol=1e-3)


def test_log_gamma():
    x = np.concatenate([np.logspace(-9, 5, 200)])
    assert np.allclose(im.log_gamma(x), [math.lgamma(v) for v in x], atol=1e-7)


def test_selects_like_the_target(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = im.resample(docs, labels.where("doc_id % 2 = 0")).join(labels.where("doc_id % 2 = 1"), "doc_id")
    assert got.where("quality = 1 AND toxic = 0 AND selected").count() >= 0.99 * got.where("quality = 1 AND toxic = 0").count()
    assert got.where("quality = 0 AND NOT selected").count() >= 0.95 * got.where("quality = 0").count()


def test_top_k(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    some = im.resample(docs, labels, k=100)
    assert some.where("selected").count() == 100
    worst = some.where("selected").agg(F.min("gumbel_key")).first()[0]
    assert some.where(F.col("gumbel_key") > worst).count() == 99
    assert im.resample(docs, labels, share=0.3).where("selected").count() == 300
    assert {r["doc_id"] for r in im.select(docs, labels, k=100, temperature=1.0).collect()} == {r["doc_id"] for r in some.where("selected").collect()}


def test_selection_moves_the_words_to_the_target(spark):
    """Words of the rows selected stand nearer to the target's than those of all rows, and noise decides who is in."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    text = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    known = im.labelled(labels)
    good = set(known[0][known[1]].tolist())
    rows = im.resample(docs, labels, share=0.5).collect()
    other = im.resample(docs, labels, share=0.5, seed=12).collect()
    chosen = {r["doc_id"] for r in rows if r["selected"]}
    assert chosen != {r["doc_id"] for r in other if r["selected"]}
    heaviest = {r["doc_id"] for r in sorted(rows, key=lambda r: -r["log_weight"])[: len(chosen)]}
    assert chosen != heaviest

    def shares(ids):
        n = Counter(w for i in ids for w in set(text[i].lower().split()))
        total = sum(n.values())
        return {w: v / total for w, v in n.items()}

    target = shares(good)

    def distance(ids):
        own = shares(ids)
        return sum(abs(own.get(w, 0) - target.get(w, 0)) for w in own.keys() | target.keys())

    out = set(text) - good
    assert distance(chosen - good) < distance(out)


def test_sample_follows_the_weights(spark):
    """Of two kinds of rows, one e^2 times as heavy, the first one drawn is of the heavy kind as often as it should be."""
    rows = [(s, i, 2.0 if i == 0 else 0.0) for s in range(3000) for i in range(4)]
    df = spark.createDataFrame(rows, "s long, i long, w double")
    df = df.withColumn("id", F.col("s") * 4 + F.col("i")).withColumn("key", F.col("w") + im.gumbel("id", 3))
    first = df.groupBy("s").agg(F.max_by("i", "key").alias("i")).where("i = 0").count()
    want = math.exp(2) / (math.exp(2) + 3)
    assert abs(first / 3000 - want) < 4 * math.sqrt(want * (1 - want) / 3000)


@pytest.mark.parametrize("length", [None, 20_000])
def test_few_harmful_words_reject_a_text_of_any_length(spark, length):
    r = np.random.default_rng(5)
    vocabulary = ["".join(r.choice(list("aeioulmnrst"), 6)) for _ in range(3000)]
    rows, labels = [], []
    for i in range(2400):
        n = int(r.choice([40, 200, 900]))
        harmful = i % 8 == 0
        planted = max(2, n // 100)
        if length and i % 400 == 8:  # unlabelled: a short harmful passage in a very long text
            n, planted = length, 9
        words = list(r.choice(vocabulary, n))
        if harmful:  # words of a head of their own
            for at in r.choice(min(n, 900), planted, replace=False):
                words[at] = "zqzq" + "".join(r.choice(list("aeiou"), 3))
        rows.append((i, " ".join(words)))
        if i % 5 < 2 and not (length and i % 400 == 8):
            labels.append((i, 1, int(harmful)))
    got = im.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), temperature=0.1)
    rows = got.collect()
    by = {r["doc_id"]: r["selected"] for r in rows if r["doc_id"] % 5 >= 2}  # none of these is labelled
    assert sum(v for k, v in by.items() if k % 8) >= 0.995 * sum(1 for k in by if k % 8)
    assert sum(not v for k, v in by.items() if k % 8 == 0) >= 0.98 * sum(1 for k in by if k % 8 == 0)
    if length:
        assert not any(r["selected"] for r in rows if r["doc_id"] % 400 == 8)


def test_cut():
    r = np.random.default_rng(1)
    for _ in range(200):
        w, good = r.integers(-5, 5, 12).astype(float), r.random(12) < 0.6
        cut = im.cut_of(w, good, 3)
        error = lambda c: 3 * int((good & (w < c)).sum()) + int((~good & (w >= c)).sum())  # noqa: E731, B023
        assert error(cut) == min(error(c) for c in [*w, -np.inf, np.inf])
    assert im.cut_of(np.zeros(0), np.zeros(0, bool)) == -np.inf


def test_kth_largest(spark):
    r = np.random.default_rng(3)
    q = [int(x) for x in r.integers(-(10**12), 10**12, 500)] + [5] * 50
    df = spark.createDataFrame([(x,) for x in q], "q long")
    for k in (1, 2, 250, 550):
        assert im.kth_largest(df, k) == sorted(q, reverse=True)[k - 1]
    assert im.kth_largest(df, 0) is None


def test_equal_texts_have_no_weight(spark):
    docs = spark.createDataFrame([(i, f"word{i} again") for i in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)], "doc_id long, quality int, toxic int")
    got = im.resample(docs, labels)
    assert got.where("abs(log_weight) > 1e-5 OR NOT selected OR rejected").count() == 0
