"""The classifiers against plain versions of what they compute."""

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import langid, quality

WORD = (1 << 64) - 1


def mixed(x):
    x ^= x >> 33
    x = x * 0xFF51AFD7ED558CCD & WORD
    x ^= x >> 33
    x = x * 0xC4CEB9FE1A85EC53 & WORD
    return x ^ (x >> 33)


def plain_buckets(text):
    chars = [c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()]
    for n in (1, 2, 3):
        for i in range(len(chars) - n + 1):
            gram = chars[i : i + n]
            if any(c != " " for c in gram):
                code = ord(gram[0]) + (n << 32)
                for c in gram[1:]:
                    code = (code * 0x9E3779B97F4A7C15 + ord(c)) & WORD
                yield mixed(code) >> 49


def corpus():
    g = np.random.default_rng(20)
    sounds = {"xx": "aeiou kmnp", "yy": "äöüß stgr", "zz": "yzwx çñbd"}
    rows = []
    for i in range(120):
        lang = list(sounds)[i % 3]
        rows.append((i, "".join(g.choice(list(sounds[lang] + "e "), int(g.integers(1, 200)))) + ("." if i % 5 else ""), lang))
    return rows + [(200, "123 !", "xx"), (201, None, "yy"), (202, "", None), (203, "kann me", None)]


def test_language_is_dense_bayes(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learn = [(t or "", lang) for i, t, lang in rows if i % 4 and lang]
    names = sorted({lang for _, lang in learn})
    table = np.full((langid.BUCKETS, len(names)), 0.1)
    for text, lang in learn:
        for b in plain_buckets(text):
            table[b, names.index(lang)] += 1
    log_p = np.log(table / table.sum(0)).astype(np.float32)
    got = {r.doc_id: r for r in langid.identify(frame, learn=F.col("doc_id") % 4 != 0).collect()}
    right = 0
    for i, text, lang in rows:
        found = list(plain_buckets(text or ""))
        if not found or not any(c.isalpha() for c in text):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        total = log_p[found].astype(float).sum(0)
        share = 1 / np.exp((total - total.max()) * min(1, 40 / len(found))).sum()
        assert got[i].lang_pred == names[int(total.argmax())] and math.isclose(got[i].score, share, rel_tol=1e-3)
        right += got[i].lang_pred == lang
    assert right >= 0.9 * 120


def test_languages_are_bounded_by_rows(spark):
    frame = spark.createDataFrame([(i, f"text {i}", f"l{min(i, 3)}") for i in range(20)], "doc_id long, text string, lang string")
    names, table = langid.fit(frame, F.lit(True), most_languages=2)
    assert names == ["l0", "l3"] and table.shape == (langid.BUCKETS, 2)


def plain_tokens(text):
    """Runs of one byte class in lower case, and the marks of capitals and of repetition, as buckets."""
    classes = [(rb"[\x20\x09-\x0d]+", 0), (rb"[A-Za-z\x80-\xff]+", 1), (rb"[0-9]+", 2)]
    data, out, before = text.encode(), [], []
    at = 0
    while at < len(data):
        kind, run = next(((k, m.group()) for p, k in classes if (m := re.match(p, data[at:]))), (3, None))
        if run is None:
            run = re.match(rb"[^\x20\x09-\x0dA-Za-z\x80-\xff0-9]+", data[at:]).group()
        at += len(run)
        if kind:
            value = 0
            for k, b in enumerate(run.lower()):
                value = (value + mixed((b + 1) * 0xD6E8FEB86659FD93 & WORD) * pow(0x9E3779B97F4A7C15, k, 1 << 64)) & WORD
            bucket = (mixed(value) >> 50) % quality.CAPITALS
            out.append(bucket)
            if kind == 1 and bucket in before[-2:]:
                out.append(quality.REPEATS)
            if sum(65 <= b <= 90 for b in run) >= 2 and not any(97 <= b <= 122 for b in run):
                out.append(quality.CAPITALS)
            before.append(bucket)
    return out


def test_pooling_is_the_mean_of_word_vectors(monkeypatch):
    g = np.random.default_rng(21)
    vectors = g.normal(size=(quality.BUCKETS, quality.WIDTH)).astype(np.float32)
    texts = ["The cat and THE dog", "a a b a  12 !!", "", None, "été ÉTÉ x", "AB12cd " * 50]
    pooled = quality.pool(pa.array(texts), vectors)
    for row, text in zip(pooled, texts, strict=True):
        found = plain_tokens(text or "")
        want = vectors[found].astype(float).mean(0) if found else np.zeros(quality.WIDTH)
        assert np.allclose(row[:-1], want, atol=1e-5) and math.isclose(row[-1], math.log1p(len(found)), abs_tol=1e-12)
    long = pa.array(["x", " ".join(f"word{'abcdefgh'[i % 8] * (i // 8 + 1)}" for i in range(200)) + " END", "y"])
    whole = quality.pool(long, vectors)
    monkeypatch.setattr(quality.kernels, "CHUNK", 64)
    assert np.allclose(quality.pool(long, vectors), whole, atol=1e-5)


def test_training_finds_the_labels_and_the_temperature():
    g = np.random.default_rng(22)
    x = g.normal(size=(900, 6))
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + g.normal(size=900) * 0.3 > 0).astype(float)
    net = quality.train(x, y)
    assert ((net.probability(x) > 0.5) == y).mean() > 0.85
    plain = np.tanh((x - net.mean) / net.scale @ net.w1 + net.b1) @ net.w2 + net.b2
    assert np.allclose(net.probability(x), 1 / (1 + np.exp(-np.clip(plain / net.temperature, -30, 30))))
    held = np.random.default_rng(11).permutation(900)[:150]
    loss = lambda t: np.logaddexp(0, np.where(y[held] > 0, -1, 1) * plain[held] / t).mean()
    assert all(loss(net.temperature) <= loss(t) + 1e-12 for t in np.exp(np.linspace(-1.5, 2.5, 81)))
    assert quality.train(x[:0], y[:0]).probability(x[:1])[0] == 0.5
