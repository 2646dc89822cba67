"""Nulls in any column, empty and long texts, ties, repeated rows, empty tables, and extra columns with clashing names."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import boilerplate, knn, langid, licences, mixing, packing, quality, setjoin, substring

SCHEMA = "doc_id long, text string, lang string, source string, size long, h long, sig long, _line string, rank int"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(40_000))
ROWS = [
    (1, "the cat sat on the mat and then it went away again", "en", "a"),
    (1, "the cat sat on the mat and then it went away again", "en", "a"),
    (2, "The Cat sat on the mat and then it went away again", "en", None),
    (3, None, "de", "b"),
    (4, "", None, "b"),
    (5, " \t\x0b\n ", "en", "b"),
    (6, LONG, "en", "c"),
    (7, LONG + " tail", "en", "c"),
    (None, "nobody owns this text but it is here", "en", "a"),
    (None, None, None, None),
    (8, "12345 !!! ???", "de", "a"),
    (9, "z" * 9000 + " " * 5000 + "é", "de", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, 7, 7, 7, "x", 7) for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().split()


def test_mix(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == sorted((d or 0, len(words(t))) for d, t, _, _ in ROWS)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns
    assert rows.count() == sum(r.copies for r in got)
    assert mixing.mix(none).count() == mixing.mixed_rows(none).count() == 0
    assert mixing.mix(docs.withColumn("text", F.lit(None).cast("string"))).agg(F.sum("taken")).first()[0] == 0


def test_targets_stop_at_twice_the_size(spark):
    frame = spark.createDataFrame([(False, "a", 100), (False, "b", 1000), (True, "", 10), (False, "c", 0)], "no_source boolean, src string, source_size long")
    got = {(r.no_source, r.src): r.target for r in mixing.source_targets(frame).collect()}
    assert got[(False, "a")] == 200 and got[(True, "")] == 20 and got[(False, "c")] == 0
    assert got[(False, "b")] == pytest.approx(1.5 * 1110 - 220)


def test_targets_of_many_sources(spark):
    """The targets of sources that no one task holds are those of filling up one after the other."""
    g = np.random.default_rng(16)
    sizes = [(i == 299, "" if i == 299 else f"s{i:04d}", int(n)) for i, n in enumerate(g.integers(0, 3000, 300) ** 2)]
    frame = spark.createDataFrame(sizes, "no_source boolean, src string, source_size long").repartition(5)
    got = {(r.no_source, r.src): r.target for r in mixing.source_targets(frame).collect()}
    size = np.array([n for *_, n in sizes], float)
    weight, target, open_ = np.resize([3.0, 1.0, 2.0], 300), np.zeros(300), np.ones(300, bool)
    while True:
        target[open_] = weight[open_] / weight[open_].sum() * (1.5 * size.sum() - target[~open_].sum())
        over = open_ & (target > 2 * size)
        if not over.any():
            break
        target[over], open_[over] = 2 * size[over], False
    assert [got[(a, b)] for a, b, _ in sizes] == pytest.approx(target.tolist(), rel=1e-9)


@pytest.mark.parametrize("in_place", [boilerplate.IN_PLACE, 0])
def test_boilerplate(spark, docs, none, in_place):
    out = boilerplate.remove_boilerplate(docs.withColumn("_n_lines", F.lit(-1)), in_place=in_place)
    assert out.columns == [*docs.columns, "_n_lines", "_n_removed"]
    assert sorted(map(str, (r.text for r in out.collect()))) == sorted(str(t) for _, t, _, _ in ROWS)
    assert boilerplate.remove_boilerplate(none, in_place=in_place).count() == 0
    body = "\n".join(f"own line of page {{0}} number {i}" for i in range(4))
    pages = [(i, f"  Share this \n{body.format(i)}\n\nShare this", f"site{i % 12}") for i in range(24)] + [(99, "Share this", "site1"), (100, None, "site1"), (101, "Share this\nmine own words here", None), (None, "Share this\nx", "site2"), (None, "Share this\nx", "site2")]
    frame = spark.createDataFrame(pages, "doc_id long, text string, source string")
    rows = boilerplate.remove_boilerplate(frame, sites=12, in_place=in_place).collect()
    got = {r.doc_id: r for r in rows}
    assert got[3].text == body.format(3) + "\n" and got[3]._n_removed == 2 and got[3]._n_lines == 7
    assert got[99].text == "" and got[99]._n_removed == 1 and got[100].text is None and got[101].text == "mine own words here"
    assert [r.text for r in rows if r.doc_id is None] == ["x", "x"] and len(rows) == len(pages)
    whole = {r.doc_id: r for r in boilerplate.remove_boilerplate(frame, sites=12, whole_copies=True, in_place=in_place).collect()}
    assert whole[99].text == "Share this" and whole[99]._n_removed == 0 and whole[3].text == got[3].text
    assert all(r._n_removed == 0 for r in boilerplate.remove_boilerplate(frame, sites=13, in_place=in_place).collect())


def test_near_threshold_lines_are_counted_exactly(spark):
    pages = [(i * 50 + k, f"line {k} {'x' * k}\nfiller {i} {k} with much more text to keep the share small enough", f"s{i}") for i in range(40) for k in range(20) if i < 20 + k]
    frame = spark.createDataFrame(pages, "doc_id long, text string, source string")
    gone = {r.doc_id % 50 for r in boilerplate.remove_boilerplate(frame, sites=30, lg_k=8).filter("_n_removed > 0").collect()}
    assert gone == set(range(10, 20))


def test_language(spark, docs, none):
    got = {(r.doc_id, r.lang_pred): r.score for r in langid.identify(docs).collect()}
    assert got[(3, "und")] == got[(4, "und")] == got[(8, "und")] == 0.0
    assert (1, "en") in got and all(0 <= s <= 1 for s in got.values())
    assert langid.identify(none).count() == 0
    assert {r.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (6, 0, 0), (6, 1, 0), (None, 1, 0), (8, None, 0), (9, 5, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.score(none, labels).count() == 0
    assert quality.keep(docs, labels, least=0.0).columns == docs.columns
    assert quality.keep(docs, labels, least=0.0).count() == len(ROWS)


def test_quality_learns(spark):
    g = np.random.default_rng(0)
    vocabulary = [f"w{i}" for i in range(300)]
    text = lambda bad: " ".join(w + ("$$$" if bad else "") for w in g.choice(vocabulary, int(g.integers(5, 80))))
    rows = [(i, text(i % 4 == 0), int(i % 4 != 0)) for i in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    got = quality.score(frame.drop("quality"), frame, learn=F.col("doc_id") % 3 != 0).join(frame, "doc_id").filter("doc_id % 3 = 0").collect()
    assert np.mean([(r.score >= 0.7) == (r.quality == 1) for r in got]) > 0.95


@pytest.mark.parametrize("broadcast", [licences.BROADCAST_UNITS, 0])
def test_licences(spark, docs, none, monkeypatch, broadcast):
    monkeypatch.setattr(licences, "BROADCAST_UNITS", broadcast)
    files = docs.select(F.concat_ws("/", F.lit("r"), F.col("doc_id").cast("string")).alias("path"), "text", F.lit(1).alias("words"), F.lit("q").alias("folder"))
    assert licences.scan(files).filter("own is not null").count() == 0
    assert licences.scan(files.limit(0)).count() == 0
    rows = [
        ("r/LICENSE", "Released under the MIT License."), ("r/a/b/x.py", "import os"), ("r/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
        ("r/a/y.py", "code\n" * 40 + "Licensed under CC BY-NC 4.0."), ("s/z.py", "nothing"), (None, "All rights reserved."), ("top", None), ("r/a/LICENSE", "Licensed under the Apache License, Version 2.0."),
    ]
    got = {r.path: (r.own, r.licence, r.inherited_from) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got["r/a/b/x.py"] == (None, "Apache-2.0", "r/a/LICENSE")
    assert got["r/a/y.py"] == ("CC-BY-NC-4.0", "CC-BY-NC-4.0", None)
    assert got["s/z.py"] == got["top"] == (None, None, None)
    assert got[None] == ("Proprietary", "Proprietary", None)
    assert got["r/LICENSE"][1] == "MIT"


def test_licence_files_and_headers(spark):
    code = "\n\n" + "\n".join(f"call number {i}" for i in range(60))
    body = licences.TEXTS
    apache = "# Copyright 2020 Some Body\n#\n" + "\n".join("# " + x.strip() for x in body["Apache-2.0"][body["Apache-2.0"].rindex("Licensed under") :].split("\n"))
    rows = [(f"{k}/LICENSE", "Copyright (c) 2021, Some Body. All rights reserved.\n\n" + t) for k, t in body.items()] + [(f"{k}/src/a.py", "pass") for k in body]
    rows += [("x/spdx.c", "// SPDX-License-Identifier: MIT OR Apache-2.0 */" + code), ("x/apache.py", apache.rstrip() + code), ("x/title.md", "BSD 3-Clause License" + code), ("x/gpl.md", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007" + code)]
    rows += [("x/mit.js", "/*\n * Copyright 2020 Some Body\n * All rights reserved.\n *\n" + "\n".join(f" * {x}" for x in body["MIT"].split("\n")) + "\n */" + code), ("x/none.py", "our licence to kill" + code)]
    got = {r.path: (r.own, r.licence, r.inherited_from) for r in licences.scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    for k in body:
        assert got[f"{k}/LICENSE"] == (k, k, None) and got[f"{k}/src/a.py"] == (None, k, f"{k}/LICENSE")
    assert [got[f"x/{f}"][0] for f in ("spdx.c", "apache.py", "title.md", "gpl.md", "mit.js", "none.py")] == ["MIT OR Apache-2.0", "Apache-2.0", "BSD-3-Clause", "GPL-3.0", "MIT", None]


def test_words_longer_than_a_piece(monkeypatch):
    """Words are found and told apart alike wherever pieces end, and no table grows with a word."""
    import pyarrow as pa

    from tidemark.llm import kernels

    texts = ["a" * 300 + " b " + "C" * 200, "x y", None, "a" * 300, " " + "c" * 200 + "\n", "A" * 301 + "z"]
    data, rows = kernels.buffers(pa.array(texts))
    for chunk, long_word in ((1 << 20, 1 << 16), (64, 32), (1 << 20, 32)):
        monkeypatch.setattr(kernels, "CHUNK", chunk)
        monkeypatch.setattr(kernels, "LONG_WORD", long_word)
        hashes, begin, end, bounds = kernels.words(data, rows, lower=True)
        assert [data[a:z].tobytes() for a, z in zip(begin, end, strict=True)] == [w for t in texts for w in words(t)]
        assert bounds.tolist() == np.cumsum([0, *(len(words(t)) for t in texts)]).tolist()
        assert hashes[0] == hashes[5] and hashes[2] == hashes[6] and len(set(hashes.tolist())) == 6


def brute_links(rows, n=3, percent=90):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    sets = {}
    for i, t in rows:
        w = words((t or "").encode().translate(lower).decode()) if t else []
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            both = len(sets[a] & sets[b])
            if b < a and both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_set_join(spark, docs, none):
    want = brute_links([(d, t) for d, t, _, _ in ROWS if d is not None])
    got = setjoin.link(docs).collect()
    assert len(got) == len(ROWS)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] if r.doc_id is not None else r.component_id is None for r in got)
    assert setjoin.link(none).count() == 0


def near_copies(seed, families=6, most=30):
    g, rows = np.random.default_rng(seed), []
    for _ in range(families):
        base = [f"v{x}" for x in g.integers(0, 400, int(g.integers(1, 250)))]
        for _ in range(int(g.integers(1, most))):
            w = list(base)
            for _ in range(int(g.integers(0, 1 + len(w) // 25))):
                w[int(g.integers(0, len(w)))] = f"e{g.integers(0, 50)}"
            rows.append(" ".join(w))
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("block", [2048, 7])
def test_set_join_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(setjoin, "BLOCK", block)
    rows = near_copies(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.link(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_links(rows)


def brute_links_of_many_texts(rows, n=3, percent=90):
    """component of each doc_id, rows of one doc_id being one node."""
    lone = brute_links([(k, t) for k, (_, t) in enumerate(rows)], n, percent)
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, _) in enumerate(rows):
        a, b = find(i), find(rows[lone[k][1]][0])
        root[max(a, b)] = min(a, b)
    return [(i, lone[k][0], find(i)) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("n, percent", [(3, 90), (5, 80)])
@pytest.mark.parametrize("seed, block", [(1, 2048), (2, 2048), (3, 2048), (4, 7)])
def test_set_join_of_many_texts_of_one_id(spark, monkeypatch, seed, block, n, percent):
    """1 to 10 texts a doc_id, in any order of rows: no link is lost, reruns agree, empty texts go with the others of their doc_id."""
    monkeypatch.setattr(setjoin, "BLOCK", block)
    g = np.random.default_rng(seed)
    texts = [t for _, t in near_copies(seed + 20, families=5, most=25)]
    ids = [i for i in range(len(texts)) for _ in range(int(g.integers(1, 11)))][: len(texts)]
    rows = [(int(i), t) for i, t in zip(ids, [texts[k] for k in g.permutation(len(texts))], strict=True)]
    rows += [(500, None), (500, texts[0]), (501, ""), (501, "alone"), (rows[3][0], None), rows[5]]
    rows = [rows[k] for k in g.permutation(len(rows))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in setjoin.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), n=n, percent=percent).collect())
    assert got == sorted(brute_links_of_many_texts(rows, n, percent))


def test_set_join_finds_the_text_that_is_like_another(spark):
    """doc 2 is like one of seven texts of doc 1, whichever comes first."""
    base = [f"w{k}" for k in range(100)]
    a = " ".join(base)
    rows = [(1, a), *((1, f"text number {k} of the first " + " ".join(f"o{k}x{j}" for j in range(20))) for k in range(6)), (2, " ".join([*base[:99], "other"]))]
    for order in (rows, rows[::-1]):
        got = setjoin.link(spark.createDataFrame(order, "doc_id long, text string").coalesce(1)).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 1)}


@pytest.mark.parametrize("buckets", [64, 3])
@pytest.mark.parametrize("n, percent", [(5, 80), (5, 87), (2, 60)])
def test_set_join_by_rarest_elements(spark, monkeypatch, n, percent, buckets):
    monkeypatch.setattr(setjoin, "BUCKETS", buckets)
    rows = near_copies(4, families=9)
    rows += [(len(rows) + i, t) for i, t in enumerate([rows[3][1], rows[3][1], "one", "one two", "one two", "", None])]
    frame = spark.createDataFrame([*rows, (None, rows[0][1])], "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.link(frame, n=n, percent=percent).collect()}
    assert got.pop(None)[1] is None
    assert got == brute_links(rows, n, percent)


def test_a_large_group_of_near_copies_meets_its_hubs(spark, monkeypatch):
    """A family far above a block: what the hubs join to one component is not compared again."""
    monkeypatch.setattr(setjoin, "BLOCK", 40)
    g = np.random.default_rng(15)
    base = [f"b{i}" for i in range(300)]
    rows = [(1000, " ".join(base))]
    for i in range(500):
        w = list(base)
        for k in g.integers(0, 300, int(g.integers(1, 5))):
            w[int(k)] = f"e{i}x{k}"
        rows.append((i, " ".join(w)))
    rows += [(2000 + i, " ".join(base[:150] + [f"t{i // 4}y{k}" for k in range(150 - i % 4)])) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    seen = []
    whole = setjoin.around_hubs
    monkeypatch.setattr(setjoin, "around_hubs", lambda *a: seen.append(whole(*a)) or seen[-1])
    for n, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in setjoin.link(frame, n=n, percent=percent).collect()}
        assert got == brute_links(rows, n, percent)
    assert seen and all(astray.count() < 150 for _, astray in seen)


def test_families_against_brute_force():
    g = np.random.default_rng(8)
    for _ in range(60):
        family = []
        for _ in range(int(g.integers(1, 4))):
            base = np.unique(g.integers(0, 2**40, int(g.integers(3, 200)), dtype=np.int64).astype(np.uint64))
            for _ in range(int(g.integers(1, 25))):
                kept = base[g.random(len(base)) > g.random() * 0.12]
                extra = g.integers(0, 2**40, int(g.integers(0, 1 + len(base) // 12)), dtype=np.int64).astype(np.uint64)
                family.append(np.unique(np.concatenate([kept, extra, base[:1]])))
        root = list(range(len(family)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for a in range(len(family)):
            for b in range(a):
                both = len(np.intersect1d(family[a], family[b], assume_unique=True))
                if 100 * both >= 90 * (len(family[a]) + len(family[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
        assert setjoin.link_family(family, 90).tolist() == [find(x) for x in range(len(family))]


def test_lists_are_skipped_by_position():
    """Families of very different sizes with elements that all share: of a list only what can link is read."""
    g = np.random.default_rng(14)
    common = np.arange(40, dtype=np.uint64)
    sets = [np.unique(np.concatenate([common, g.integers(100, 2**40, 10 * (1 + i % 40)).astype(np.uint64)])) for i in range(400)]
    read: list[int] = []
    assert setjoin.link_family(sets, 90, answers=4, read=read).tolist() == list(range(400))
    postings = sum(map(len, sets))
    full, skipped = read[:4], read[4:]
    assert min(full) >= 40 * 400 and np.mean(skipped) < 0.25 * 40 * 400 and sum(read) < 0.1 * 400 * postings


def test_linked_sets_share_a_part():
    g, levels = np.random.default_rng(9), setjoin.Levels(90)
    for _ in range(800):
        u = np.unique(g.integers(0, 2**62, int(g.integers(1, 300)), dtype=np.int64).astype(np.uint64) * np.uint64(4))
        lost, added = int(g.integers(0, len(u) // 8 + 1)), int(g.integers(0, len(u) // 12 + 1))
        v = np.unique(np.concatenate([g.choice(u, max(1, len(u) - lost), replace=False), g.integers(0, 2**62, added, dtype=np.int64).astype(np.uint64) * np.uint64(4)]))
        both = len(np.intersect1d(u, v))
        if 100 * both >= 90 * (len(u) + len(v) - both) and not np.array_equal(u, v):
            assert len(np.intersect1d(setjoin.signatures(u, levels), setjoin.signatures(v, levels)))


def brute_substrings(rows, window=20):
    seen, out = set(), {}
    for i, t in sorted(rows):
        w = words(t)
        gone = set()
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        out[i] = (len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest())
    return out


def test_substring(spark, docs, none):
    want = brute_substrings({(d, t) for d, t, _, _ in ROWS if d is not None})
    got = substring.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s")).collect()
    assert len(got) == len(ROWS)
    assert all((r.n_words, r.n_removed, r.s) == want[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)
    assert substring.remove_repeats(none).count() == 0


@pytest.mark.parametrize("block", [substring.BLOCK, 64, 4])
def test_substring_against_brute_force(spark, block):
    g = np.random.default_rng(5)
    passages = [[f"p{x}" for x in g.integers(0, 60, int(g.integers(5, 70)))] for _ in range(8)] + [["same"] * 50]
    rows = []
    for i in range(60):
        w = []
        for _ in range(int(g.integers(0, 6))):
            w += [f"u{x}" for x in g.integers(0, 3000, int(g.integers(0, 15)))]
            p = passages[int(g.integers(0, len(passages)))]
            w += p[int(g.integers(0, 4)) : len(p) - int(g.integers(0, 4))]
        rows.append((i * 7 % 61, " ".join(w)))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_words, r.n_removed, r.s) for r in substring.remove_repeats(frame, block=block).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("s")).collect()}
    assert got == brute_substrings(rows)
    spans = substring.factors(frame).collect()
    text = {i: words(t) for i, t in rows}
    assert spans and all(text[f.doc_id][f.start : f.start + f["count"] + 19] == text[f.source_doc][f.source_start : f.source_start + f["count"] + 19] for f in spans)


def test_substring_parts_rows_of_one_id(spark):
    """A text that repeats nowhere stays, whatever another row of its doc_id loses."""
    w, x, y = (" ".join(f"{c}{i}" for i in range(60)) for c in "wxy")
    rows = [(1, w), (2, w), (2, x), (2, x), (3, f"{y} {w}"), (3, y)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit("x")).withColumn("key", F.lit(1))
    order = {r.text: r.h for r in frame.select("text", F.xxhash64("text").alias("h")).collect()}
    got = sorted((r.doc_id, r.n_words, r.n_removed, r.text) for r in substring.remove_repeats(frame).collect())
    y_goes_first = order[f"{y} {w}"] < order[y]
    want = [(1, 60, 0, w), (2, 60, 60, ""), (2, 60, 0, x), (2, 60, 0, x), (3, 120, 60, y) if y_goes_first else (3, 120, 120, ""), (3, 60, 60, "") if y_goes_first else (3, 60, 0, y)]
    assert got == sorted(want)


def test_factors_are_greedy():
    """A factor goes on where an earlier reference of its next window would end it."""
    ref = np.array([1, 2, 3, 4, 5, 90, 3, 4, 5, 6, 91, 1, 2, 3, 4, 5, 6, 7], np.uint64)
    doc = np.repeat([0, 1, 2], [6, 5, 7])
    start = np.concatenate([np.arange(6), np.arange(5), np.arange(7)])
    place, count, source, new = substring.parse(ref, ref.astype(np.uint32), doc, np.zeros(18, np.int64), start)
    assert sorted(zip(place.tolist(), count.tolist(), source.tolist(), strict=True)) == [(6, 3, 2), (11, 5, 0), (16, 1, 9)]
    assert np.flatnonzero(new).tolist() == [0, 1, 2, 3, 4, 5, 9, 10, 17]


def test_very_long_texts_are_sliced(monkeypatch, spark):
    monkeypatch.setattr(substring, "SLICE", 50)
    import pyarrow as pa

    text = pa.array([" ".join(f"w{i}" for i in range(333)), "a b", None, " ".join(f"v{i}" for i in range(20))])
    runs = list(substring.windows(text, 20))
    places = [(r, s + k) for owner, start, count, *_ in runs for r, s, c in zip(owner.tolist(), start.tolist(), count.tolist(), strict=True) for k in range(c)]
    assert places == [(0, k) for k in range(314)] + [(3, 0)]
    monkeypatch.undo()
    whole = list(substring.windows(text, 20))
    for k in (4, 5):
        assert np.array_equal(np.concatenate([r[k] for r in runs]), np.concatenate([r[k] for r in whole]))


def test_windows_of_one_hash_are_told_apart():
    """Different windows that one hash takes for equal stay, in a batch and across batches; equal ones of that hash are found."""
    import pyarrow as pa

    content, check = np.full(6, 7, np.uint64), np.array([1, 2, 1, 3, 2, 4], np.uint32)
    doc, start = np.arange(6), np.zeros(6, np.int64)
    place, count, source, new = substring.parse(content, check, doc, np.zeros(6, np.int64), start)
    assert sorted(zip(place.tolist(), count.tolist(), source.tolist(), strict=True)) == [(2, 1, 0), (4, 1, 1)]
    assert np.flatnonzero(new).tolist() == [0, 1, 3, 5]
    # the same as pieces of one key, in blocks that overflow and hand on by content
    one = np.ones(1, np.int64)
    batches = [substring._emit(5 * one.view(np.uint64), doc[i : i + 1], 0 * one, 0 * one, one, hashes=(content[i : i + 1], check[i : i + 1])) for i in range(6)]
    for block in (2, 4, 1 << 20):
        first = [b for b in substring._resolve(iter(batches), False, block) if len(b)]
        waiting = pa.Table.from_batches(first).filter(pa.compute.is_valid(pa.Table.from_batches(first)["hashes"])).sort_by([("key", "ascending"), ("doc_id", "ascending")])
        done = [r for b in first for r in b.to_pylist() if r["hashes"] is None]
        done += [r for b in substring._resolve(iter(waiting.to_batches()), True, block) for r in b.to_pylist()]
        assert {r["doc_id"] for r in done} == {2, 4}
    a, b = (np.array([k, *range(1, 20)], np.uint64) for k in (101, 102))
    assert substring.check_of(a, 20) != substring.check_of(b, 20) and substring.content_of(a, 20) >> np.uint64(32) != substring.check_of(a, 20)


def test_packing_round_trip(spark, docs, none):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    extra = spark.createDataFrame([(20 + i, t) for i, t in enumerate(["<|endoftext|> it's", "a b  c\r\n\r\n  d 's", "한국어 \U0001f600 1½2", "don't we'LL x'S  ", "\x1c \x85 . , ;;", "a <|endoftext|> b", "<|endoftext|><|endoftext|>", "<|endoftext| >"])], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(extra)
    got = packing.pack(packing.pieces(every, path), part_rows=4).toPandas()
    for doc, text in [(r.doc_id, r.text) for r in every.distinct().collect() if r.doc_id is not None]:
        ids = np.array([*plain.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        mine = got[got.doc_id == doc].drop_duplicates(["piece"]).sort_values("piece")
        assert mine.length.sum() == len(ids) and (mine.start.to_numpy() == np.cumsum(mine.length) - mine.length).all()
        assert (mine.length.iloc[1:] == 2048).all() and mine.length.max() <= 2048
        assert [zlib.crc32(ids[s : s + n].tobytes()) for s, n in zip(mine.start, mine.length, strict=True)] == mine.ids_crc32.tolist()
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    assert ordered.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack(packing.pieces(none, path)).count() == 0


def test_partitions_with_gaps_exchange(spark):
    g = np.random.default_rng(1)
    lengths = g.integers(300, 1700, 400)
    items = spark.createDataFrame([(int(n),) for n in lengths], "length long")
    bins = lambda rounds: packing.pack(items, part_rows=20, rounds=rounds).select("sequence_id").distinct().count()
    assert packing.lower_bound(lengths, 2048) <= bins(None) < bins(1) < bins(0)


def test_sequence_numbers_of_any_round():
    """Rounds 0 to 63, partitions up to 2 ** 32 and places up to 2 ** 25 have numbers of their own; what is beyond says so."""
    place = np.array([0, 1, (1 << 25) - 1])
    every = [packing.sequence_ids(step, part, place) for step in (0, 1, 7, 8, 12, 63) for part in (0, 1, (1 << 28) - 1, 1 << 28, (1 << 32) - 1)]
    every = np.concatenate(every)
    assert every.dtype == np.int64 and every.min() == 0 and len(np.unique(every)) == len(every)
    for step, part, at in ((64, 0, 0), (0, 1 << 32, 0), (0, 0, 1 << 25)):
        with pytest.raises(ValueError, match="no sequence number"):
            packing.sequence_ids(step, part, np.array([at]))


def test_twelve_rounds_of_exchange(spark):
    """Partitions that meet two by two for as long as it takes: numbers of sequences stay apart, all items stay in."""
    g = np.random.default_rng(8)
    rows = [(i, int(n)) for i, n in enumerate(g.integers(300, 1500, 5000))]
    frame = spark.createDataFrame(rows, "doc_id long, length long")
    got = packing.pack(frame, part_rows=2, merge=2).toPandas()
    assert len(got) == 5000 and got["doc_id"].is_unique
    assert len({x >> (packing.PART_BITS + packing.PLACE_BITS) for x in got["sequence_id"]}) > 9
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert (own["offset"].to_numpy() == np.cumsum(own["length"]) - own["length"]).all() and own["length"].sum() <= 2048


def test_gaps_meet_and_are_named(spark):
    """Items of 0.6 and 0.4 of a sequence in small partitions: all partitions' leftovers meet, and what is not proven is said."""
    items = spark.createDataFrame([(1200 if i % 2 else 848, i, 1, "x") for i in range(300)], "length long, _row long, offset long, certified string")
    packed = packing.pack(items, part_rows=16)
    assert packed.columns == ["length", "_row", "sequence_id", "offset", "certified"]
    got = packed.toPandas()
    assert sorted(got["_row"]) == list(range(300)) and got.sequence_id.nunique() == 150 and got.certified.all()
    odd = packing.pack(spark.createDataFrame([(n,) for n in (900, 700, 700, 700, 500, 400)], "length long"), capacity=1300).toPandas()
    assert odd.certified.all() == (odd.sequence_id.nunique() == packing.lower_bound(odd.length.to_numpy(), 1300))


def test_bounds_and_fits():
    g = np.random.default_rng(2)
    for _ in range(60):
        capacity = int(g.integers(5, 40))
        lengths = g.integers(1, capacity + 1, int(g.integers(1, 40)))
        which, place, bins = packing.best_fit(lengths, capacity)
        assert packing.lower_bound(lengths, capacity) <= bins
        for b in range(bins):
            at = np.flatnonzero(which == b)
            at = at[np.argsort(place[at])]
            assert lengths[at].sum() <= capacity and (place[at] == np.cumsum(lengths[at]) - lengths[at]).all()


VECTORS = [(0, [0.1, 0.2, -0.3]), (20, None), (40, [float("nan"), 1.0, 1.0]), (60, [1.0, None, 0.0]), (80, []), (100, [0.0, 0.0, 0.0]), (None, [1.0, 1.0, 1.0]), (120, [0.5, 0.5]), (1, [0.1, 0.2, -0.3]), (1, [0.1, 0.2, -0.3]), (3, [float("inf"), 0.0, 0.0])]


@pytest.fixture(scope="module")
def vectors(spark):
    g = np.random.default_rng(4)
    hot = [(1000 + i, [0.3, 0.3, 0.3]) for i in range(60)]
    more = [(2000 + i, [float(x) for x in g.normal(size=3)]) for i in range(300)]
    schema = "vec_id long, embedding array<float>, label int, g int, v string"
    return spark.createDataFrame([(i, v, 1, 1, "x") for i, v in [*VECTORS, *hot, *more]], schema).repartition(3).cache()


def test_exact_top(spark, vectors):
    rows = [(r.vec_id, np.array(r.embedding, np.float32).astype(float)) for r in vectors.collect() if r.vec_id is not None and r.embedding is not None and None not in r.embedding and np.isfinite(r.embedding).all()]
    want = []
    padded = [(i, np.floor(1024 * np.pad(v, (0, 3 - len(v)))).astype(int)) for i, v in rows]
    for i, q in padded:
        if i % 20 == 0:
            scores = sorted(((-int(q @ v), j) for j, v in padded if j != i))[:10]
            want += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores)]
    got = [tuple(r) for r in knn.exact_top(vectors, F.col("vec_id") % 20 == 0, group=4, chunk=100, block=5).collect()]
    assert sorted(got) == sorted(want)
    assert knn.exact_top(vectors.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_exact_top_of_repeated_query_rows(spark):
    """Rows of one id and equal vectors are one query; of one id and different vectors, each has its list of distinct candidates."""
    g = np.random.default_rng(6)
    rows = [(i, [float(x) for x in g.normal(size=4)]) for i in range(1, 60)]
    rows += [(100, rows[3][1]), (100, rows[3][1]), (100, rows[4][1]), (200, rows[5][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for got in (knn.exact_top(frame, F.col("vec_id") % 100 == 0), knn.search_index(knn.build_index(frame), frame, F.col("vec_id") % 100 == 0, k=10)):
        lists = got.collect()
        assert len(lists) == 30 and sorted(r["rank"] for r in lists if r.query_id == 200) == list(range(1, 11))
        of_100 = [r for r in lists if r.query_id == 100]
        assert sorted(r["rank"] for r in of_100) == sorted([*range(1, 11)] * 2)
        assert all(r.vec_id != 100 for r in of_100)
        top = {r.vec_id for r in of_100 if r["rank"] == 1}
        floor = {i: np.floor(1024 * np.array(v)) for i, v in rows}
        want = {max((j for j in floor if j != 100), key=lambda j: (float(floor[j] @ np.floor(1024 * np.array(v))), -j)) for v in (rows[3][1], rows[4][1])}
        assert top == want


def test_bounds_rule_out_far_vectors(spark):
    """Clustered vectors: most pairs of a query and a vector never meet, and the lists are those of brute force."""
    g = np.random.default_rng(12)
    centres = g.normal(size=(25, 16))
    centres /= np.linalg.norm(centres, axis=1)[:, None]
    x = (centres[g.integers(0, 25, 3000)] + g.normal(size=(3000, 16)) * 0.02).round(6)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    data = knn.floored(frame, F.col("vec_id") % 10 == 0, 1024.0).cache()
    cells, placed, located = knn.query_cells(data, knn.asked_rows(data), 16, 10, 8, 64)
    assert knn.sent_share(cells, placed, located, 16) < 0.25
    got = sorted(tuple(r) for r in knn.exact_top(frame, F.col("vec_id") % 10 == 0, group=8, block=64, chunk=500).collect())
    f = np.floor(1024 * x)
    want = []
    for i in range(0, 3000, 10):
        score = f @ f[i]
        order = [j for j in np.lexsort((np.arange(3000), -score)) if j != i][:10]
        want += [(i, r + 1, int(j), int(score[j])) for r, j in enumerate(order)]
    assert got == sorted(want)


def test_recall_at_production_size():
    """A whole shard of 64 dimensions, spread evenly over the sphere, by the production parameters; queries from all over it."""
    g = np.random.default_rng(13)
    x = g.normal(size=(32_768, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    order, layers = knn.build_graph(x, np.arange(len(x)))
    assert sorted(order.tolist()) == list(range(len(x))) and len(layers[0]) == len(x)
    y = x[order].astype(np.float32)
    at = g.choice(len(x), 200, replace=False)
    score = y[at] @ y.T
    score[np.arange(200), at] = -2
    exact = np.argsort(-score, axis=1)[:, :20]
    found, _ = knn.search_graph(y, layers, y[at], 300)
    hits = [len(set(a) & set([v for v in b if v != i][:20])) for i, a, b in zip(at, exact, found, strict=True)]
    assert np.mean(hits) / 20 >= 0.95


def test_a_shard_is_sent_once(spark, vectors):
    """With as many shards as cores, a graph is one row of the shuffle; queries go to each."""
    index = knn.build_index(vectors, shard_rows=40).cache()
    plan = knn.search_index(index, vectors, F.col("vec_id") % 20 == 0, splits=1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "CoGroup" not in plan
    assert index.count() > 4 and index.agg(F.sum(F.size("ids"))).first()[0] == vectors.filter("vec_id is not null").filter(knn._nonzero(F.col("embedding"))).count()


@pytest.mark.parametrize("splits", [None, 1, 7])
def test_graph_search(spark, vectors, splits):
    index = knn.build_index(vectors, shard_rows=120)
    got = knn.search_index(index, vectors, F.col("vec_id") % 20 == 0, splits=splits).toPandas()
    rows = [(r.vec_id, np.pad(np.array(r.embedding, np.float32).astype(float), (0, 3 - len(r.embedding)))) for r in vectors.collect() if r.vec_id is not None and r.embedding and None not in r.embedding and np.isfinite(r.embedding).all() and np.any(r.embedding)]
    hit = total = 0
    for i, q in rows:
        if i % 20 == 0:
            exact = [j for _, j in sorted((-(q @ v), j) for j, v in rows if j != i)[:20]]
            mine = got[got.query_id == i]
            assert mine.score.is_monotonic_decreasing and mine["rank"].tolist() == list(range(1, len(mine) + 1))
            hit, total = hit + len(set(exact) & set(mine.vec_id)), total + len(set(exact))
    assert hit / total >= 0.9
    assert not set(got.query_id) & {20, 40, 60, 80, 100}
    assert knn.search_index(knn.build_index(vectors.limit(0)), vectors.limit(0), F.lit(True)).count() == 0
