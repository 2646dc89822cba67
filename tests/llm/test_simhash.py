"""SimHash links against brute force, the filter against the full check, and edges."""

import itertools

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import simhash

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_fingerprint(text, n=4):
    w = (text or "").encode().translate(LOWER).split()
    grams = [b" ".join(w[i : i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [b" ".join(w)] if w else []
    h = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(nodes, linked):
    root = {i: i for i in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def brute(rows, most=4):
    """doc_id -> component: rows of one doc_id are one node, all pairs are compared."""
    prints = {}
    for i, t in rows:
        prints.setdefault(i, set()).add(plain_fingerprint(t))
    near = [(a, b) for a, b in itertools.combinations(prints, 2) if any((x ^ y).bit_count() <= most for x in prints[a] for y in prints[b])]
    return roots(prints, near)


def test_fingerprint_is_spark_s_hash_of_shingles(spark):
    text = "The quick brown fox JUMPS over the lazy dog and the quick brown fox jumps"
    w = text.lower().split()
    h = [r.h for r in spark.createDataFrame([(" ".join(w[i : i + 4]),) for i in range(len(w) - 3)], "g string").select(F.xxhash64("g").alias("h")).collect()]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    assert simhash.fingerprint(text.encode(), 4) == want == plain_fingerprint(text)


@pytest.mark.parametrize("size", [7, 64, 1 << 20])
def test_slices_do_not_change_a_fingerprint(monkeypatch, size):
    monkeypatch.setattr(simhash, "SLICE", size)
    g = np.random.default_rng(2)
    for text in ["", "  ", "one", "one two", "one two three four", "É ß" * 40, "x" * 500 + " y", *(" ".join(f"w{x}" for x in g.integers(0, 30, k)) + " \n" for k in (3, 5, 40, 300))]:
        assert simhash.fingerprint(text.encode(), 4) == plain_fingerprint(text)


def test_chains_hold_every_pair():
    """Any two words that differ in at most 4 bits share a key, and their differences stay in its chain."""
    g = np.random.default_rng(5)
    for extra, many in ((1, 16), (2, 40), (3, 112)):
        ways = simhash.chains(extra)
        assert len(ways) == many
        x = g.integers(0, 1 << 64, 4000, dtype=np.uint64)
        flips = np.array([sum(1 << int(b) for b in g.choice(64, int(g.integers(0, 5)), replace=False)) for _ in x], np.uint64)
        met = np.zeros(len(x), bool)
        for name, (start, segments) in enumerate(ways):
            same = simhash.key_of(x, name, segments) == simhash.key_of(x ^ flips, name, segments)
            held = np.zeros(len(x), bool)
            held[simhash.in_chain(flips, np.full(len(x), start), 4)] = True
            met |= same & held
        assert met.all()
        far = np.array([sum(1 << int(b) for b in g.choice(64, 5, replace=False)) for _ in range(2000)], np.uint64)
        assert not any(len(simhash.in_chain(far, np.full(len(far), s), 4)) for s in range(8))


def crowd(seed, centres=3, each=120, flips=6):
    g = np.random.default_rng(seed)
    out = set()
    for c in g.integers(0, 1 << 64, centres, dtype=np.uint64).tolist():
        for _ in range(each):
            out.add(c ^ sum(1 << int(b) for b in g.choice(64, int(g.integers(0, flips + 1)), replace=False)))
    return sorted(out | {0, 1, 0b11111})


@pytest.mark.parametrize("bucket, room", [(4096, 64), (12, 64), (1, 64), (4096, 0)])
@pytest.mark.parametrize("most", [4, 3, 1])
def test_links_join_what_all_pairs_join(spark, monkeypatch, bucket, room, most):
    """Also where keys are crowded and filed again, up to the words half way, and where longer keys are used from the start."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    monkeypatch.setattr(simhash, "CROWD", room)
    monkeypatch.setattr(simhash, "HELD", 100)
    signed = [int(np.uint64(x).astype(np.int64)) for x in crowd(9, each=60 if bucket == 1 else 120)]
    got = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long").repartition(3), most).collect()]
    apart = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert all(a in signed and b in signed for a, b in got)
    assert roots(signed, got) == roots(signed, [(a, b) for a, b in itertools.combinations(signed, 2) if apart(a, b) <= most])


def copies(seed, families=8, most=12):
    g, rows = np.random.default_rng(seed), []
    for _ in range(families):
        base = [f"v{x}" for x in g.integers(0, 400, int(g.integers(60, 400)))]
        for _ in range(int(g.integers(2, most))):
            w = list(base)
            for _ in range(int(g.integers(0, 4))):
                w[int(g.integers(0, len(w)))] = f"e{g.integers(0, 50)}"
            rows.append(" ".join(w))
    return [(int(i), t) for i, t in zip(g.permutation(len(rows)), rows, strict=True)]


def test_documents_against_brute_force(spark):
    rows = [*copies(1), (900, ""), (901, None), (902, " \t"), (903, "one"), (904, "ONE"), (905, "é É"), (950, "x" * 3_000_000)]
    rows += [(i, t) for i, t in rows[:5]] + [(rows[0][0], rows[-2][1]), (3, "a second text of the third"), (700, "a second text of the third")]
    want = brute([(i, t) for i, t in rows])
    frame = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in [*rows, (None, "nobody's"), (None, None)]], "doc_id long, text string, fp int, root string, _s int").repartition(4)
    got = simhash.link(frame).collect()
    assert len(got) == len(rows) + 2
    assert len({v for v in want.values()}) < len(want) - 10
    for r in got:
        assert len(r.fingerprint) == 16
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
    texts = {}
    for i, t in [*rows, (None, "nobody's"), (None, None)]:
        texts.setdefault(i, set()).add(f"{plain_fingerprint(t):016x}")
    assert all(r.fingerprint in texts[r.doc_id] for r in got)
    assert simhash.link(frame.limit(0)).count() == 0
