"""The pipeline's stages on a small corpus with edge rows, each against a plain version of what it has to do."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline

from .test_edges import brute_links, near_copies, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rows = [(i, t, "en", f"s{i % 3}") for i, t in near_copies(11, families=4, most=12)]
    rows += [(1000 + i, f"Shared banner line\nown words of page {i} " + " ".join(f"p{i}x{k}" for k in range(30)), "en", f"site{i}") for i in range(12)]
    rows += [(2000 + i, " ".join(f"{w}$$$" for w in f"bad text number {i} goes on and on".split()), "en", "s0") for i in range(40)]
    rows += [(3000, None, None, None), (3001, "", "en", "s1"), (None, "without an id", "en", "s2"), (5, rows[5][1], "en", rows[5][3]), (3002, "w " * 9000, "en", "s1")]
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(str(root / "documents.parquet"))
    labels = [(d, int(not 2000 <= d < 3000), 0) for d, *_ in corpus() if d is not None and d < 3000 and d % 4]
    spark.createDataFrame([*labels, (None, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(root / "labels.parquet"))
    return str(root)


@pytest.fixture(scope="module")
def stages(spark, folder, tmp_path_factory):
    """Each stage's input and output rows."""
    out, docs = {}, spark.read.parquet(f"{folder}/documents.parquet")
    root = tmp_path_factory.mktemp("stages")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, folder).write.parquet(str(root / str(k)))
        made = spark.read.parquet(str(root / str(k)))
        out[name] = (docs.collect(), made.collect(), made.columns)
        docs = made
    return out


def test_stages_keep_the_columns(stages):
    assert len(stages) == 5
    for _, _, columns in list(stages.values())[:-1]:
        assert columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_bad_rows_go_and_clean_rows_stay(stages):
    before, after, _ = stages["quality classifier"]
    left = {r.doc_id for r in after}
    bad = {r.doc_id for r in before if r.doc_id is not None and 2000 <= r.doc_id < 3000}
    clean = {r.doc_id for r in before if r.doc_id is not None and r.doc_id < 2000 and len(words(r.text)) >= 10}
    assert not left & bad and clean <= left


def test_boilerplate_goes(stages):
    before, after, _ = stages["line dedup"]
    sites = {}
    for r in before:
        for line in {x.strip(" ") for x in (r.text or "").split("\n")} - {""}:
            sites.setdefault(line, set()).update({r.source} - {None})
    gone = {k for k, v in sites.items() if len(v) >= 10}
    assert gone == {"Shared banner line"}

    def cut(text):
        if text is None:
            return None
        lines = text.split("\n")
        own = any(x.strip(" ") and x.strip(" ") not in gone for x in lines)
        return "\n".join(x for x in lines if x.strip(" ") not in gone) if own else text

    want = Counter((r.doc_id, t := cut(r.text), None if t is None else len(t)) for r in before)
    assert Counter((r.doc_id, r.text, r.n_chars) for r in after) == want


def test_stubs_lose_their_boilerplate(spark):
    banner = "A banner much longer than what the page says itself"
    rows = [(i, f"{banner}\nown {i}", "en", f"site{i}", None) for i in range(12)] + [(12, f" {banner} \n\n{banner}", "en", "site0", None)]
    after = corpus_pipeline.drop_boilerplate(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    assert {r.doc_id: r.text for r in after} == {i: f"own {i}" for i in range(12)} | {12: rows[12][1]}


def test_one_of_each_group_of_five_word_links_stays(stages):
    before, after, _ = stages["n-gram Jaccard join"]
    component = brute_links([(r.doc_id, r.text) for r in before if r.doc_id is not None], 5, 80)
    assert sorted(r.doc_id for r in after if r.doc_id is not None) == sorted(i for i, (_, root) in component.items() if i == root)


def test_near_copies_are_of_five_words_at_four_fifths(spark):
    """Two words of 100 changed, apart: 0.83 by five words, 0.89 by three."""
    base = [f"a{k}" for k in range(100)]
    near, far = list(base), list(base)
    for k in (30, 70):
        near[k] = "x"
    for k in (20, 40, 60, 80):
        far[k] = "y"
    rows = [(i, " ".join(w), "en", "s0", None) for i, w in enumerate((base, near, far))]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 2]


def test_texts_of_one_id_are_one_node(spark):
    """Both texts of an id stay with it; what is near to either goes, and equal rows become one."""
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (1, b), (2, b + " more"), (3, "something else that stands alone here")]
    kept = corpus_pipeline.drop_near_copies(spark, spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA), "")
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, a), (1, b), rows[4]]


def test_mix_repeats_and_drops(stages):
    before, after, _ = stages["mixing sources to target weights"]
    have, got = Counter(before), Counter(after)
    assert set(got) <= set(have) and all(1 <= n <= 2 * have[r] for r, n in got.items())
    total = sum(len(words(r.text)) for r in before)
    assert abs(sum(len(words(r.text)) for r in after) - 1.5 * total) <= sum(max(len(words(r.text)) for r in before if r.source == s) for s in {r.source for r in before})


def test_sequences_hold_all_pieces(stages):
    before, after, _ = stages["best-fit packing"]
    assert sorted(Counter(r.doc_id for r in after if r.piece == 0).items(), key=str) == sorted(Counter(r.doc_id for r in before).items(), key=str)
    fill = Counter()
    for r in sorted(after, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill[r.sequence_id]
        fill[r.sequence_id] += r.length
    assert max(fill.values()) <= 2048


def test_run_and_empty_input(spark, folder, tmp_path):
    packed = corpus_pipeline.run(spark, folder)
    assert packed.agg(F.count("*")).first()[0] > 0
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert np.isfinite(packed.agg(F.sum("length")).first()[0])
