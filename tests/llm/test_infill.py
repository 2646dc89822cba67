"""Fill-in-middle against a plain version, exact round trips, and edges."""

import hashlib

import pytest
import regex
from pyspark.sql import functions as F

from tidemark.llm import infill, queries

TEXTS = [
    "", None, "a", "plain text of some words, one after the other", "has <P> in it", "ends with <M>", "<S", "S> and <", "é \U0001f468‍\U0001f469‍\U0001f467 नि \r\n  end",
    " \t\n\x0b\x0c\r", "<" * 50, "\U0001f600" * 30, "word " * 60_000,
]


def plain(doc_id, text):
    """The contract, word for word, by slices of code points."""
    text = text or ""
    n, digest = len(text), hashlib.sha256(f"1:{doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return n, "plain", None, None, text
    i, j = min(h[0] % (n + 1), h[1] % (n + 1)), max(h[0] % (n + 1), h[1] % (n + 1))
    p, m, s = text[:i], text[i:j], text[j:]
    return (n, "spm", i, j - i, f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 20 else (n, "psm", i, j - i, f"<P>{p}<S>{s}<M>{m}")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(100 * k + i, t, "x", 1, "y") for k in range(12) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[3], (None, "nobody's text", "x", 1, None)], "doc_id long, text string, form string, n int, _filled string").repartition(3).cache()


def test_every_row_is_that_of_the_plain_version(docs):
    got = infill.transform(docs).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(got) == len(TEXTS) * 12 + 2
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        want = plain("" if r.doc_id is None else r.doc_id, texts[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == want
        assert r.output_sha256 == hashlib.sha256(want[4].encode()).hexdigest()
        assert r.restored_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()


def test_outputs_are_undone(docs):
    back = infill.restore(infill.transform(docs)).select("doc_id", "text").exceptAll(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")))
    assert back.count() == 0
    lost = docs.sparkSession.createDataFrame([(None, "psm")], "output string, form string")
    assert infill.restore(lost).first().text is None


@pytest.mark.parametrize("unit", [r"(?s)\X", r"(?s)\S*\s*"])
def test_other_units_are_not_cut(docs, unit):
    pattern = regex.compile(unit)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in infill.transform(docs, unit=unit, rate=100, spm=50).collect():
        text = texts[r.doc_id]
        ends = {0, *(m.end() for m in pattern.finditer(text)), len(text)}
        assert infill.rebuilt(r.output, r.form) == text
        if r.form != "plain":
            assert r.prefix_chars in ends and r.prefix_chars + r.middle_chars in ends


def test_what_no_unit_matches_belongs_to_the_last_one():
    assert infill.unit_ends("ab--cd!!", regex.compile("[a-z]+")).tolist() == [2, 8]
    assert infill.unit_ends("", regex.compile("x")).tolist() == []


def test_empty_table_and_query_columns(spark, docs, tmp_path):
    assert infill.transform(docs.limit(0)).count() == infill.restore(infill.transform(docs.limit(0))).count() == 0
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = queries.queries()["op11_fill_in_middle"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert "Exchange" not in out._jdf.queryExecution().toString()
