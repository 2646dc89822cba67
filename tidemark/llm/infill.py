"""Fill-in-middle transformation: texts are cut at two seeded places and put together anew, so that a model learns to fill gaps."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare

#: What marks the three parts. A text that holds one of them stays as it is, so that every output can be undone.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: A unit of text between which cuts fall. Others: r"(?s)\X" for what a reader sees as one sign, r"(?s)\S*\s*" for words.
CODE_POINT = r"(?s)."
_END = type(regex.match("", "")).end
_FORMS = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string, restored_sha256 string"


def unit_ends(text: str, unit: regex.Pattern) -> array:
    """Past-the-end offsets of the units, 4 bytes each; what stands behind the last match belongs to the last unit, empty matches are none."""
    ends = array("I", map(_END, unit.finditer(text)))
    seen = np.frombuffer(ends, np.uint32)
    if len(ends) and not (seen[0] and (seen[1:] > seen[:-1]).all()):
        ends = array("I", np.unique(seen[seen > 0]).tobytes())
    del seen
    if ends and ends[-1] < len(text):
        ends[-1] = len(text)
    return ends


def seeds(name: str) -> tuple[int, int, int, int]:
    """Four numbers below 2 ** 32 that the name alone decides."""
    digest = hashlib.sha256(f"1:{name}".encode()).digest()
    return tuple(int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4))


def cut(text: str, name: str, unit: regex.Pattern, rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, prefix length, middle length, output) of a text."""
    ends = unit_ends(text, unit)
    n, (a, b, chance, kind) = len(ends), seeds(name)
    if not n or chance % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return n, "plain", None, None, text
    first, second = sorted((a % (n + 1), b % (n + 1)))
    i, j = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:i], text[i:j], text[j:]
    if kind % 100 < spm:
        return n, "spm", i, j - i, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", i, j - i, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuilt(output: str, form: str) -> str:
    """The text that ``cut`` made the output of."""
    if form == "plain":
        return output
    inner = SUFFIX if form == "psm" else PREFIX
    i = output.index(inner, len(PREFIX))
    j = output.index(MIDDLE, i + len(inner))
    first, second, middle = output[len(PREFIX) : i], output[i + len(inner) : j], output[j + len(MIDDLE) :]
    return first + middle + second if form == "psm" else second + middle + first


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def transform(docs: DataFrame, unit: str = CODE_POINT, rate: int = 90, spm: int = 20, texts: bool = True) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output, output_sha256, restored_sha256 of every row of ``docs(doc_id, text, ...)``.

    A text is cut into ``n`` units, matched left to right; two cuts between units, drawn by the SHA-256 of doc_id, part it into
    prefix, middle and suffix. ``rate`` of 100 texts are put together as psm or, ``spm`` of 100 of these, as spm; the others,
    empty texts and those that hold a mark stay as they are (plain, lengths null). Each output is undone in the same task, and
    the digest of what comes out is restored_sha256: it equals that of the text. ``texts=False`` leaves the outputs out, so that they do not leave Python.

    No shuffle: a row's result hangs on its doc_id and text alone. A batch of rows is bounded by bytes, a text costs 4 bytes a
    unit besides its own. Null texts are empty. A null doc_id draws by an empty name. Repeated rows have the same result each;
    an empty table gives an empty one; other columns are left out.
    """
    prepare(docs)

    @F.pandas_udf(_FORMS)
    def fill(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        pattern = regex.compile(unit)
        for ids, column in batches:
            rows = []
            for name, text in zip(ids, column, strict=True):
                n, form, i, j, output = cut(text, name, pattern, rate, spm)
                rows.append((n, form, i, j, output if texts else None, sha256(output), sha256(rebuilt(output, form))))
            frame = pd.DataFrame(rows, columns=[c.split()[0] for c in _FORMS.split(", ")])
            yield frame.astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    name = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    filled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), fill(name, F.coalesce("text", F.lit(""))).alias("_filled"))
    out = filled.select("doc_id", "_filled.*")
    return out if texts else out.drop("output")


def restore(filled: DataFrame) -> DataFrame:
    """``filled`` (form, output, ...) with the texts that its outputs were made of as ``text``; a null output stays null."""
    prepare(filled)

    @F.pandas_udf("string")
    def undo(outputs: pd.Series, forms: pd.Series) -> pd.Series:
        return pd.Series([None if o is None else rebuilt(o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return filled.withColumn("text", undo("output", "form"))


OP11_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256(concat('1:', doc_id)) AS h FROM documents),
g AS (SELECT doc_id, t, length(t) AS n, list_transform([1, 9, 17, 25], lambda i: ('0x' || substring(h, i, 8))::BIGINT) AS h FROM d),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS i, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS j,
             CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 90 THEN 'plain'
                  WHEN h[4] % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM g),
p AS (SELECT *, substring(t, 1, i) AS prefix, substring(t, i + 1, j - i) AS middle, substring(t, j + 1) AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN i END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN j - i END::BIGINT AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
                        ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""
