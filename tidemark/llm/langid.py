"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import fraction, prepare

BUCKETS = 1 << 15
#: Marks of space and of ASCII that is no letter are one symbol.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32
PIECE = 1 << 18


def gram_buckets(column: pa.Array, orders: tuple[int, ...] = (1, 2, 3)) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For pieces of the lower-cased column: each n-gram's row and bucket. Rows are not split from their n-grams at a piece's edge."""
    data, rows = kernels.buffers(pc.utf8_lower(column))
    head = (data & 0xC0) != 0x80
    chars = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    bounds = np.concatenate([[0], np.cumsum(head)])[rows]
    small = chars < 128
    chars = np.where(small, _FOLD[np.where(small, chars, 0)], chars)
    for a in range(0, len(chars), PIECE):
        z = min(a + PIECE, len(chars))
        part = chars[a : min(z + max(orders) - 1, len(chars))].astype(np.uint64)
        row = np.searchsorted(bounds, np.arange(a, a + len(part)), "right") - 1
        for n in orders:
            m = min(z - a, len(part) - n + 1)
            if m <= 0:
                continue
            code, blank = part[:m] + np.uint64(n << 32), part[:m] == 32
            for k in range(1, n):
                code = code * np.uint64(0x9E3779B97F4A7C15) + part[k : k + m]
                blank &= part[k : k + m] == 32
            ok = ~blank & (row[:m] == row[n - 1 : n - 1 + m])
            yield row[:m][ok], (kernels.mix(code[ok]) >> np.uint64(49)).astype(np.int64)


def fit(docs: DataFrame, learn: F.Column, per_language: int = 4000, most_languages: int = 256, alpha: float = 0.1) -> tuple[list[str], np.ndarray]:
    """Languages and the (BUCKETS, languages) matrix of log probabilities.

    Learns from rows with text, lang and ``learn``: all of them, or about ``per_language`` of a language that has more,
    chosen by a hash of doc_id; of more than ``most_languages`` values of lang, from those with the most rows, ties by
    code point. These bounds are parameters; the counts of the chosen rows are summed on the executors.
    """
    prepare(docs)
    known = docs.filter(learn & F.col("lang").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(most_languages).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    shares = docs.sparkSession.createDataFrame([(k, min(1.0, per_language / n)) for k, n in sizes.items()], "lang string, share double")
    languages = sorted(sizes)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(languages), BUCKETS), np.int64)
        at = {k: i for i, k in enumerate(languages)}
        for batch in batches:
            lang = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64)
            for row, bucket in gram_buckets(batch.column("text")):
                total += np.bincount(lang[row] * BUCKETS + bucket, minlength=total.size).reshape(total.shape)
        i, b = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[i, b])], ["i", "b", "n"])

    chosen = known.join(F.broadcast(shares), "lang").filter(fraction(F.col("doc_id"), "langid") < F.col("share")).select("lang", "text").repartition(12)
    counts = chosen.mapInArrow(count, "i int, b int, n long").groupBy("i", "b").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((BUCKETS, len(languages)), alpha)
    np.add.at(table, (counts["b"].to_numpy(), counts["i"].to_numpy()), counts["n"].to_numpy())
    return languages, np.log(table / table.sum(0)).astype(np.float32)


def identify(docs: DataFrame, learn: F.Column | None = None, per_language: int = 4000, evidence: float = 40.0) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs(doc_id, text, lang, ...)``.

    The matrix of log probabilities (BUCKETS x languages, 4 bytes each) is broadcast; a batch's n-grams are scored sparsely
    in numpy. score is the winner's share after evidence beyond ``evidence`` n-grams is tempered, ties go to the first
    language by code point. Null text and text without a letter give ``und`` and 0.0, as does a table without a row to
    learn from. Repeated rows are scored each by itself; an empty table gives an empty one.
    """
    spark = prepare(docs)
    languages, table = fit(docs, F.lit(True) if learn is None else learn, per_language)
    shared = spark.sparkContext.broadcast(table)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_p = shared.value
        for batch in batches:
            text = batch.column("text").fill_null("")
            total, seen = np.zeros((len(text), len(languages))), np.zeros(len(text), np.int64)
            for row, bucket in gram_buckets(text) if languages else ():
                if len(row):
                    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
                    total[row[first]] += np.add.reduceat(log_p[bucket], first, axis=0)
                    seen += np.bincount(row, minlength=len(text))
            letters = pc.match_substring_regex(text, r"\p{L}").to_numpy(zero_copy_only=False) & (seen > 0)
            best = total.argmax(1) if languages else np.zeros(len(text), int)
            gap = (total - total.max(1, keepdims=True, initial=-np.inf)) * np.minimum(1, evidence / np.maximum(seen, 1))[:, None]
            share = 1 / np.exp(gap).sum(1) if languages else np.zeros(len(text))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([languages[b] if ok else "und" for b, ok in zip(best, letters, strict=True)], pa.string()), pa.array(np.where(letters, share, 0.0))],
                ["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")
