"""Quality classifier: random-indexing word vectors, pooled, into a two-layer network with calibrated probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import checkpoint, fraction, prepare

BUCKETS, WIDTH, NONZERO, NEAR = 1 << 14, 64, 4, 2
CAPITALS, REPEATS = BUCKETS - 2, BUCKETS - 1
PIECE = 1 << 16
#: Byte classes: 0 space, 1 letter (and all beyond ASCII), 2 digit, 3 other.
_KIND = np.full(256, 3, np.int8)
_KIND[kernels.IS_SPACE] = 0
_KIND[[i for i in range(256) if i >= 128 or chr(i).isalpha()]] = 1
_KIND[48:58] = 2


def tokens(data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and bucket of each token: runs of one byte class in lower case.

    Two marks count as tokens of their own: that of capitals behind a run in capitals, and that of repetition behind a
    run of letters equal to one of the two tokens before it.
    """
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kind = _KIND[data]
    edge = np.ones(len(data), bool)
    edge[1:] = kind[1:] != kind[:-1]
    edge[rows[:-1][rows[:-1] < len(data)]] = True
    begin = np.flatnonzero(edge)
    end = np.append(begin[1:], len(data))
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90))])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    up, down = kernels.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(kernels.byte_table(True)[data] * up[: len(data)], out=sums[1:])
    ink = kind[begin] > 0
    begin, end = begin[ink], end[ink]
    bucket = (kernels.mix((sums[end] - sums[begin]) * down[begin]) >> np.uint64(50)).astype(np.int64) % CAPITALS
    row = np.searchsorted(rows, begin, "right") - 1
    loud = (upper[end] - upper[begin] >= 2) & (lower[end] == lower[begin])
    again = np.zeros(len(begin), bool)
    for k in (1, 2):
        again[k:] |= (bucket[k:] == bucket[:-k]) & (row[k:] == row[:-k])
    again &= kind[begin] == 1
    times = 1 + loud + again
    bucket, row = np.repeat(bucket, times), np.repeat(row, times)
    last = np.cumsum(times) - 1
    bucket[last[loud]] = CAPITALS
    bucket[last[again] - loud[again]] = REPEATS
    return row, bucket


def index_vectors() -> np.ndarray:
    """Of each bucket the fixed sparse vector of a few +1 and -1."""
    g = np.random.default_rng(7)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    np.put_along_axis(out, np.argsort(g.random((BUCKETS, WIDTH)), 1)[:, :NONZERO], g.choice([-1.0, 1.0], (BUCKETS, NONZERO)).astype(np.float32), 1)
    return out


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Tokens of the column, about CHUNK bytes at a time: (first row, row, bucket). A longer text is cut behind a space, if it has one there; a repetition over the cut is not marked."""
    data, rows = kernels.buffers(column)
    a = 0
    while a < len(rows) - 1:
        z = int(np.searchsorted(rows, rows[a] + kernels.CHUNK, "right")) - 1
        if z > a:
            yield a, *tokens(data[rows[a] : rows[z]], rows[a : z + 1] - rows[a])
            a = z
            continue
        at = rows[a]
        while at < rows[a + 1]:
            to = min(at + kernels.CHUNK, rows[a + 1])
            if to < rows[a + 1] and len(gap := np.flatnonzero(kernels.IS_SPACE[data[at:to]])):
                to = at + gap[-1] + 1
            yield a, *tokens(data[at:to], np.array([0, to - at]))
            at = to
        a += 1


def pool(column: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """Each row's mean word vector and the log of its number of tokens."""
    out, seen = np.zeros((len(column), WIDTH)), np.zeros(len(column))
    for a, row, bucket in pieces(column):
        for s in range(0, len(row), PIECE):
            r = row[s : s + PIECE]
            first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
            out[a + r[first]] += np.add.reduceat(vectors[bucket[s : s + PIECE]], first, axis=0)
        seen[a : a + (row[-1] + 1 if len(row) else 0)] += np.bincount(row) if len(row) else 0
    return np.hstack([out / np.maximum(seen, 1)[:, None], np.log1p(seen)[:, None]])


@dataclass
class Network:
    """A standardised input, a tanh layer, a logistic output, and the temperature that calibrates it."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, batch: int = 128, rate: float = 5e-3, decay: float = 1e-4, seed: int = 11) -> Network:
    """Adam on the log loss; a sixth of the rows is kept from it and sets the temperature."""
    g = np.random.default_rng(seed)
    order = g.permutation(len(x))
    held, fitted = order[: len(x) // 6], order[len(x) // 6 :]
    mean, scale = (x.mean(0), x.std(0)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    scale = np.where(scale > 1e-9, scale, 1.0)
    if len(np.unique(y)) < 2 or not len(held):
        rate_1 = (y.sum() + 1) / (len(y) + 2)
        return Network(mean, scale, np.zeros((x.shape[1], hidden)), np.zeros(hidden), np.zeros(hidden), float(np.log(rate_1 / (1 - rate_1))))
    z = (x - mean) / scale
    p = [g.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), g.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(epochs):
        for i in np.array_split(g.permutation(fitted), max(1, len(fitted) // batch)):
            a = np.tanh(z[i] @ p[0] + p[1])
            err = (1 / (1 + np.exp(-np.clip(a @ p[2] + p[3], -30, 30))) - y[i]) / len(i)
            back = np.outer(err, p[2]) * (1 - a * a)
            grads = [z[i].T @ back + decay * p[0], back.sum(0), a.T @ err + decay * p[2], err.sum(keepdims=True)]
            step += 1
            for k, d in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                p[k] = p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]))
    raw = net.logits(x[held])
    grid = np.exp(np.linspace(-1.5, 2.5, 81))
    loss = [np.logaddexp(0, np.where(y[held] > 0, -1, 1) * raw / t).mean() for t in grid]
    net.temperature = float(grid[int(np.argmin(loss))])
    return net


def fit(docs: DataFrame, labels: DataFrame, learn: F.Column, most_rows: int = 6000) -> tuple[np.ndarray, Network]:
    """Word vectors and network from at most about ``most_rows`` labelled rows, chosen by a hash of doc_id.

    That bound is a documented parameter: the chosen ids, their pooled vectors and the (BUCKETS x WIDTH) sums of the
    word vectors have a fixed size. A doc_id labelled more than once counts by its lowest quality; labels other than 0
    and 1 do not count.
    """
    spark = prepare(docs)
    known = labels.filter(learn & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    share = min(1.0, most_rows / max(1, known.count()))
    chosen = F.broadcast(known.filter(fraction(F.col("doc_id"), "quality") < share))
    sample = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(chosen, "doc_id").repartition(12))
    fixed = index_vectors()

    def context(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((BUCKETS, WIDTH), np.float32)
        for batch in batches:
            for _, row, bucket in pieces(batch.column("text")):
                for s in range(0, len(row), PIECE):
                    r, b = row[s : s + PIECE], bucket[s : s + PIECE]
                    near = np.zeros((len(r), WIDTH), np.float32)
                    for k in range(1, NEAR + 1):
                        same = (r[k:] == r[:-k])[:, None]
                        near[k:] += fixed[b[:-k]] * same
                        near[:-k] += fixed[b[k:]] * same
                    order = np.argsort(b, kind="stable")
                    first = np.flatnonzero(np.concatenate([[True], np.diff(b[order]) > 0]))
                    total[b[order][first]] += np.add.reduceat(near[order], first, axis=0)
        seen = np.flatnonzero(np.abs(total).sum(1))
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), pa.array(list(total[seen].astype(float)), pa.list_(pa.float64()))], ["b", "v"])

    sums = sample.mapInArrow(context, "b int, v array<double>").groupBy("b").agg(F.array(*(F.sum(F.col("v")[k]) for k in range(WIDTH))).alias("v")).toArrow()
    vectors = fixed / np.sqrt(NONZERO)
    if len(sums):
        v = np.array(sums["v"].to_pylist())
        vectors[sums["b"].to_numpy()] += (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)
    shared = spark.sparkContext.broadcast(vectors)

    def pooled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("quality"), pa.array(list(pool(batch.column("text"), shared.value)), pa.list_(pa.float64()))], ["doc_id", "quality", "x"])

    rows = sample.mapInArrow(pooled, "doc_id long, quality int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(rows["x"].to_pylist()).reshape(len(rows), WIDTH + 1)
    return vectors, train(x, rows["quality"].to_numpy().astype(float))


def score(docs: DataFrame, labels: DataFrame, learn: F.Column | None = None, most_rows: int = 6000) -> DataFrame:
    """doc_id and score (0 to 1: likelier of quality 1) of the whole text of every row of ``docs(doc_id, text, ...)``.

    Only the text is an input. Null and empty texts are scored as a text without words; without a labelled row every score
    is 0.5. Repeated rows are scored each by itself; an empty table gives an empty one.
    """
    spark = prepare(docs)
    vectors, net = fit(docs, labels, F.lit(True) if learn is None else learn, most_rows)
    shared = spark.sparkContext.broadcast((vectors, net))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.probability(pool(batch.column("text"), known)))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rate, "doc_id long, score double")


def keep(docs: DataFrame, labels: DataFrame, least: float = 0.5, learn: F.Column | None = None, most_rows: int = 6000) -> DataFrame:
    """The rows of ``docs(doc_id, text, ...)``, with all columns as they are, whose whole text scores ``least`` or more.

    Null and empty texts are judged as texts without words; an empty table gives an empty one. Rows are judged where they are read: nothing is shuffled or joined, and a null doc_id is judged like any other.
    """
    spark = prepare(docs)
    vectors, net = fit(docs, labels, F.lit(True) if learn is None else learn, most_rows)
    shared = spark.sparkContext.broadcast((vectors, net))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, model = shared.value
        for batch in batches:
            yield batch.filter(pa.array(model.probability(pool(batch.column("text"), known)) >= least))

    return docs.mapInArrow(judge, docs.schema)
