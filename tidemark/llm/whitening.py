"""Embedding whitening: leading principal components by matrix-free block subspace iteration, certified by their residuals."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, prepare
from .knn import usable

#: Partial sums that one task, or the driver, adds up at most.
FAN = 32
#: A residual of so many times the largest eigenvalue is that of double arithmetic.
CERTIFIED = 2e-13
#: A component with less than this share of the variance is that of rounding, not of the rows.
NOTHING = 1e-12


@dataclass
class Whitening:
    """What whitens: ``n`` fitted vectors with sums ``total``, and components (columns) with eigenvalues, falling."""

    n: int
    total: np.ndarray
    components: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        return self.total / max(self.n, 1)

    def of(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) @ self.components / np.sqrt(self.values)


def whole_steps(vector: Column, scale: int) -> Column:
    """floor(scale * c) of each component c, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(float(scale))).cast("long"))


def rows_of(column: pa.Array) -> np.ndarray:
    """Vectors of one length as rows."""
    size = np.diff(column.offsets.to_numpy())
    if len(size) and (size != size[0]).any():
        raise ValueError("vectors of different lengths cannot be whitened together")
    return column.flatten().to_numpy().reshape(len(column), int(size[0]) if len(size) else 0)


def summed(fit: DataFrame, part: Callable[[np.ndarray], np.ndarray], kind: str) -> np.ndarray | None:
    """The sum of ``part(x)`` over blocks x of the vectors of ``fit(x)``; None where there are none.

    Each task adds up its own rows. Partial sums are added in groups of FAN, and those again, until FAN are left for the driver.
    The order is that of the partitions, so that reruns agree.
    """

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                new = part(rows_of(batch.column("x")))
                total = new if total is None else total + new
        if total is not None:
            shape = ",".join(map(str, total.shape))
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([shape]), pa.array([total.tobytes()], pa.binary())], ["id", "shape", "total"])

    def read(shape: str, blob: bytes) -> np.ndarray:
        return np.frombuffer(blob, kind).reshape([int(n) for n in shape.split(",")])

    def together(shapes: list[str], blobs: list[bytes]) -> np.ndarray:
        if len(set(shapes)) > 1:
            raise ValueError("vectors of different lengths cannot be whitened together")
        total = read(shapes[0], blobs[0]).copy()
        for b in blobs[1:]:
            total += read(shapes[0], b)
        return total

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("id")
        total = together(group["shape"].to_pylist(), group["total"].to_pylist())
        return pa.table({"id": pa.array([group["id"][0].as_py()], pa.int64()), "shape": group["shape"].slice(0, 1), "total": pa.array([total.tobytes()], pa.binary())})

    schema = "id long, shape string, total binary"
    parts, many = fit.mapInArrow(own, schema), fit.rdd.getNumPartitions()
    while many > FAN:
        many = -(-many // FAN)
        parts = parts.groupBy(F.pmod("id", F.lit(many))).applyInArrow(add, schema)
    rows = sorted(parts.collect(), key=lambda r: r["id"])
    return together([r["shape"] for r in rows], [bytes(r["total"]) for r in rows]) if rows else None


def iterate(apply: Callable[[np.ndarray], np.ndarray], width: int, k: int, block: int, most_passes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(values, vectors, residuals, passes) of the k leading eigenpairs of the symmetric matrix behind ``apply``.

    Each pass applies the matrix to an orthonormal block. The basis is that block and the ones before it; Rayleigh-Ritz on
    all of them takes no more passes, as their images are kept. The next block is the residuals of the leading Ritz vectors, made
    orthogonal to the basis. A basis of over four blocks starts again from its leading two. It ends when the residual norm of each
    of the k pairs is at most CERTIFIED times the largest value; a basis of the whole space, or ``most_passes``, without that is an error.
    """
    g = np.random.default_rng(seed)
    block = min(block, width)
    q, _ = np.linalg.qr(g.normal(size=(width, block)))
    basis, image = np.zeros((width, 0)), np.zeros((width, 0))
    for step in range(1, most_passes + 1):
        basis, image = np.hstack([basis, q]), np.hstack([image, apply(q)])
        small = basis.T @ image
        value, turn = np.linalg.eigh((small + small.T) / 2)
        value, turn = value[::-1], turn[:, ::-1]
        vector, moved = basis @ turn, image @ turn
        residual = moved - vector * value
        norm = np.linalg.norm(residual, axis=0)
        if (norm[:k] <= CERTIFIED * max(value[0], 0)).all():
            return value[:k], vector[:, :k], norm[:k], step
        if basis.shape[1] >= width:
            break
        basis, image = vector, moved
        if basis.shape[1] > 4 * block:
            basis, image = basis[:, : 2 * block], image[:, : 2 * block]
        many = min(block, width - basis.shape[1])
        fresh = np.hstack([residual[:, :many] / np.maximum(norm[:many], np.finfo(float).tiny), g.normal(size=(width, many))])
        for _ in range(2):
            q, _ = np.linalg.qr(fresh - basis @ (basis.T @ fresh))
            fresh = q = q[:, :many]
    raise RuntimeError(f"residuals {norm[:k]} after {step} passes")


def fit(vectors: DataFrame, k: int = 4, scale: int = 256, block: int = 64, most_passes: int = 200) -> Whitening:
    """The whitening of the distinct vectors among ``vectors(x)`` (arrays of longs, all of one length), at most ``k`` components.

    A pass over the distinct vectors sends block columns out and brings their images back, each as wide as a vector: no task
    and not the driver holds the covariance or more rows than a batch. Components without variance are left out.
    """
    distinct = checkpoint(vectors.select("x").distinct())
    first = summed(distinct, lambda x: np.concatenate([[len(x)], x.sum(0)]).astype(np.int64), "int64")
    if first is None or len(first) < 2:
        return Whitening(0 if first is None else int(first[0]), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0), 0.0, np.zeros(0), 0, 0.0)
    n, total = int(first[0]), first[1:]
    mean = total / n

    def apply(q: np.ndarray) -> np.ndarray:
        def image(x: np.ndarray) -> np.ndarray:
            y = x - mean
            return y.T @ (y @ q)

        return summed(distinct, image, "float64") / n

    trace = float((summed(distinct, lambda x: ((x - mean) ** 2).sum(0), "float64") / n).sum())
    if not trace > 0:
        return Whitening(n, total, np.zeros((len(total), 0)), np.zeros(0), trace, np.zeros(0), 0, 0.0)
    values, components, residuals, passes = iterate(apply, len(total), min(k, len(total)), max(block, k), most_passes)
    some = values > NOTHING * trace
    made = Whitening(n, total, components[:, some], values[some], trace, residuals[some], passes, 0.0)

    def products(x: np.ndarray) -> np.ndarray:
        w = made.of(x)
        return np.vstack([w.T @ w, w.sum(0)])

    sums = summed(distinct, products, "float64") / n
    made.identity_error = float(np.abs(sums[:-1] - np.outer(sums[-1], sums[-1]) - np.eye(len(sums) - 1)).max(initial=0))
    return made


def deviations(x: np.ndarray, n: int, total: np.ndarray) -> list[int | None]:
    """Of each row the sum of (n * x - total) ** 2, exact; None where that passes a long."""
    most = float(n) * np.abs(x).max(initial=0) + np.abs(total).max(initial=0)
    if most * most * max(1, x.shape[1]) < 2.0**62:
        return ((n * x - total) ** 2).sum(1).tolist()
    exact = ((n * x.astype(object) - total.astype(object)) ** 2).sum(1)
    return [int(d) if d < 1 << 63 else None for d in exact]


def whiten(table: DataFrame, k: int = 4, scale: int = 256, block: int = 64, most_passes: int = 200) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of ``table(vec_id, embedding, ...)``, a row for each row and component.

    Rows whose vector is null or has null or non-finite entries are dropped. Entries c become floor(``scale`` * c). The fit list is each
    distinct vector once; components come by falling eigenvalue, from 1. whitened is the centred vector on the component over the
    root of its eigenvalue, explained the component's share of the variance, identity_error the largest entry by which the covariance
    of the fit list's whitened vectors differs from the identity. deviation is exact, or null where it passes a long.

    Repeated rows have the same result each; a null vec_id stays null. There are fewer components where vectors are shorter than ``k`` or vary
    in fewer dimensions, and no rows where they do not vary at all, have no entries, or there are none. Vectors of different lengths, and entries beyond a long, are errors in words. Other columns are left out.
    """
    prepare(table)
    rows = table.filter(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), whole_steps(F.col("embedding"), scale).alias("x"))
    model = fit(rows, k, scale, block, most_passes)
    share = model.values / model.trace if len(model.values) else model.values
    many = len(model.values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not many or not batch.num_rows:
                continue
            x = rows_of(batch.column("x"))
            at = np.repeat(np.arange(len(x)), many)
            component = np.tile(np.arange(many), len(x))
            columns = [
                batch.column("vec_id").take(pa.array(at)), pa.array((component + 1).astype(np.int32)), pa.array(np.full(len(at), model.n)),
                pa.array(deviations(x, model.n, model.total), pa.int64()).take(pa.array(at)), pa.array(model.of(x).ravel()), pa.array(share[component]), pa.array(np.full(len(at), model.identity_error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.mapInArrow(project, "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
