"""Nearest neighbours by inner product: an exact Voronoi join, and approximate search in navigable graphs."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels
from .common import checkpoint, prepare

_HIT = "query_id long, key long, vec_id long, score {}"


def usable(vector: Column) -> Column:
    """Not null, without null or non-finite components."""
    finite = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(vector.isNotNull() & finite, F.lit(False))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """The vectors as rows of doubles; a shorter one has zeros behind."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    ends = column.offsets.to_numpy().astype(np.int64)
    size = np.diff(ends)
    out = np.zeros((len(column), width))
    out[np.repeat(np.arange(len(column)), size), kernels.ranges(np.zeros(len(size), np.int64), size)] = column.flatten().to_numpy()
    return out


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores of each row, ties to the smaller id, -inf left out by the caller. Ids ascend."""
    if score.shape[1] > 4 * k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
        out = np.zeros((len(score), k), np.int64)
        for i in range(len(score)):
            at = np.flatnonzero(score[i] >= edge[i])
            out[i] = at[np.argsort(-score[i][at], kind="stable")[:k]]
        return out
    return np.argsort(-score, axis=1, kind="stable")[:, :k]


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of each query; ``key`` parts queries of one id and different vectors."""
    w = W.partitionBy("query_id", "key").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def asked_rows(data: DataFrame) -> DataFrame:
    """vec_id, key, v of the query rows of ``data(vec_id, v, q)``: rows of one id and equal vectors are one query."""
    return data.filter("q").select("vec_id", F.xxhash64("v").alias("key"), "v").dropDuplicates(["vec_id", "key"])


@dataclass
class Cells:
    """Voronoi cells of the queries: what must be known of each to say which vectors it can need."""

    centres: np.ndarray
    radius: np.ndarray
    threshold: np.ndarray
    reach: np.ndarray
    longest: np.ndarray
    blocks: list[np.ndarray]

    def open_cells(self) -> np.ndarray:
        """For each data cell the query cells of which some query can score a vector of it at the threshold or more."""
        size = np.linalg.norm(self.centres, axis=1)
        most = self.centres @ self.centres.T + self.reach[:, None] * size + self.longest[:, None] * self.radius
        return (self.longest >= 0)[:, None] & (most + 1e-9 * (1 + np.abs(most)) >= self.threshold)

    def wanted(self, x: np.ndarray, cell: np.ndarray) -> np.ndarray:
        """Which cells (columns) can need which vectors (rows of x, in data cells ``cell``)."""
        out, opened = np.zeros((len(x), len(self.centres)), bool), self.open_cells()
        for c in np.unique(cell):
            at, to = np.flatnonzero(cell == c), np.flatnonzero(opened[c])
            middle, slack = x[at] @ self.centres[to].T, np.linalg.norm(x[at], axis=1)[:, None] * self.radius[to]
            out[np.ix_(at, to)] = middle + slack + 1e-9 * (1 + np.abs(middle) + slack) >= self.threshold[to]
        return out


def nearest(x: np.ndarray, spots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest spot and its distance."""
    cell = ((spots * spots).sum(1) - 2 * (x @ spots.T)).argmin(1)
    return cell, np.linalg.norm(x - spots[cell], axis=1)


def centroids(x: np.ndarray, many: int, rounds: int = 8) -> np.ndarray:
    """Means of ``many`` clusters of the rows at most, by Lloyd's rounds from rows that lie far apart."""
    spots, far = [0], np.linalg.norm(x - x[0], axis=1)
    while len(spots) < min(many, len(x)) and far.max() > 0:
        spots.append(int(far.argmax()))
        far = np.minimum(far, np.linalg.norm(x - x[spots[-1]], axis=1))
    out = x[spots]
    for _ in range(rounds):
        cell, _ = nearest(x, out)
        some = np.unique(cell)
        out = np.stack([x[cell == c].mean(0) for c in some])
    return out


def query_cells(data: DataFrame, asked: DataFrame, width: int, k: int, group: int, block: int, sample: int = 4096, seeds: int = 16_384) -> tuple[Cells, DataFrame, DataFrame]:
    """Cells, the queries with their cell, and the data with theirs.

    Centres are those of clusters of at most ``sample`` queries, of ``group`` queries each, 1,024 at most. A cell's summary is the
    queries' radius, and of the data nearest to its centre the reach and the longest vector. At most ``seeds``
    data rows, dealt evenly to the cells, are scored exactly by all queries: the least k-th best score of a cell's queries is its threshold, as
    no query of it can need a vector below. Cells are chained by nearness into blocks of at most ``block`` queries; a larger one is alone.
    """
    spark = data.sparkSession
    drawn = matrix(asked.orderBy("key", "vec_id").limit(sample).select("v").toArrow()["v"], width)
    spots = centroids(drawn, min(1024, max(1, math.ceil(asked.count() / group))))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column("v"), width)
            cell, far = nearest(x, spots)
            more = pa.array(cell.astype(np.int32)), pa.array(far), pa.array(np.linalg.norm(x, axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "cell", "far", "length"])

    extra = ", cell int, far double, length double"
    placed = checkpoint(asked.mapInArrow(locate, "vec_id long, key long, v array<double>" + extra))
    located = checkpoint(data.select("vec_id", "v").mapInArrow(locate, "vec_id long, v array<double>" + extra))
    many, some = len(spots), max(seeds // len(spots), k + 1)
    radius, number = np.zeros(many), np.zeros(many, np.int64)
    for r in placed.groupBy("cell").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():
        radius[r["cell"]], number[r["cell"]] = r["far"], r["n"]
    reach, longest = np.zeros(many), np.full(many, -1.0)
    for r in located.groupBy("cell").agg(F.max("far").alias("far"), F.max("length").alias("length")).collect():
        reach[r["cell"]], longest[r["cell"]] = r["far"], r["length"]
    w = W.partitionBy("cell").orderBy(F.xxhash64("vec_id", "v"), "vec_id")
    first = located.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= some).select("vec_id", "v").toArrow()
    shared = spark.sparkContext.broadcast((first["vec_id"].to_numpy(), matrix(first["v"], width)))

    def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, x = shared.value
        for b in batches:
            low = np.full(b.num_rows, -np.inf)
            for at in range(0, b.num_rows if len(ids) >= k else 0, 256):  # 256 queries' scores at a time
                part = b.slice(at, 256)
                score = matrix(part.column("v"), width) @ x.T
                score[part.column("vec_id").to_numpy()[:, None] == ids] = -np.inf
                low[at : at + 256] = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k]
            yield pa.RecordBatch.from_arrays([b.column("cell"), pa.array(low)], ["cell", "low"])

    threshold = np.full(many, np.inf)
    for r in placed.select("vec_id", "v", "cell").mapInArrow(tried, "cell int, low double").groupBy("cell").agg(F.min("low").alias("low")).collect():
        threshold[r["cell"]] = r["low"]
    left, chain = set(np.flatnonzero(number).tolist()), []
    while left:
        at = min(left) if not chain else min(left, key=lambda c: (float(((spots[c] - spots[chain[-1]]) ** 2).sum()), c))
        chain.append(at)
        left.remove(at)
    blocks: list[list[int]] = []
    for c in chain:
        if blocks and number[blocks[-1]].sum() + number[c] <= block:
            blocks[-1].append(c)
        else:
            blocks.append([c])
    grown = 1 + 1e-9
    return Cells(spots, radius * grown, threshold - 1e-9 * np.abs(np.where(np.isfinite(threshold), threshold, 0)), reach * grown, longest * grown, [np.array(b) for b in blocks]), placed, located


def sent_share(cells: Cells, placed: DataFrame, located: DataFrame, width: int) -> float:
    """The share of all pairs of a query and a vector that the bounds do not rule out."""
    number = np.zeros(len(cells.centres))
    for r in placed.groupBy("cell").count().collect():
        number[r["cell"]] = r["count"]

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = cells.wanted(matrix(b.column("v"), width), b.column("cell").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([float(want.sum(0) @ number)])], ["n"])

    met = located.select("v", "cell").mapInArrow(pairs, "n double").agg(F.sum("n")).first()[0] or 0.0
    return met / max(1.0, number.sum() * located.count())


def floored(vectors: DataFrame, queries: Column, scale: float) -> DataFrame:
    """vec_id, v (floor(scale * x)) and q of the rows that take part."""
    v = F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(F.lit(scale) * x).cast("double"))
    return vectors.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))


def exact_top(vectors: DataFrame, queries: Column, k: int = 10, scale: float = 1024.0, group: int = 32, chunk: int = 20_000, block: int = 32_768) -> DataFrame:
    """query_id, rank, vec_id, score of the k highest inner products of floor(scale * x) over all rows but the query's own.

    ``vectors(vec_id, embedding, ...)``; ties go to the smaller vec_id. Queries and data are parted by Voronoi cells of the
    queries' own clusters (``query_cells``). No query of a cell of centre c and radius r scores a vector v above c.v + r|v|, so that v is
    sent only to blocks with a cell whose threshold that reaches; whole data cells are ruled out by their summaries. There blocks
    of queries meet chunks of the data, whose sizes are fixed, whatever the size of a cell, and partial results are merged.
    Null ids and vectors that are not ``usable`` take no part; a shorter vector has zeros behind; repeated ids are
    separate candidates, none of which a query of that id gets. Query rows of one id and equal vectors are one query; of one id and
    different vectors, each has its own list. Scores must fit a long. No query or an empty table gives an empty one.
    """
    spark = prepare(vectors)
    data = checkpoint(floored(vectors, queries, scale))
    rows, width = data.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    asked = asked_rows(data)
    if asked.isEmpty():
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    cells, placed, located = query_cells(data, asked, width, k, group, block)
    home = np.zeros(len(cells.centres), np.int64)
    for i, b in enumerate(cells.blocks):
        home[b] = i
    number = np.zeros(len(cells.blocks), np.int64)
    for r in placed.groupBy("cell").count().collect():
        number[home[r["cell"]]] += r["count"]
    parts = np.maximum(1, -(-number // block))
    chunks = max(1, math.ceil(rows / chunk))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want = cells.wanted(matrix(b.column("v"), width), b.column("cell").to_numpy())
            part = (kernels.mix(b.column("vec_id").to_numpy().view(np.uint64)) % np.uint64(chunks)).astype(np.int32)
            for g, members in enumerate(cells.blocks):
                sent = pa.array(np.flatnonzero(want[:, members].any(1)))
                for q in range(parts[g] if len(sent) else 0):
                    same = lambda x: pa.array(np.full(len(sent), x, np.int32))
                    yield pa.RecordBatch.from_arrays([same(g), same(q), pa.array(part).take(sent), b.column("vec_id").take(sent), b.column("v").take(sent)], ["g", "b", "s", "vec_id", "v"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g = home[b.column("cell").to_numpy()]
            q = kernels.mix(b.column("key").to_numpy().view(np.uint64)) % parts[g].astype(np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array(g.astype(np.int32)), pa.array(q.astype(np.int32)), *(b.column(c) for c in ("vec_id", "key", "v"))], ["g", "b", "vec_id", "key", "v"])

    def solve(ask: pa.Table, have: pa.Table) -> pa.Table:
        out = []
        if len(ask) and len(have):
            have = have.sort_by("vec_id")
            x, ids = matrix(have["v"], width), have["vec_id"].to_numpy()
            for at in range(0, len(ask), 256):
                part = ask.slice(at, 256)
                q, own, key = matrix(part["v"], width), part["vec_id"].to_numpy(), part["key"].to_numpy()
                if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * max(width, 1) < 2**53:
                    score = q @ x.T
                else:
                    score = (q.astype(np.int64) @ x.astype(np.int64).T).astype(np.longdouble)
                score[own[:, None] == ids] = -np.inf
                top_at = best(score, ids, min(k, len(ids)))
                top = np.take_along_axis(score, top_at, 1)
                ok = np.isfinite(top)
                each = np.nonzero(ok)[0]
                out.append(pa.table({"query_id": own[each], "key": key[each], "vec_id": ids[top_at][ok], "score": top[ok].astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "key", "vec_id", "score")})

    ask = placed.select("vec_id", "key", "v", "cell").mapInArrow(place, "g int, b int, vec_id long, key long, v array<double>")
    ask = ask.select("g", "b", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("s"), "vec_id", "key", "v")
    have = located.select("vec_id", "v", "cell").mapInArrow(deal, "g int, b int, s int, vec_id long, v array<double>")
    hits = ask.groupBy("g", "b", "s").cogroup(have.groupBy("g", "b", "s")).applyInArrow(solve, _HIT.format("long"))
    return ranked(hits, k)


def diverse(x: np.ndarray, own: np.ndarray, found: np.ndarray, keep: int) -> np.ndarray:
    """Links of each row of ``own`` among its candidates ``found`` (places in x, -1 none): those nearer to it than to a better link; the rest filled by nearness."""
    value = np.where(found >= 0, np.einsum("id,icd->ic", own, x[np.maximum(found, 0)]), -np.inf)
    order = np.argsort(-value, axis=1, kind="stable")[:, : 3 * keep]
    found, value = np.take_along_axis(found, order, 1), np.take_along_axis(value, order, 1)
    near = x[np.maximum(found, 0)]
    between = near @ near.transpose(0, 2, 1)
    usable_ = np.isfinite(value)
    for c in range(1, found.shape[1]):
        usable_[:, c] &= ~(found[:, :c] == found[:, c : c + 1]).any(1)
    chosen, worst = np.zeros(found.shape, bool), np.full(found.shape, -np.inf, x.dtype)
    for c in range(found.shape[1]):
        take = usable_[:, c] & (value[:, c] > worst[:, c]) & (chosen.sum(1) < keep)
        chosen[:, c] = take
        np.maximum(worst, np.where(take[:, None], between[:, c, :], -np.inf), out=worst)
    rank = np.where(chosen, 0, np.where(usable_, 1, 2)) * 1000 + np.arange(found.shape[1])
    pick = np.argsort(rank, axis=1)[:, :keep]
    out = np.full((len(own), keep), -1, np.int32)
    out[:, : pick.shape[1]] = np.where(np.take_along_axis(usable_, pick, 1), np.take_along_axis(found, pick, 1), -1)
    return out


def _within(x: np.ndarray, a: int, z: int, near: int) -> np.ndarray:
    """Of each node a to z the ``near`` nearest among these."""
    own, near = x[a:z], min(near, z - a - 1)
    if near < 1:
        return np.full((z - a, 1), -1, np.int64)
    out = np.empty((z - a, near), np.int64)
    for i in range(0, z - a, 512):
        score = own[i : i + 512] @ own.T
        score[np.arange(len(score)), np.arange(i, i + len(score))] = -np.inf
        out[i : i + 512] = np.argpartition(-score, near - 1, axis=1)[:, :near] + a
    return out


def build_layer(x: np.ndarray, above: list[np.ndarray], n: int, m: int, near: int, batch: int) -> np.ndarray:
    """Flat links (2 m each) of the first n nodes, inserted in batches: each searches the layer as it is for its candidates.

    Half of a node's room is for its own links, half for the nearest of those that link to it. Nodes of a batch are
    candidates of each other, too, so that the work grows with n log n.
    """
    links = np.full((n, 2 * m), -1, np.int32)
    for a in range(0, n, batch):
        z = min(a + batch, n)
        found = _within(x, a, z, near)
        if a:
            searched = [search_graph(x, [links[:a], *above], x[i : i + 512], near)[0] for i in range(a, z, 512)]
            width = max(s.shape[1] for s in searched)
            found = np.hstack([found, np.vstack([np.pad(s, ((0, 0), (0, width - s.shape[1])), constant_values=-1) for s in searched])])
        for i in range(a, z, 1024):
            links[i : min(i + 1024, z), :m] = diverse(x, x[i : min(i + 1024, z)], found[i - a : i - a + 1024], m)
        source, target = np.repeat(np.arange(a, z), m), links[a:z, :m].ravel()
        source, target = source[target >= 0], target[target >= 0]
        met = np.unique(target)
        held = links[met, m:]
        source = np.concatenate([source, held[held >= 0]])
        target = np.concatenate([target, np.repeat(met, (held >= 0).sum(1))])
        weight = np.concatenate([np.einsum("id,id->i", x[source[i : i + 100_000]], x[target[i : i + 100_000]]) for i in range(0, len(source), 100_000)]) if len(source) else np.zeros(0)
        order = np.lexsort((source, -weight, target))
        source, target = source[order], target[order]
        rank = np.arange(len(target)) - np.searchsorted(target, target)
        room = rank < m
        links[met, m:] = -1
        links[target[room], m + rank[room]] = source[room]
    return links


def build_graph(x: np.ndarray, keys: np.ndarray, m: int = 24, near: int = 48, batch: int = 4096) -> tuple[np.ndarray, list[np.ndarray]]:
    """Order of the nodes, and the layers of a hierarchical navigable small world, the widest first, as flat links between places in that order.

    A node's top layer is drawn by a hash of its key. Nodes of higher layers come first, so that a layer's nodes are the
    first ones of the order; layers are built from the top, each found by way of those above.
    """
    u = (kernels.mix(keys.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)).astype(np.float64) / 2.0**53
    level = np.minimum((-np.log(np.maximum(u, 1e-300)) / np.log(m)).astype(int), 8)
    order = np.lexsort((keys, u))
    x, level = np.ascontiguousarray(x[order], np.float32), level[order]
    layers: list[np.ndarray] = []
    for k in range(level.max(initial=0), -1, -1):
        layers.insert(0, build_layer(x, layers, int((level >= k).sum()), m, near, batch))
    return order, layers


def search_graph(x: np.ndarray, layers: list[np.ndarray], q: np.ndarray, ef: int, wide: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For each query the places and scores of about ``ef`` nodes, best first (-1: none); a batch of queries walks in step."""
    beam = np.zeros((len(q), 1), np.int64)
    score = np.einsum("qd,qkd->qk", q, x[beam])
    for depth in range(len(layers) - 1, -1, -1):
        links = layers[depth]
        room = ef if depth == 0 else min(32, ef)
        seen = np.zeros((len(q), len(links)), bool)
        np.put_along_axis(seen, np.maximum(beam, 0), True, 1)
        done = beam < 0
        while True:
            open_ = np.where(done, -np.inf, score)
            step = np.argpartition(-open_, min(wide, open_.shape[1]) - 1, axis=1)[:, :wide]
            live = np.isfinite(np.take_along_axis(open_, step, 1))
            rows = np.flatnonzero(live.any(1))
            if not len(rows):
                break
            np.put_along_axis(done, step, True, 1)
            node = np.where(live, np.take_along_axis(beam, step, 1), -1)[rows]
            fresh = np.where(node[:, :, None] >= 0, links[np.maximum(node, 0)], -1).reshape(len(rows), -1).astype(np.int64)
            fresh = np.sort(fresh, axis=1)
            fresh[:, 1:][fresh[:, 1:] == fresh[:, :-1]] = -1
            fresh[(fresh >= 0) & seen[rows[:, None], np.maximum(fresh, 0)]] = -1
            r, c = np.nonzero(fresh >= 0)
            seen[rows[r], fresh[r, c]] = True
            value = np.full(fresh.shape, -np.inf, score.dtype)
            value[r, c] = np.einsum("id,id->i", q[rows[r]], x[fresh[r, c]])
            width = max(beam.shape[1], min(room, beam.shape[1] + fresh.shape[1]))
            beam, score, done = (np.pad(y, ((0, 0), (0, width - y.shape[1])), constant_values=v) for y, v in ((beam, -1), (score, -np.inf), (done, True)))
            all_b, all_s = np.hstack([beam[rows], fresh]), np.hstack([score[rows], value])
            all_d = np.hstack([done[rows], np.zeros(fresh.shape, bool)])
            top = np.argpartition(-all_s, width - 1, axis=1)[:, :width] if all_s.shape[1] > width else np.broadcast_to(np.arange(all_s.shape[1]), all_s.shape)
            beam[rows], score[rows], done[rows] = (np.take_along_axis(y, top, 1) for y in (all_b, all_s, all_d))
            done[rows] |= ~np.isfinite(score[rows])
    beam = np.where(np.isfinite(score), beam, -1)
    order = np.argsort(-score, axis=1, kind="stable")
    return np.take_along_axis(beam, order, 1), np.take_along_axis(score, order, 1)


_INDEX = "shard int, ids array<long>, id_ends array<int>, vectors binary, links array<array<int>>"


def _nonzero(vector: Column) -> Column:
    return usable(vector) & F.exists(vector, lambda x: x != 0)


def _indexed(vectors: DataFrame) -> DataFrame:
    return vectors.filter(F.col("vec_id").isNotNull() & _nonzero(F.col("embedding")))


def build_index(vectors: DataFrame, shard_rows: int = 32_768, m: int = 24) -> DataFrame:
    """One row a shard of ``vectors(vec_id, embedding, ...)``: ids by node, the vectors, and each layer's flat links.

    Every row with an id and a usable vector that is not zero is in one shard, by a hash of its id. Equal vectors of a
    shard are one node that holds all their ids. An empty table gives an empty index.
    """
    prepare(vectors)
    data = _indexed(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows, width = data.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = max(1, math.ceil(rows / shard_rows))

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("vec_id")
        x, node = np.unique(matrix(group["v"], width), axis=0, return_inverse=True)
        by = np.argsort(node.ravel(), kind="stable")
        ids, ends = group["vec_id"].to_numpy()[by], np.cumsum(np.bincount(node.ravel()))
        begins = np.concatenate([[0], ends[:-1]])
        order, layers = build_graph(x, ids[begins], m)
        size = (ends - begins)[order]
        one = [group["shard"][0].as_py()], [ids[kernels.ranges(begins[order], size)]], [np.cumsum(size).astype(np.int32)], [x[order].tobytes()], [[a.ravel() for a in layers]]
        kinds = pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.list_(pa.int32()))
        return pa.table([pa.array(a, t) for a, t in zip(one, kinds, strict=True)], ["shard", "ids", "id_ends", "vectors", "links"])

    return data.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).groupBy("shard").applyInArrow(build, _INDEX)


def search_index(index: DataFrame, vectors: DataFrame, queries: Column, k: int = 20, ef: int = 300, splits: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest that the shards' graphs find for each query, its own row left out.

    Every query goes to every shard, and a shard's graph to one task, which reads it once and walks the queries as they come, some at a time; where
    there are fewer shards than cores, to ``splits`` tasks, each with a part of the queries. The shards' results are merged by score, ties to the smaller id. A shard's
    graph is walked in single precision; score is the inner product of the original vectors in double precision. A query that is null, zero, or not finite has no result. Query rows
    of one id and equal vectors are one query; of one id and different vectors, each has its own list. No candidate that
    has a query's id is in its list. Empty tables give an empty one.
    """
    spark = prepare(vectors)
    kept = checkpoint(index)
    shards = max(1, kept.count())
    splits = splits or max(1, math.ceil(spark.sparkContext.defaultParallelism / shards))
    data = _indexed(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), F.coalesce(queries, F.lit(False)).alias("q"))
    asked = checkpoint(asked_rows(data))
    task = F.pmod(F.xxhash64(F.col("vec_id"), F.lit(1)), F.lit(splits)).cast("int").alias("b")
    ask = asked.select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("s"), task, F.lit(True).alias("asks"), "vec_id", "key", "v")
    have = kept.select(F.col("shard").alias("s"), F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("b"), F.lit(False).alias("asks"), "ids", "id_ends", "vectors", "links")
    both = have.unionByName(ask, allowMissingColumns=True).repartition("s", "b").sortWithinPartitions("s", "b", "asks")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A graph comes before its queries."""
        graph: tuple | None = None
        for batch in batches:
            asks = batch.column("asks").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(~asks)[1 if len(asks) and not asks[0] else 0 :]).tolist(), batch.num_rows]
            for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                if z > a and not asks[a]:
                    graph, a = opened(batch.slice(a, 1)), a + 1
                for at in range(a, z, 256):
                    if graph is not None:
                        yield answers(graph, batch.slice(at, min(256, z - at)))

    def opened(row: pa.RecordBatch) -> tuple:
        flat = lambda c: row.column(c).flatten()
        ids, ends = flat("ids").to_numpy(), flat("id_ends").to_numpy().astype(np.int64)
        x = np.frombuffer(row.column("vectors")[0].as_buffer()).reshape(len(ends), -1)
        links = [layer.values.to_numpy() for layer in row.column("links")[0]]
        return ids, ends, x, x.astype(np.float32), [a.reshape(-1, len(links[0]) // len(ends)) for a in links]

    def answers(graph: tuple, part: pa.RecordBatch) -> pa.RecordBatch:
        ids, ends, x, small, layers = graph
        begins = np.concatenate([[0], ends[:-1]])
        q, own, key = matrix(part.column("v"), x.shape[1]), part.column("vec_id").to_numpy(), part.column("key").to_numpy()
        node, _ = search_graph(small, layers, q.astype(np.float32), min(max(ef, k + 1), len(x)))
        node = node[:, : 2 * k + 2]
        near = np.einsum("qd,qkd->qk", q, x[np.maximum(node, 0)])
        copies = np.minimum(ends[node] - begins[node], k + 1) * (node >= 0)
        r = np.repeat(np.repeat(np.arange(len(q)), node.shape[1]), copies.ravel())
        vec = ids[kernels.ranges(begins[node].ravel(), copies.ravel())]
        value = np.repeat(near.ravel(), copies.ravel())
        other = vec != own[r]
        return pa.RecordBatch.from_arrays([*map(pa.array, (own[r][other], key[r][other], vec[other], value[other]))], ["query_id", "key", "vec_id", "score"])

    return ranked(both.mapInArrow(walk, _HIT.format("double")), k)
