"""Substring dedup: documents are factored greedily, as in relative Lempel-Ziv parsing, against indexed reference blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels
from .common import checkpoint, prepare

#: Words of an anchor. A window's anchor is its least-hashed run of so many words, so that equal windows have equal anchors.
ANCHOR = 8
#: Words looked at at once, and windows of a reference block that are indexed at once.
SLICE, BLOCK = 1 << 20, 1 << 20
_PIECE = "key long, doc_id long, row long, start long, count long, source_doc long, source_row long, source_start long, hashes binary, checks binary"
_NAMES = [c.split()[0] for c in _PIECE.split(", ")]


def _runs(*changes: np.ndarray) -> np.ndarray:
    """First places of the runs in which no column changes."""
    if not len(changes[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(changes[0]), bool)
    new[1:] = False
    for c in changes:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def least_places(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of each ``width`` values in a row, the first of equal ones."""
    at, span = np.arange(len(values)), 1
    while span * 2 <= width:
        a, b = at[:-span], at[span:]
        at = np.where(values[b] < values[a], b, a)
        span *= 2
    n = len(values) - width + 1
    a, b = at[:n], at[width - span : width - span + n]
    return np.where(values[b] < values[a], b, a)


def content_of(words: np.ndarray, window: int) -> np.ndarray:
    """The hash under which equal windows meet."""
    return kernels.grams(words, window)


def check_of(words: np.ndarray, window: int) -> np.ndarray:
    """32 bits of a second hash, of words hashed anew: with the first, 96 bits must agree before a window counts as another's copy."""
    return (kernels.grams(kernels.mix(words ^ np.uint64(0xC2B2AE3D27D4EB4F)), window) >> np.uint64(32)).astype(np.uint32)


def windows(column: pa.Array, window: int, hashed: bool = True) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows of one anchor, some words at a time: (row, start in the row, count, anchor), and if ``hashed`` the windows' contents and checks one after the other."""
    data, rows = kernels.buffers(column)
    hashes, _, _, bounds = kernels.words(data, rows)
    for a in range(0, len(hashes), SLICE):
        part = hashes[a : a + SLICE + window - 1]
        n = len(part) - window + 1
        if n < 1:
            return
        short = kernels.grams(part, ANCHOR)
        spot = least_places(short, window - ANCHOR + 1)
        row = np.searchsorted(bounds, np.arange(a, a + len(part)), "right") - 1
        at = np.flatnonzero(row[:n] == row[window - 1 :])
        if not len(at):
            continue
        first = _runs(spot[at], row[at])
        start, owner = at[first], row[at[first]]
        runs = owner, start + a - bounds[owner], np.diff(np.append(first, len(at))), short[spot[start]]
        yield (*runs, content_of(part, window)[at], check_of(part, window)[at]) if hashed else runs


def _lists(values: np.ndarray, owner: np.ndarray, rows: int) -> pa.Array:
    """For each row the list of its values; owners ascend."""
    ends = np.searchsorted(owner, np.arange(rows + 1)).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.ascontiguousarray(values).view(np.int64)))


def _emit(key, doc, row, start, count, source=None, hashes=None) -> pa.RecordBatch:
    none = np.zeros(len(key), np.int64)
    binaries = [pa.nulls(len(key), pa.binary())] * 2
    if hashes is not None:
        binaries = []
        for each in map(np.ascontiguousarray, hashes):
            ends = np.concatenate([[0], np.cumsum(count * each.itemsize)]).astype(np.int32)
            binaries.append(pa.Array.from_buffers(pa.binary(), len(key), [None, pa.py_buffer(ends), pa.py_buffer(each)]))
    columns = key, doc, row, start, count, *(source or (none, none, none))
    return pa.RecordBatch.from_arrays([*(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in columns), *binaries], _NAMES)


def parse(content: np.ndarray, check: np.ndarray, doc: np.ndarray, row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors of windows against the block that they make up: (places, counts, places of the sources, which windows are new).

    Windows come in the order of their places (doc, row, start). The index of the block is its windows sorted by content; the
    first of each content is the reference. Windows of one content and different checks are different windows. From the first window of a document that has one before itself, a factor goes
    on as long as document and reference agree, window by window; the window behind its end, that is over its boundary,
    is looked up in the index again, and either begins the next factor or is new. All documents are parsed in step.
    """
    n = len(content)
    order = np.argsort(content, kind="stable")
    if ((content[order][1:] == content[order][:-1]) & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((np.arange(n), check, content))
    head = _runs(content[order], check[order])
    source = np.empty(n, np.int64)
    source[order] = np.repeat(order[head], np.diff(np.append(head, n)))
    late = source != np.arange(n)
    joined = np.zeros(n, bool)
    joined[1:] = (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (start[1:] == start[:-1] + 1)
    chain = np.cumsum(~joined)
    edge = late.copy()
    edge[1:] &= ~(late[:-1] & joined[1:])
    at = np.flatnonzero(edge)
    last = np.ones(n, bool)
    last[:-1] = ~(late[1:] & joined[1:])
    end = np.flatnonzero(late & last) + 1
    places, counts = [], []
    while len(at):
        ref, size, width = source[at], np.ones(len(at), np.int64), 8
        going = np.flatnonzero(at + 1 < end)
        while len(going):
            p, s = at[going] + size[going], ref[going] + size[going]
            step = np.arange(width)
            mine, other = p[:, None] + step, np.minimum(s[:, None] + step, n - 1)
            same = (mine < end[going][:, None]) & (content[np.minimum(mine, n - 1)] == content[other]) & (check[np.minimum(mine, n - 1)] == check[other]) & (chain[other] == chain[ref[going]][:, None])
            run = np.where(same.all(1), width, same.argmin(1))
            size[going] += run
            going, width = going[run == width], min(width * 2, 1 << 12)
        places.append(at)
        counts.append(size)
        more = at + size < end
        at, end = (at + size)[more], end[more]
    place, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, counts))
    return place, count, source[place], ~late


def _resolve(batches: Iterator[pa.RecordBatch], whole: bool, block: int) -> Iterator[pa.RecordBatch]:
    """Factor the pieces of each key, which come in the order of key and place, against the block of that key.

    Keys are indexed some at a time. Of a key with more windows than a block holds, only those that are new stay in the index; where even these
    are too many, its windows are handed on one by one under their content (not if ``whole``, where a key is a content).
    """
    held: list[tuple[np.ndarray, ...]] = []
    size, spilling = 0, None

    def answer(rows: tuple[np.ndarray, ...]) -> tuple[pa.RecordBatch, np.ndarray]:
        _, content, _, doc, row, start = rows
        fresh = np.ones(len(content), bool)
        fresh[1:] = (content[1:] != content[:-1]) | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (start[1:] != start[:-1])
        rows = tuple(x[fresh] for x in rows)
        key, content, check, doc, row, start = rows
        place, count, source, new = parse(content, check, doc, row, start)
        spread = kernels.mix(doc[place].view(np.uint64) * np.uint64(31) + start[place].view(np.uint64))
        return _emit(spread, doc[place], row[place], start[place], count, (doc[source], row[source], start[source])), tuple(x[new] for x in rows)

    def apart(rows: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        _, content, check, doc, row, start = rows
        return _emit(content, doc, row, start, np.ones(len(content), np.int64), hashes=(content, check))

    for batch in batches:
        open_ = batch.column("hashes").is_valid()
        yield batch.filter(pc.invert(open_))
        if not len(rest := batch.filter(open_)):
            continue
        key, doc, row, start, count = (rest.column(c).to_numpy() for c in ("key", "doc_id", "row", "start", "count"))
        content = np.frombuffer(b"".join(rest.column("hashes").to_pylist()), np.uint64)
        check = np.frombuffer(b"".join(rest.column("checks").to_pylist()), np.uint32)
        rows = tuple(np.repeat(x, count) for x in (key, doc, row))
        rows = rows[0], content, check, rows[1], rows[2], kernels.ranges(start, count)
        if spilling is not None:
            on = int(np.searchsorted(rows[0] != spilling, True)) if rows[0][-1] != spilling else len(content)
            yield apart(tuple(x[:on] for x in rows))
            rows = tuple(x[on:] for x in rows)
            if not len(rows[0]):
                continue
            spilling = None
        held.append(rows)
        size += len(rows[0])
        if size < block:
            continue
        rows = tuple(np.concatenate(x) for x in zip(*held, strict=True))
        cut = int(np.flatnonzero(rows[0] == rows[0][-1])[0])
        if cut:
            done, _ = answer(tuple(x[:cut] for x in rows))
            yield done
            rows = tuple(x[cut:] for x in rows)
        if len(rows[0]) >= block // 2:
            done, rows = answer(rows)
            yield done
            if len(rows[0]) >= block // 2 and not whole:
                yield apart(rows)
                spilling, rows = rows[0][-1], tuple(x[:0] for x in rows)
        held, size = [rows], len(rows[0])
    if size:
        yield answer(tuple(np.concatenate(x) for x in zip(*held, strict=True)))[0]


def factors(docs: DataFrame, window: int = 20, block: int = BLOCK) -> DataFrame:
    """doc_id, row, start, count, source_doc, source_row, source_start of the factors of ``docs(doc_id, text)``, doc_id not null.

    A factor is a run of ``count`` windows of ``window`` words from word ``start`` on, which stands as it is at an
    earlier place, too: a smaller doc_id, or a smaller ``row`` (hash of the text, which parts rows of one doc_id), or an
    earlier start. Documents are parsed against all reference blocks that can hold one of their windows. A batch of
    documents is the first block. Windows that are new to it go to the blocks of the index, which is cut by anchors, so that
    equal windows meet: linear in the text, where documents by blocks would be its square. A factor ends with its
    block at the latest; windows over its boundary are looked up like all others, so that no window with an earlier place is missed.

    Anchors that occur once are found first and their windows never sent. An anchor that occurs twice in a batch is known from
    there and costs the batch one row of the count; a passage's windows come to one row a batch, too, and an anchor with very many
    different windows is split by these. So a passage or an anchor in a third of all rows fills no task.
    """
    prepare(docs)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [(owner, anchor) for owner, _, _, anchor in windows(batch.column("text"), window, hashed=False)]
            if not parts:
                continue
            owner, anchor = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(anchor, kind="stable")
            owner, anchor = owner[order], anchor[order]
            head = _runs(anchor)
            times = np.diff(np.append(head, len(anchor)))
            often = np.repeat(times > 1, times)
            first = _runs(owner, anchor)
            owner, anchor, often = owner[first], anchor[first], often[first]
            order = np.argsort(owner, kind="stable")
            owner, anchor, often = owner[order], anchor[order], often[order]
            n = batch.num_rows
            heads = np.unique(anchor[often])
            columns = _lists(anchor[often], owner[often], n), _lists(anchor[~often], owner[~often], n), _lists(heads, np.zeros(len(heads), np.int64), n)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("row"), *columns], ["doc_id", "row", "known", "single", "heads"])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            ids, hashed = batch.column("doc_id").to_numpy(), batch.column("row").to_numpy()
            rank = np.lexsort((hashed, ids))
            first = _runs(ids[rank], hashed[rank])  # rows that repeat an id and its text are one document
            batch = batch.take(pa.array(rank[first]))
            ids, hashed, lists = ids[rank[first]], hashed[rank[first]], batch.column("anchors")
            flat = lists.flatten().to_numpy().view(np.uint64)
            wanted = np.sort(kernels.mix(flat + np.repeat(np.arange(len(lists), dtype=np.uint64), np.diff(lists.offsets.to_numpy())) * salt))
            kept = []
            for owner, start, count, anchor, content, check in windows(batch.column("text"), window):
                ask = kernels.mix(anchor + owner.astype(np.uint64) * salt)
                near = np.minimum(np.searchsorted(wanted, ask), len(wanted) - 1)
                often = wanted[near] == ask if len(wanted) else np.zeros(len(ask), bool)
                each = np.repeat(often, count)
                owner, start, count, anchor = owner[often], start[often], count[often], anchor[often]
                kept.append((np.repeat(owner, count), kernels.ranges(start, count), np.repeat(anchor, count), content[each], check[each]))
            if not kept:
                continue
            owner, start, key, content, check = (np.concatenate(x) for x in zip(*kept, strict=True))
            doc, row = ids[owner], hashed[owner]
            place, count, source, new = parse(content, check, doc, row, start)
            spread = kernels.mix(doc[place].view(np.uint64) * np.uint64(31) + start[place].view(np.uint64))
            yield _emit(spread, doc[place], row[place], start[place], count, (doc[source], row[source], start[source]))
            left = np.flatnonzero(new)
            head = _runs(key[left], owner[left], start[left] - np.arange(len(left)))
            size, at = np.diff(np.append(head, len(left))), left[head]
            yield _emit(key[at], doc[at], row[at], start[at], size, hashes=(content[left], check[left]))

    known = docs.select("doc_id", F.xxhash64("text").alias("row"), "text")
    found = checkpoint(known.mapInArrow(anchors, "doc_id long, row long, known array<long>, single array<long>, heads array<long>"))
    single = found.select(F.explode("single").alias("anchor"), "doc_id", "row", F.lit(1).alias("n"))
    heads = found.select(F.explode("heads").alias("anchor"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("row"), F.lit(2).alias("n"))
    several = single.unionByName(heads).withColumn("n", F.sum("n").over(W.partitionBy("anchor"))).filter((F.col("n") > 1) & F.col("doc_id").isNotNull())
    here = found.select("doc_id", "row", F.explode("known").alias("anchor"))
    wanted = several.select("doc_id", "row", "anchor").unionByName(here).groupBy("doc_id", "row").agg(F.collect_set("anchor").alias("anchors"))
    asked = known.join(wanted, ["doc_id", "row"]).select("doc_id", "row", "text", "anchors")
    order = "key", "doc_id", "row", "start"
    answered = asked.mapInArrow(look_up, _PIECE).repartition("key").sortWithinPartitions(*order).mapInArrow(lambda b: _resolve(b, False, block), _PIECE)
    answered = answered.repartition("key").sortWithinPartitions(*order).mapInArrow(lambda b: _resolve(b, True, block), _PIECE)
    return answered.drop("key", "hashes", "checks")


def remove_repeats(docs: DataFrame, window: int = 20, block: int = BLOCK) -> DataFrame:
    """doc_id, n_words, n_removed and the kept words, joined by one space, of every row of ``docs(doc_id, text, ...)``.

    Each word covered by a window of a factor goes; windows are judged on the input. Texts shorter than a window lose
    nothing; null and empty texts have no words. Rows of a null doc_id have no place in the order: they neither lose
    words nor are a source. Rows that repeat a doc_id and its text are one document; rows of one doc_id and different
    texts are documents of their own, in the order of Spark's xxhash64 of the text. An empty table gives an empty one.
    """
    prepare(docs)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text")
    known = texts.filter(F.col("doc_id").isNotNull())
    spans = factors(known, window, block).groupBy("doc_id", "row").agg(F.collect_set(F.struct("start", "count")).alias("spans"))
    spans = spans.select("doc_id", "row", F.col("spans.start").alias("starts"), F.col("spans.count").alias("counts"))
    none = F.lit(None).cast("array<long>")
    joined = known.join(spans, ["doc_id", "row"], "left").select("doc_id", "text", "starts", "counts")
    lone = texts.filter(F.col("doc_id").isNull()).select("doc_id", "text", none.alias("starts"), none.alias("counts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total, gone, kept = [], [], []
            for text, starts, counts in zip(*(batch.column(c) for c in ("text", "starts", "counts")), strict=True):
                words = (text.as_py() or "").encode().split()
                total.append(len(words))
                if starts.is_valid:
                    step = np.zeros(len(words) + 1, np.int64)
                    s = starts.values.to_numpy()
                    np.add.at(step, s, 1)
                    np.add.at(step, s + counts.values.to_numpy() + window - 1, -1)
                    words = [w for w, c in zip(words, np.cumsum(step[:-1]).tolist(), strict=True) if not c]
                gone.append(total[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    schema = "doc_id long, n_words long, n_removed long, text string"
    return joined.mapInArrow(cut, schema).unionByName(lone.mapInArrow(cut, schema))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT rid, doc_id, unnest(range(1, len(w) - 18)) AS s FROM d WHERE doc_id IS NOT NULL AND len(w) >= 20),
k AS (SELECT p.rid, p.doc_id, s, md5(array_to_string(w[s:s + 19], ' ')) AS k FROM p JOIN d USING (rid)),
f AS (SELECT rid, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) > 1 AS late FROM k),
g AS (SELECT DISTINCT rid, unnest(range(s, s + 20)) AS at FROM f WHERE late),
a AS (SELECT rid, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS at FROM d),
t AS (SELECT a.rid, string_agg(x, ' ' ORDER BY a.at) AS kept, count(*) AS n FROM a ANTI JOIN g ON a.rid = g.rid AND a.at = g.at GROUP BY a.rid)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN t USING (rid)
"""
