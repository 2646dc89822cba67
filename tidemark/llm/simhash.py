"""SimHash near-duplicates: fingerprints of word shingles, linked at a small Hamming distance by pigeonring filtering."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import checkpoint, prepare
from .components import SALTS, components

#: The seed of a shingle's hash. Fixed value.
SEED = 42
#: Bytes of text whose shingles are hashed at once.
SLICE = 1 << 20
BITS, SEGMENTS, WIDTH = 64, 8, 8
#: A fingerprint shares a key with so many others at random at most, else keys are longer from the start.
CROWD = 64
#: Fingerprints of a key that are compared pair by pair; those of a fuller key are filed again under longer keys.
BUCKET = 4096
#: Rows of keys that are compared at once, besides those of one key.
HELD = 1 << 17
_SPACE = re.compile(rb"[ \t\n\x0b\x0c\r]")


def shingle_hashes(text: bytes, n: int) -> Iterator[np.ndarray]:
    """Hashes of all n-word shingles, repeats included, some at a time; of fewer words, of the whole sequence."""
    hash_, held, at, short = xxhash.xxh64_intdigest, [], 0, True
    while at < len(text):
        found = _SPACE.search(text, at + SLICE)
        to = found.start() if found else len(text)
        words = held + text[at:to].split()
        at = to
        if len(words) >= n:
            short = False
            joined = b" ".join(words)
            size = np.fromiter(map(len, words), np.int64, len(words)) + 1
            end = np.cumsum(size)
            begin = end - size
            yield np.array([hash_(joined[a:z], SEED) for a, z in zip(begin[: len(words) - n + 1].tolist(), (end[n - 1 :] - 1).tolist(), strict=True)], np.uint64)
            words = words[len(words) - n + 1 :] if n > 1 else []
        held = words
    if short and held:
        yield np.array([hash_(b" ".join(held), SEED)], np.uint64)


def fingerprint(text: bytes, n: int) -> int:
    """A bit is 1 if it is set in over half of the hashes; 0 where there are none."""
    ones, many = np.zeros(BITS, np.int64), 0
    for h in shingle_hashes(text.lower(), n):  # bytes: A-Z alone
        many += len(h)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > many, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, n: int = 4) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a long) of every row of ``docs(doc_id, text)``; null text as empty."""
    prepare(docs)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, rows = kernels.buffers(batch.column("text"))
            found = np.array([fingerprint(data[a:z].tobytes(), n) for _, a, z in kernels.per_row(rows)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, "doc_id long, fp long")


def chains(extra: int) -> list[tuple[int, tuple[int, ...]]]:
    """(start, segments) of the keys under which a fingerprint is filed: the start of a chain and ``extra`` segments behind it, all equal.

    If two fingerprints differ in at most SEGMENTS / 2 bits, some chain of all segments of the ring has at most l / 2 differences
    in its first l segments, for every l. So its first one is equal, and of the next 2 j at least j are, for every j: the first
    ``extra`` equal ones behind the start are one of the choices here.
    """
    picks = [p for p in itertools.combinations(range(1, 2 * extra + 1), extra) if all(at <= 2 * (j + 1) for j, at in enumerate(p))]
    return [(s, tuple(sorted({s, *((s + o) % SEGMENTS for o in p)}))) for s in range(SEGMENTS) for p in picks]


def key_of(fp: np.ndarray, name: int, segments: tuple[int, ...]) -> np.ndarray:
    """The content of the segments, and which they are, as one long. Segments are at most 4, of 8 bits each."""
    key = np.full(len(fp), name, np.uint64)
    for s in segments:
        key = key << np.uint64(WIDTH) | fp >> np.uint64(WIDTH * s) & np.uint64(255)
    return key


def in_chain(differ: np.ndarray, start: np.ndarray, most: int) -> np.ndarray:
    """Places of the differences that stay within the budget of every chain from ``start`` on; the last of these is all bits."""
    at = np.arange(len(differ))
    turned = np.where(start > 0, differ >> (start * WIDTH).astype(np.uint64) | differ << ((BITS - start * WIDTH) % BITS).astype(np.uint64), differ)
    for size in range(2, SEGMENTS + 1):
        mask = np.uint64((1 << (WIDTH * size)) - 1)
        stays = np.bitwise_count(turned & mask) <= size * most // SEGMENTS
        at, turned = at[stays], turned[stays]
    return at


def close_pairs(key: np.ndarray, fp: np.ndarray, start: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """As few links as join what the close pairs of each key join; keys come in order. Each is held to those 1, 2, ... places behind it."""
    value, node = np.unique(fp, return_inverse=True)
    root = np.arange(len(value))
    left, step = np.arange(len(key)), 0
    while True:
        step += 1
        left = left[left + step < len(key)]
        left = left[key[left + step] == key[left]]
        if not len(left):
            break
        apart = left[root[node[left]] != root[node[left + step]]]
        near = apart[in_chain(fp[apart] ^ fp[apart + step], start[apart], most)]
        a, b = node[near], node[near + step]
        while len(a):
            a, b = root[a], root[b]
            np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
            while (deeper := root[root] != root).any():
                root[deeper] = root[root[deeper]]
            still = root[a] != root[b]
            a, b = a[still], b[still]
    joined = np.flatnonzero(root != np.arange(len(root)))
    return value[joined].view(np.int64), value[root[joined]].view(np.int64)


def middles(fp: np.ndarray, radius: int) -> np.ndarray:
    """For each fingerprint (rows) all words within ``radius`` bits of it."""
    flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(BITS), r)]
    return fp[:, None] ^ np.array(flips, np.uint64)


def links(known: DataFrame, most: int = 4) -> DataFrame:
    """Links (a, b) that join the distinct fingerprints ``known(fp)`` as all pairs of at most ``most`` (1 to 4) differing bits do.

    A fingerprint is filed under keys of equal segments, one for each way in which a chain of the ring can begin (``chains``);
    longer keys where there are more fingerprints, so that random ones seldom meet. Those of one key are compared, cut off where a chain's differences
    leave its budget. A key with over BUCKET fingerprints is not compared: these are filed anew under keys one segment longer, with all other such ones,
    and what is crowded under keys of four segments still meets at the words half way: two fingerprints differ in
    at most 4 bits if and only if some word is within 2 bits of both. That is a fixed number of rows a fingerprint, however many are close to each other.
    """
    prepare(known)
    out: list[DataFrame] = []
    many, todo = known.count(), known
    first = next(e for e in (1, 2, 3) if e == 3 or many <= CROWD << WIDTH * (e + 1))

    def filer(ways: list[tuple[int, tuple[int, ...]]]):
        def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                fp = batch.column("fp").to_numpy().view(np.uint64)
                keys = np.concatenate([key_of(fp, i, s) for i, (_, s) in enumerate(ways)]).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.tile(fp, len(ways)).view(np.int64))], ["key", "fp"])

        return file

    def comparer(ways: list[tuple[int, tuple[int, ...]]], width: int):
        starts = np.array([s for s, _ in ways])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, size = [], 0
            for batch in batches:
                held.append(tuple(batch.column(c).to_numpy() for c in ("key", "fp")))
                size += batch.num_rows
                if size >= HELD:
                    key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
                    cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
                    yield pairs(key[:cut], fp[:cut])
                    held, size = [(key[cut:], fp[cut:])], len(key) - cut
            if held:
                yield pairs(*(np.concatenate(x) for x in zip(*held, strict=True)))

        def pairs(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
            key, fp = key.view(np.uint64), fp.view(np.uint64)
            start = starts[(key >> np.uint64(WIDTH * width)).astype(np.int64)]
            a, b = close_pairs(key, fp, start, most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        return compare

    for extra in range(first, 4):
        ways = chains(extra)
        filed = todo.mapInArrow(filer(ways), "key long, fp long")
        full = filed.groupBy("key").count().filter(F.col("count") > BUCKET).select("key")
        crowded, todo = full.count(), None
        if crowded:
            full = checkpoint(full)
            full = F.broadcast(full) if crowded <= 100_000 else full
            todo = checkpoint(filed.join(full, "key", "left_semi").select("fp").distinct())
            filed = filed.join(full, "key", "left_anti")
        out.append(filed.repartition("key").sortWithinPartitions("key").mapInArrow(comparer(ways, extra + 1), "a long, b long"))
        if todo is None:
            break
    if todo is not None:
        out.append(meet_half_way(todo, most))
    found = out[0]
    for o in out[1:]:
        found = found.unionByName(o)
    return checkpoint(found.filter("a <> b").distinct())


def meet_half_way(crowd: DataFrame, most: int) -> DataFrame:
    """Links of fingerprints ``crowd(fp)`` at a word that is within half of ``most`` bits of the one and the rest of the other.

    Every fingerprint reaches all words within the larger half; the least of those within the smaller half is a word's
    hub, to which all that reach the word are linked. A word has no more rows than a fingerprint has words.
    """
    small, large = most // 2, most - most // 2

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy().view(np.uint64)
            for at in range(0, len(every), 256):
                fp = every[at : at + 256]
                word = middles(fp, large)
                far = np.ones(word.shape[1], bool)
                far[: middles(fp[:1], small).shape[1]] = False
                columns = word.ravel().view(np.int64), np.tile(far, len(fp)), np.repeat(fp, word.shape[1]).view(np.int64)
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns)], ["word", "far", "fp"])

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hub, linked = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)  # the last word so far, its hub, and whether that is near
        for batch in batches:
            if not batch.num_rows:
                continue
            word, fp = (np.concatenate([old, batch.column(c).to_numpy()]) for old, c in ((now, "word"), (hub, "fp")))
            near = np.concatenate([linked, ~batch.column("far").to_numpy(zero_copy_only=False)])
            fresh = np.concatenate([[True], word[1:] != word[:-1]])
            head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            mine = near[head] & (fp != fp[head])
            yield pa.RecordBatch.from_arrays([pa.array(fp[mine]), pa.array(fp[head][mine])], ["a", "b"])
            now, hub, linked = word[-1:], fp[head[-1:]], near[head[-1:]]

    met = crowd.mapInArrow(spread, "word long, far boolean, fp long").repartition("word").sortWithinPartitions("word", "far", "fp")
    return met.mapInArrow(star, "a long, b long")


def link(docs: DataFrame, n: int = 4, most: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row of ``docs(doc_id, text, ...)``.

    Rows link where their fingerprints (A-Z in lower case, ``n``-word shingles, repeats counted) differ in at most ``most`` (1 to 4) bits;
    component_id is the least doc_id that links reach. Equal fingerprints are one node from the start, so that copies cost a row of two numbers each.
    Rows of one doc_id are one node: its fingerprints are linked with each other. Empty and null texts have fingerprint zero,
    which links like any other. A null doc_id has its fingerprint and a null component, and links nothing. Long texts are hashed some
    words at a time. Repeated rows have the same result each; an empty table gives an empty one; other columns are left out.
    """
    described = checkpoint(fingerprints(docs, n))
    named = described.filter(F.col("doc_id").isNotNull())
    least = checkpoint(named.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    several = named.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).filter("a <> z")
    own = named.join(several, "doc_id").select(F.col("fp").alias("a"), F.col("a").alias("b")).filter("a <> b").distinct()
    roots = components(links(least.select("fp"), most).unionByName(own))
    placed = least.join(roots, F.col("fp") == F.col("v"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    lowest = placed.groupBy("root").agg(F.min("rep").alias("component_id"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_s")
    # a fingerprint or a component may have a third of all rows: it meets its number in SALTS tasks
    final = checkpoint(placed.withColumn("_s", F.pmod(F.xxhash64("fp"), F.lit(SALTS)).cast("int")).join(lowest.select("root", "component_id", spread), ["root", "_s"]).select("fp", "component_id"))
    salted = described.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    out = salted.join(final.select("fp", "component_id", spread), ["fp", "_s"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), component)
