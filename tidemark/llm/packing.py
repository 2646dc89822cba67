"""Best-fit packing of tokenised documents, with a lower bound that certifies each partition's number of bins."""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels
from .common import checkpoint, prepare

#: The split of a text that belongs to the byte-level vocabulary files. Fixed value.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A text with a longer run of space or of no space goes to the slower tokenizer, whose time does not grow with a run's square.
LONG_RUN = 2000
_loaded: dict[int, tuple] = {}


def load(blob: bytes) -> tuple:
    """(slow, fast, names): the file's encoder as it is, its vocabulary as byte ranks, and its added tokens' texts, which only the former knows."""
    key = zlib.crc32(blob)
    if key not in _loaded:
        import tiktoken
        from tokenizers import Tokenizer

        slow = Tokenizer.from_str(blob.decode())
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        spec = json.loads(blob)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        _loaded[key] = slow, tiktoken.Encoding("bytes", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}), sorted(special)
    return _loaded[key]


def longest_runs(data: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """For each row the longest run of space or of no space."""
    out = np.zeros(len(rows) - 1, np.int64)
    if len(data):
        space = kernels.IS_SPACE[data]
        edge = np.ones(len(data), bool)
        edge[1:] = space[1:] != space[:-1]
        edge[rows[:-1][rows[:-1] < len(data)]] = True
        begin = np.flatnonzero(edge)
        np.maximum.at(out, np.searchsorted(rows, begin, "right") - 1, np.diff(np.append(begin, len(data))))
    return out


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every row of ``docs(doc_id, text)``.

    A document is the ids of its text and then id 0 (null text: id 0 alone). One longer than ``capacity`` is cut into
    pieces of that length, of which the first may be shorter. Ids are those of the file's tokenizer as it is, so that the name
    of a special token in a text is that token; texts with such a name or a very long run go to that tokenizer itself, the
    others to its vocabulary as byte ranks. Repeated rows are cut each; a null doc_id stays null; an empty table gives an empty one.
    """
    spark = prepare(docs)
    with open(tokenizer, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slow, fast, names = load(shared.value)
        for batch in batches:
            column = batch.column("text").fill_null("")
            plain = longest_runs(*kernels.buffers(column)) <= LONG_RUN
            for name in names:
                plain &= ~pc.match_substring(column, name).to_numpy(zero_copy_only=False)
            rows: list[tuple] = []
            for i in range(len(column)):
                text = column[i].as_py()
                ids = fast.encode_ordinary(text) if plain[i] else slow.encode(text, add_special_tokens=False).ids
                ids.append(0)
                raw, n = np.array(ids, "<u4").tobytes(), len(ids)
                first = n - (n - 1) // capacity * capacity
                for k, start in enumerate([0, *range(first, n, capacity)]):
                    stop = first if k == 0 else start + capacity
                    rows.append((i, k, start, stop - start, zlib.crc32(raw[4 * start : 4 * stop])))
            at, *rest = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else [np.zeros(0, np.int64)] * 5
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(at)), pa.array(rest[0].astype(np.int32)), *map(pa.array, rest[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """Fewest bins that the lengths can need."""
    return bound_of(np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """That of a histogram of lengths from 0 to capacity, by two families of dual feasible functions."""
    size = np.arange(capacity + 1)
    best = -(-int((count * size).sum()) // capacity)
    half = capacity // 2
    many, mass = np.cumsum(count[::-1])[::-1], np.cumsum(count * size)
    for least in range(1, half + 1):  # above capacity - least: a bin each; from least to the half: into what the others leave
        alone = many[capacity - least + 1] if least > 0 else 0
        big = many[half + 1] - alone
        room = big * capacity - (mass[capacity - least] - mass[half])
        small = mass[half] - mass[least - 1]
        best = max(best, int(alone + big + max(0, -(-(small - room) // capacity))))
    for k in range(1, 31):  # rounding to the k-th parts of a bin
        exact = (size * (k + 1)) % capacity == 0
        value = np.where(exact, size * k * 1.0, (size * (k + 1)) // capacity * float(capacity))
        best = max(best, int(np.ceil(float((count * value).sum()) / (k * capacity) - 1e-9)))
    return best


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Best-fit decreasing: each length's bin and its place there, and the number of bins. A bit for each room that some bin has."""
    order = np.argsort(-lengths, kind="stable")
    which, place = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, 0
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = open_bins[room].pop()
            if not open_bins[room]:
                rooms &= ~(1 << room)
        else:
            b, room, bins = bins, capacity, bins + 1
        which[i], place[i] = b, capacity - room
        if room > n:
            open_bins[room - n].append(b)
            rooms |= 1 << (room - n)
    return which, place, bins


#: Bits of a sequence's number: the exchange round in which it was made, its partition there, its place in that.
ROUND_BITS, PART_BITS, PLACE_BITS = 6, 32, 25


def sequence_ids(step: int, part: int, place: np.ndarray) -> np.ndarray:
    """Numbers that no other round, partition or place has; from 0 to 2 ** 63 - 1."""
    if step >> ROUND_BITS or part >> PART_BITS or place.max(initial=0) >> PLACE_BITS:
        raise ValueError(f"no sequence number for place {place.max(initial=0)} of partition {part} in round {step}")
    return place.astype(np.int64) | (step << (PART_BITS + PLACE_BITS) | part << PLACE_BITS)


def pack(items: DataFrame, capacity: int = 2048, part_rows: int = 20_000, rounds: int | None = None, merge: int = 4) -> DataFrame:
    """``items`` (any columns, ``length`` from 1 to capacity) with sequence_id, offset and certified.

    Items that fill a sequence are alone. The others are dealt to partitions of about ``part_rows`` and packed by best-fit
    decreasing there; a partition is certified if its bins equal its lower bound. While all bins together are more than the
    lower bound over all items (a histogram of ``capacity`` rows), partitions with room exchange: the items of each one's
    emptiest bins go on, ``part_rows`` at most, those of ``merge`` partitions meet, are packed again, and take the new bins if
    these are fewer. Rounds end when the bound is met, no room is left or all have met (``rounds`` sets fewer). certified is
    true for full bins, those of certified partitions, and all if the bound over all items is met. So no group is ever larger
    than ``merge`` partitions. Repeated rows are separate items; an empty table gives an empty one; columns of the three names are replaced.
    """
    spark = prepare(items)
    names = [c for c in items.columns if c not in ("sequence_id", "offset", "certified")]
    base = checkpoint(items.select(F.struct(*names).alias("_item"), F.col("length").cast("long").alias("_length"))).withColumn("_row", F.monotonically_increasing_id())
    alone = base.filter(F.col("_length") >= capacity).select("_item.*", (-F.col("_row") - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), F.lit(True).alias("certified"))
    rest = base.filter(F.col("_length") < capacity)
    parts = max(1, -(-rest.count() // part_rows))
    if rounds is None:
        rounds = next(k for k in range(64) if merge**k >= parts)
    todo = rest.select("_row", F.col("_length").alias("length"), F.pmod(F.xxhash64("_row"), F.lit(parts)).alias("_part"), F.lit(None).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    schema = "_row long, length long, _part long, sequence_id long, offset long, final boolean, certified boolean"
    done: list[DataFrame] = []

    def repacked(step: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        def repack(group: pd.DataFrame) -> pd.DataFrame:
            group = group.sort_values("_row", ignore_index=True)
            lengths, part = group["length"].to_numpy(), int(group["_part"].iloc[0])
            which, place, bins = best_fit(lengths, capacity)
            old = group["sequence_id"]
            if old.isna().any() or bins < old.nunique():
                group["sequence_id"], group["offset"] = sequence_ids(step, part, which), place
            ids, at = np.unique(group["sequence_id"].to_numpy(np.int64), return_inverse=True)
            fill, members = np.bincount(at, lengths), np.bincount(at)
            good = (fill == capacity) | (len(ids) == lower_bound(lengths, capacity))
            order = np.argsort(fill, kind="stable")
            order = order[fill[order] < capacity]
            on = np.zeros(len(ids), bool)
            on[order[(np.cumsum(members[order]) <= part_rows) | (np.arange(len(order)) == 0)]] = True
            group["_part"] = part // merge
            return group.assign(sequence_id=group["sequence_id"].astype("int64"), final=~on[at], certified=good[at])

        return repack

    count = np.zeros(capacity + 1, np.int64)
    for r in rest.groupBy("_length").count().collect():
        count[r["_length"]] = r["count"]
    fewest, settled = bound_of(count, capacity), 0
    for step in range(rounds + 1):
        packed = checkpoint(todo.groupBy("_part").applyInPandas(repacked(step), schema))
        first = {r["final"]: r["count"] for r in packed.filter("offset = 0").groupBy("final").count().collect()}
        met = settled + sum(first.values()) == fewest
        settled += first.get(True, 0)
        last = met or step == rounds or not first.get(False)
        done.append((packed if last else packed.filter("final")).select("_row", "sequence_id", "offset", "certified"))
        if last:
            break
        todo = packed.filter("not final").drop("final", "certified")
    placed = done[0]
    for d in done[1:]:
        placed = placed.unionByName(d)
    return rest.join(placed.withColumn("certified", F.col("certified") | F.lit(met)), "_row").select("_item.*", "sequence_id", "offset", "certified").unionByName(alone)
