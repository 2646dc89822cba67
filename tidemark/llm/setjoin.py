"""N-gram Jaccard self-join, exact, with answers derived from those of similar sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import kernels
from .common import checkpoint, prepare
from .components import SALTS, components

#: Parts beyond those that linked sets can differ in; a set with more empty parts than that files these, too.
SLACK = 2
#: A class in its family: its number, and the doc_id and text hash of the row whose text is its own.
MEMBER = ("id", "doc_id", "t", "family")
#: A larger family of candidates is cut into blocks of about so many sets.
BLOCK = 2048
#: The middle of a larger family is that of so many of its sets, and so many sets nearest to it are its hubs.
SAMPLE, HUBS = 64, 8
#: Below this percentage sets are filed by their rarest elements: parts of so different sets would be too small to tell them apart.
PARTS_FROM = 88
#: Elements are counted in buckets of about so many, and in so many buckets at least.
BUCKET, BUCKETS = 4_000_000, 64


def shingle_sets(column: pa.Array, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of each row the sorted hashes of its distinct n-word shingles (of fewer words: the whole sequence as one)."""
    data, rows = kernels.buffers(column)
    hashes, _, _, bounds = kernels.words(data, rows, lower=True)
    runs = kernels.grams(hashes, n)
    for i, a, z in kernels.per_row(bounds):
        if z - a >= n:
            yield i, np.unique(runs[a : z - n + 1])
        else:
            yield i, kernels.grams(hashes[a:z], z - a) if z > a else np.zeros(0, np.uint64)


class Levels:
    """Classes of set sizes, each with a number of parts into which a set of about that size is cut.

    Sets a, b link if percent * |union| <= 100 * |intersection|: they differ in at most (100 - percent) / (100 + percent) of
    |a| + |b| elements. Cut both into more parts than that by the elements' hash, and one part at least is the same.
    """

    def __init__(self, percent: int, grow: float = 1.5, most: int = 1 << 40):
        self.percent = percent
        low, lows = 1, [1]
        while low < most:
            low = max(low + 1, int(low * grow)) if self.differ(2 * low) else low + 1
            lows.append(low)
        self.lows = np.array(lows, np.int64)

    def differ(self, both: int) -> int:
        return (100 - self.percent) * both // (100 + self.percent)

    def of(self, size: int) -> list[tuple[int, int]]:
        """(level, parts) under which a set of that size is filed: its own and, if it can link to a larger set there, the next."""
        k = int(np.searchsorted(self.lows, size, "right")) - 1
        upto = [k] + [k + 1] * int(size * 100 // self.percent >= self.lows[k + 1])
        found = [(i, self.differ(2 * (int(self.lows[i + 1]) - 1))) for i in upto]
        return [(i, d + 1 + SLACK) for i, d in found if d]


def signatures(items: np.ndarray, levels: Levels) -> np.ndarray:
    """A hash of each part's content; parts are ranges of the sorted element hashes."""
    out = []
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(kernels.mix(items + np.uint64(0x51ED270B)))])
    for level, parts in levels.of(len(items)):
        edge = (np.arange(1, parts, dtype=np.float64) * (2.0**64 / parts)).astype(np.uint64)
        cut = np.concatenate([[0], np.searchsorted(items, edge), [len(items)]])
        label = np.arange(parts, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(level)
        sig = kernels.mix(kernels.mix(sums[cut[1:]] - sums[cut[:-1]]) + label)
        full = cut[1:] > cut[:-1]
        out.append(sig if parts - full.sum() > SLACK else sig[full])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def rarest(texts: DataFrame, classes: DataFrame, n: int, percent: int) -> DataFrame:
    """sig and h1: the elements under which each class is filed, so that any two that link share one; links (h1, hub) where a task's classes share one.

    Two sets of which one has s elements share at least percent * s / 100 if they link, so that in any common order of all
    elements the first s - ceil(percent * s / 100) + 1 of both have one in common. The order is by the number of classes that have
    an element: what only one has comes first and needs no filing, passages of many documents come last. Elements are counted
    by 32 bits of their hash within a bucket; elements that fall together there count together, in all sets alike.
    """
    total = classes.agg(F.sum("n_shingles")).first()[0] or 0
    buckets = max(BUCKETS, total // BUCKET)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            names, sets = [], []
            for _, s in shingle_sets(batch.column("text"), n):
                name = int(kernels.mix(s).sum(dtype=np.uint64).astype(np.int64))
                if len(s) and name not in seen:
                    seen.add(name)
                    names.append(name)
                    sets.append(s)
            if not sets:
                continue
            flat, owner = np.concatenate(sets), np.repeat(np.array(names, np.int64), [len(s) for s in sets])
            at = ((flat >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.argsort(at, kind="stable")
            flat, owner, at = flat[order].astype(np.uint32), owner[order], at[order]
            fresh = np.concatenate([[True], at[1:] != at[:-1]])
            row = np.flatnonzero(fresh)
            run = np.flatnonzero(fresh | np.concatenate([[True], owner[1:] != owner[:-1]]))
            length = np.diff(np.append(run, len(at))).astype(np.uint32)
            cut, ends = np.append(row, len(at)), np.append(np.searchsorted(run, row), len(run))
            parts = ((flat, cut), (owner[run], ends), (length, ends))
            blobs = [pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer((b * a.itemsize).astype(np.int32)), pa.py_buffer(a)]) for a, b in parts]
            yield pa.RecordBatch.from_arrays([pa.array(at[row]), *blobs], ["bucket", "marks", "names", "lengths"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []

        def shared() -> pa.RecordBatch:
            mark, name, length = (np.concatenate([np.frombuffer(h[k], t) for h in held]) for k, t in enumerate((np.uint32, np.int64, np.uint32)))
            _, first = np.unique(name, return_index=True)  # copies in other batches have the same run
            once = np.zeros(len(name), bool)
            once[first] = True
            mark, owner = mark[np.repeat(once, length)], np.repeat(name[once], length[once])
            order = np.argsort(mark, kind="stable")
            mark, owner = mark[order], owner[order]
            start = np.flatnonzero(np.concatenate([[True], mark[1:] != mark[:-1]]))
            count = np.diff(np.append(start, len(mark)))
            count = np.repeat(count, count)
            sig = (np.uint64(now) << np.uint64(32) | mark.astype(np.uint64)).view(np.int64)
            several = count > 1
            return pa.RecordBatch.from_arrays([pa.array(owner[several]), pa.array(sig[several]), pa.array(count[several])], ["h1", "sig", "count"])

        for batch in batches:
            for bucket, *blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != now and held:
                    yield shared()
                    held = []
                now = bucket
                held.append(blobs)
        if held:
            yield shared()

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[c.to_numpy() for c in b.columns] for b in batches]
        if not parts:
            return
        name, sig, count = (np.concatenate([p[k] for p in parts]) for k in range(3))
        order = np.lexsort((sig, count, name))
        name, sig, count = name[order], sig[order], count[order]
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        rows, size = np.diff(np.append(first, len(name))), sig[first]  # a class's first row has its size
        take = (size + (-size * percent) // 100 + 1) - (size - (rows - 1))
        rank = np.arange(len(name)) - np.repeat(first, rows)
        mine = (rank > 0) & (rank <= np.repeat(take, rows))
        yield combined(sig[mine], name[mine])

    dealt = texts.mapInArrow(deal, "bucket long, marks binary, names binary, lengths binary").repartition("bucket").sortWithinPartitions("bucket")
    sizes = classes.select("h1", F.col("n_shingles").alias("sig"), F.lit(0).cast("long").alias("count"))
    return dealt.mapInArrow(weigh, "h1 long, sig long, count long").unionByName(sizes).repartition("h1").mapInArrow(choose, "sig long, h1 long, hub long")


def _find(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def link_family(sets: list[np.ndarray], percent: int, answers: int = 16, read: list[int] | None = None) -> np.ndarray:
    """The exact components of a family of sets under the Jaccard threshold: for each set the least index of its component.

    Index lists hold the family in the order of size, so that a set's partners lie between two positions. All lists are one
    sorted array of (element, position), in which a list is entered at the first of these positions and left at the second: what
    lies before and behind is skipped, not read. The first ``answers`` sets' overlaps with all others are computed in full and kept. Another
    set's answer comes from the kept answer of the most similar set: that of the elements which only the other has is taken
    away, that of those which only it has is added, both between its positions. The number of postings read for each answer is appended to ``read``. After the first answers the largest component is home; sets that are in
    it by then or later need no answer, as a link between two components has an end outside home.
    """
    order = np.argsort([len(s) for s in sets], kind="stable")
    size = np.array([len(sets[i]) for i in order], np.int64)
    m = len(sets)
    flat = np.concatenate([sets[i] for i in order])
    member = np.repeat(np.arange(m), size)
    _, element = np.unique(flat, return_inverse=True)
    by = np.lexsort((member, element))
    posting, entry = member[by], element[by] * m + member[by]
    bounds = np.concatenate([[0], np.cumsum(size)])
    low = np.searchsorted(size * 100, size * percent, "left")
    high = np.searchsorted(size * percent, size * 100, "right")

    def overlaps(elements: np.ndarray, lo: int, hi: int) -> np.ndarray:
        enter, leave = np.searchsorted(entry, elements * m + lo), np.searchsorted(entry, elements * m + hi)
        if read is not None:
            read[-1] += int((leave - enter).sum())
        return np.bincount(posting[kernels.ranges(enter, leave - enter)], minlength=m)

    parent = np.arange(m)
    kept: list[tuple[int, np.ndarray]] = []
    nearest, best = np.full(m, -1), np.zeros(m, np.int64)
    todo, step, home = np.arange(m), 0, -1
    while len(todo):
        if step == 8 or (step > 8 and step % 32 == 0):
            root = np.array([_find(parent, x) for x in range(m)])
            if home < 0:
                home = int(np.bincount(root, minlength=m).argmax())
            todo = todo[root[todo] != root[home]]
            if not len(todo):
                break
        i = int(todo[len(todo) // 2 if step < 8 else 0])
        todo, step = todo[todo != i], step + 1
        own = element[bounds[i] : bounds[i + 1]]
        lo, hi = (0, m) if len(kept) < answers else (int(low[i]), int(high[i]))
        if read is not None:
            read.append(0)
        if kept and nearest[i] >= 0 and 2 * best[i] > size[i]:
            j, known = kept[nearest[i]]
            other = element[bounds[j] : bounds[j + 1]]
            answer = known - overlaps(np.setdiff1d(other, own, assume_unique=True), lo, hi) + overlaps(np.setdiff1d(own, other, assume_unique=True), lo, hi)
            answer[:lo] = answer[hi:] = 0
        else:
            answer = overlaps(own, lo, hi)
        if len(kept) < answers:
            better = answer > best
            nearest[better], best[better] = len(kept), answer[better]
            kept.append((i, answer))
        linked = np.flatnonzero(100 * answer >= percent * (size + size[i] - answer))
        for x in linked.tolist():
            a, b = _find(parent, x), _find(parent, i)
            if a != b:
                parent[max(a, b)] = min(a, b)
    label = np.empty(m, np.int64)
    label[order] = [_find(parent, x) for x in range(m)]
    first = np.full(m, m)
    np.minimum.at(first, label, np.arange(m))
    return first[label]


def combined(sig: np.ndarray, name: np.ndarray) -> pa.RecordBatch:
    """Of rows that file a class (``name``) under ``sig``: one row a sig, and links of the other classes there to that row's class.

    So a sig that a third of all classes have costs one row a batch where it is shuffled. Links are spread by their class.
    """
    order = np.lexsort((name, sig))
    sig, name = sig[order], name[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    hub = np.repeat(name[first], np.diff(np.append(first, len(sig))))
    a, b = forest(name, hub)
    none, here = pa.nulls(len(first), pa.int64()), np.concatenate([sig[first], a])
    return pa.RecordBatch.from_arrays([pa.array(here), pa.array(np.concatenate([name[first], a])), pa.concat_arrays([none, pa.array(b)])], ["sig", "h1", "hub"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components by as few links as there can be: of each node but the least to the least."""
    node, at = np.unique(np.stack([a, b])[:, a != b], return_inverse=True)
    parent = np.arange(len(node))
    for x, y in np.unique(at.reshape(2, -1), axis=1).T.tolist():
        x, y = _find(parent, x), _find(parent, y)
        parent[max(x, y)] = min(x, y)
    least = np.array([_find(parent, i) for i in range(len(node))], np.int64)
    mine = least != np.arange(len(node))
    return node[mine], node[least[mine]]


def around_hubs(texts: DataFrame, members: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of large families ``members(id, doc_id, t, family, blocks)``: the links (a, b) to their hubs, and the members outside the largest component of these.

    The middle of a family is the elements that half of SAMPLE of its sets have; its hubs are the HUBS sets nearest to that, of
    near copies the original among them. Every set is compared with each hub, in blocks. A link that is not found
    so has an end outside the largest component, and only its members need be compared with all others: a group of near copies that a third of
    all rows belong to costs a pass, not its square.
    """
    at = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("at")
    held = texts.join(members, ["doc_id", "t"]).dropDuplicates(["id"]).select("family", at, "blocks", "id", "text")
    drawn = members.withColumn("r", F.row_number().over(W.partitionBy("family").orderBy(F.xxhash64("id", F.lit(1)), "id"))).filter(F.col("r") <= SAMPLE)
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("at")

    def middle(group: pa.Table) -> pa.Table:
        sets = [s for _, s in shingle_sets(group["text"].combine_chunks(), n)]
        element, count = np.unique(np.concatenate(sets), return_counts=True)
        return pa.table({"family": group["family"].slice(0, 1), "middle": pa.array([element[2 * count >= len(sets)].tobytes()], pa.binary())})

    def overlaps(group: pa.Table, others: list[np.ndarray]) -> Iterator[tuple[int, int, np.ndarray]]:
        element, owner = np.concatenate(others), np.repeat(np.arange(len(others)), [len(o) for o in others])
        order = np.argsort(element, kind="stable")
        element, owner = element[order], owner[order]
        for i, s in shingle_sets(group["text"].combine_chunks(), n):
            a, z = np.searchsorted(element, s, "left"), np.searchsorted(element, s, "right")
            yield i, len(s), np.bincount(owner[kernels.ranges(a, z - a)], minlength=len(others))

    def distance(group: pa.Table, centre: pa.Table) -> pa.Table:
        score = np.zeros(len(group))
        if len(group) and len(centre):
            set_ = np.frombuffer(centre["middle"][0].as_py(), np.uint64)
            for i, size, met in overlaps(group, [set_]):
                score[i] = met[0] / max(1, size + len(set_) - met[0])
        return pa.table({"family": group["family"], "id": group["id"], "score": pa.array(score)})

    def meet(group: pa.Table, hubs: pa.Table) -> pa.Table:
        a: list[int] = []
        b: list[int] = []
        if len(group) and len(hubs):
            sets, names, ids = [s for _, s in shingle_sets(hubs["of"].combine_chunks(), n)], hubs["hub"].to_pylist(), group["id"].to_pylist()
            for i, size, met in overlaps(group, sets):
                for k in np.flatnonzero(100 * met >= percent * (size + np.array([len(s) for s in sets]) - met)).tolist():
                    a.append(ids[i])
                    b.append(names[k])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    middles = checkpoint(texts.join(drawn, ["doc_id", "t"]).dropDuplicates(["id"]).select("family", "blocks", "text").groupBy("family").applyInArrow(middle, "family long, middle binary"))
    large = members.select("family", "blocks").distinct()
    spots = middles.join(large, "family").select(F.col("family").alias("f"), blocks, "middle")
    scored = held.groupBy("family", "at").cogroup(spots.groupBy("f", "at")).applyInArrow(distance, "family long, id long, score double")
    best = scored.withColumn("r", F.row_number().over(W.partitionBy("family").orderBy(F.col("score").desc(), "id"))).filter(F.col("r") <= HUBS).select("id")
    best = members.select("id", "doc_id", "t", "family").join(best, "id")
    hubs = checkpoint(texts.join(best, ["doc_id", "t"]).dropDuplicates(["id"]).select("family", "id", "text")).join(large, "family")
    hubs = hubs.select(F.col("family").alias("f"), blocks, F.col("id").alias("hub"), F.col("text").alias("of"))
    links = checkpoint(held.groupBy("family", "at").cogroup(hubs.groupBy("f", "at")).applyInArrow(meet, "a long, b long"))
    label = checkpoint(members.join(components(links), F.col("id") == F.col("v"), "left").select(*MEMBER, F.coalesce("root", "id").alias("label")))
    home = label.groupBy("family", "label").count().groupBy("family").agg(F.max(F.struct("count", F.col("label"))).alias("h")).select("family", F.col("h.label").alias("home"))
    return links, checkpoint(label.join(home, "family").filter("label <> home").select(*MEMBER))


def link(docs: DataFrame, n: int = 3, percent: int = 90) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``docs(doc_id, text, ...)``.

    Rows link if the Jaccard similarity of their sets of n-word shingles (A-Z in lower case) is ``percent`` or more;
    component_id is the least doc_id that links reach. Equal sets are one class from the start, so that copies cost a
    row of hashes each. Each class files a hash of each part of its set, or its rarest elements where ``percent`` is low;
    classes that share one are candidates, and a task's lists are reduced to a forest. Families of candidates are compared exactly: one of up to
    BLOCK sets at once; of a larger one, all sets with its hubs, and then, block by block, those that these do not join
    to its largest component with all (``around_hubs``). A set without
    words links with nothing; a null doc_id has a null component and links nothing; rows of one doc_id are one node, whatever their texts and their order: its
    classes are linked with each other, and what a class is compared by is found by doc_id and the hash of the text; an empty table gives an empty one.
    """
    prepare(docs)
    levels = Levels(percent)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("t"), "text")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, first, second = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for i, s in shingle_sets(batch.column("text"), n):
                count[i] = len(s)
                first[i] = kernels.mix(s).sum(dtype=np.uint64).astype(np.int64)
                second[i] = kernels.mix(s ^ np.uint64(0x5DEECE66D)).sum(dtype=np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t"), *map(pa.array, (count, first, second))], ["doc_id", "t", "n_shingles", "h1", "h2"])

    described = checkpoint(texts.mapInArrow(describe, "doc_id long, t long, n_shingles long, h1 long, h2 long"))
    key = ["n_shingles", "h1", "h2"]
    own_row = described.filter(F.col("doc_id").isNotNull())
    classes = own_row.filter("n_shingles > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "t")).alias("_first"))
    classes = checkpoint(classes.select(*key, "_first.*", F.monotonically_increasing_id().alias("id")))

    def file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sigs, names = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for _, s in shingle_sets(batch.column("text"), n):
                name = int(kernels.mix(s).sum(dtype=np.uint64).astype(np.int64))
                if len(s) and name not in seen:
                    seen.add(name)
                    sigs.append(signatures(s, levels))
                    names.append(np.full(len(sigs[-1]), name))
            yield combined(np.concatenate(sigs).view(np.int64), np.concatenate(names))

    def star(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(list(batches), pa.schema([(c, pa.int64()) for c in ("sig", "h1", "hub")]))
        linked = held.filter(pc.is_valid(held["hub"]))
        here = combined(*(held.filter(pc.is_null(held["hub"]))[c].to_numpy() for c in ("sig", "h1")))
        here = here.filter(pc.is_valid(here.column("hub")))
        a, b = forest(*(np.concatenate([linked[c].to_numpy(), here.column(c).to_numpy()]) for c in ("h1", "hub")))
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    known = texts.filter(F.col("doc_id").isNotNull())
    filed = known.mapInArrow(file, "sig long, h1 long, hub long") if percent >= PARTS_FROM else rarest(known, classes, n, percent)
    stars = filed.repartition("sig").mapInArrow(star, "a long, b long")
    roots = components(stars)
    family = roots.select(F.col("v").alias("h1"), F.col("root").alias("family")).unionByName(roots.select(F.col("root").alias("h1"), F.col("root").alias("family")).distinct())
    members = checkpoint(classes.join(family, "h1").select(*MEMBER))
    sizes = checkpoint(members.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    large = sizes.filter("blocks > 1")
    tasks = members.join(sizes.filter("blocks = 1"), "family").select(*MEMBER, F.lit(0).alias("i"), F.lit(0).alias("j"))
    near: DataFrame | None = None
    if not large.isEmpty():
        near, astray = around_hubs(texts, members.join(large, "family"), n, percent)
        rounds = astray.groupBy("family").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("rounds"))
        own = lambda many: F.pmod(F.xxhash64("id"), F.col(many)).cast("int")
        upto = lambda many: F.explode(F.sequence(F.lit(0), F.col(many) - 1))
        every = members.join(large, "family").join(rounds, "family").withColumn("j", own("blocks")).select(*MEMBER, upto("rounds").alias("i"), "j")
        some = astray.join(large, "family").join(rounds, "family").withColumn("i", own("rounds")).select(*MEMBER, "i", upto("blocks").alias("j"))
        tasks = tasks.unionByName(every.unionByName(some).distinct())
    placed = texts.join(tasks, ["doc_id", "t"]).dropDuplicates(["family", "i", "j", "id"]).select("family", "i", "j", "id", "text")
    grouped = placed.repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, sets = None, [], []

        def answer() -> pa.RecordBatch:
            if len(sets) > 1:
                label = link_family(sets, percent)
                mine = np.array(names, np.int64)
                least = np.full(len(mine), np.iinfo(np.int64).max)
                np.minimum.at(least, label, mine)
                a, b = mine, least[label]
            else:
                a = b = np.zeros(0, np.int64)
            return pa.RecordBatch.from_arrays([pa.array(a[a != b]), pa.array(b[a != b])], ["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("family", "i", "j")), strict=True))
            ids = batch.column("id").to_pylist()
            for i, s in shingle_sets(batch.column("text"), n):
                if keys[i] != now:
                    yield answer()
                    now, names, sets = keys[i], [], []
                if len(s):
                    names.append(ids[i])
                    sets.append(s)
        yield answer()

    found = grouped.mapInArrow(compare, "a long, b long")
    several = own_row.groupBy("doc_id").agg(F.min(F.struct(*key)).alias("a"), F.max(F.struct(*key)).alias("z")).filter("a <> z")
    sharing = checkpoint(salted(own_row, several.select("doc_id"), "doc_id", F.xxhash64(*key)).join(classes.select(*key, "id"), key).select("doc_id", "id").distinct())
    least = sharing.groupBy("doc_id").agg(F.min("id").alias("b"))
    found = found.unionByName(salted(sharing, least, "doc_id", F.xxhash64("id")).select(F.col("id").alias("a"), "b").filter("a <> b"))
    linked = components(found if near is None else found.unionByName(near))
    marked = linked.unionByName(linked.select(F.col("root").alias("v"), "root").distinct())
    rooted = checkpoint(classes.join(marked, F.col("id") == F.col("v"), "left").select(*key, "id", "doc_id", "root"))
    named, lone = rooted.filter("root is not null"), rooted.filter("root is null")
    lowest = named.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    met = salted(named, lowest, "root", F.xxhash64("id")).select(*key, "id", "component_id")
    final = checkpoint(met.unionByName(lone.select(*key, "id", F.col("doc_id").alias("component_id"))))
    # empty texts have no class: theirs is that of their doc_id's other texts
    others = least.join(final, F.col("b") == F.col("id")).select("doc_id", "component_id")
    full = described.filter("n_shingles > 0").join(final.select(*key, "component_id"), key, "left").select("doc_id", "n_shingles", "component_id")
    none = described.filter("n_shingles = 0").join(others, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return full.unionByName(none).select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def salted(rows: DataFrame, small: DataFrame, key: str, by: Column) -> DataFrame:
    """``rows`` joined with ``small``, one row a key: a key's rows meet it in SALTS tasks, dealt by ``by``, as one may have a third of all."""
    many = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(by, F.lit(SALTS)).cast("int")).join(many, [key, "_salt"]).drop("_salt")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
t AS (SELECT rid, doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))
                               WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM d),
e AS (SELECT rid, len(g) AS n, unnest(g) AS x FROM t WHERE doc_id IS NOT NULL),
p AS (SELECT a.rid AS r1, b.rid AS r2, a.n AS n1, b.n AS n2, count(*) AS met FROM e a JOIN e b ON a.x = b.x AND a.rid < b.rid AND 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n GROUP BY ALL),
k AS (SELECT DISTINCT x.doc_id AS a, y.doc_id AS b FROM p JOIN t x ON x.rid = r1 JOIN t y ON y.rid = r2 WHERE 100 * met >= 90 * (n1 + n2 - met)),
l AS (SELECT a, b FROM k UNION SELECT b, a FROM k),
c AS (SELECT DISTINCT doc_id AS id, doc_id AS root FROM t WHERE doc_id IS NOT NULL UNION SELECT l.b, c.root FROM c JOIN l ON l.a = c.id),
m AS (SELECT id, min(root) AS component_id FROM c GROUP BY id)
SELECT t.doc_id, len(g)::BIGINT AS n_shingles, component_id FROM t LEFT JOIN m ON t.doc_id = m.id
"""
