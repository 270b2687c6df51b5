"""Self-join of documents on the Jaccard similarity of their word n-grams.

Documents that may be similar share a signature. Either the n-grams have one order for the whole
corpus, frequent ones last: of two similar sets, the first n-grams of both, a share of 1 -
similarity, have one in common. Or sets are cut into parts by the n-grams' hashes, one part more than
they may differ in: one part at least is equal in both.

A document is first compared with those that share most signatures with the same leading
document, in blocks that all hold the leader. That joins copies of one text, however many, at the cost of one
comparison each or so. What is left are signatures whose documents are still in
different components. Of these, sketches of a few dozen bytes rule out most pairs: two sets differ in at least as
many n-grams as the parities of their hash slots do. What remains is compared in blocks of
different components.

In a block, a token-group matrix holds the union of the n-grams of each group of similar documents; a
document's overlap with the union bounds its similarity to every member, and only groups
that may qualify are opened and compared exactly.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.llm import bitmap
from hitmill.llm import words as w
from hitmill.llm.components import components
from hitmill.llm.scratch import drop, stage

# N-grams that one task compares at once; larger groups of documents are cut in blocks.
BLOCK_TOKENS = 300_000
# Hash slots in which the n-grams of a block are counted before it meets another.
UNION_SLOTS = 1 << 15
# Bits of the smallest sketch; larger sets have as many as n-grams, about.
SKETCH_BITS = 256
# Rows that a task compares by sketches at once, and rows of one signature in a part.
SKETCH_ROWS = 40_000
RUN = 2048
# Groups of a block, at most: columns of the token-group matrix.
GROUPS = 64
# Hash slots in which n-grams are counted to order them: 4 MB. Counts travel in so many packed
# ranges, of so many tasks together at a time.
SLOTS = 1 << 22
RANGES = 64
TASKS = 256


class Parts:
    """How many parts a set of some size is cut into, by the size class of the larger set."""

    def __init__(self, numerator: int, denominator: int):
        self.numerator, self.denominator = numerator, denominator
        bounds = [1]
        while bounds[-1] < 1 << 40:
            bounds.append(max(bounds[-1] + 1, bounds[-1] * 4 // 3))
        self.bounds = np.array(bounds, np.int64)
        most = (self.bounds[1:] - 1) * 2 * (denominator - numerator) // (denominator + numerator)
        # A few more parts than pigeons need: that many equal parts may be too small to tell.
        self.spare = np.where(most >= 4, 1 + most // 25, 0)
        self.parts = most + 1 + self.spare
        self.weak = 2 if denominator - numerator <= denominator // 8 else 1

    def size_class(self, n: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.bounds, n, "right") - 1

    def signatures(self, values: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of the sets values[first[i]:first[i + 1]], and where each set's begin.

        A set has signatures for its own size class, and for those of larger possible
        partners. Parts of hardly any n-gram are left out where enough others remain: if all
        parts that two sets share are that small, both sets have too many of them.
        """
        n = np.diff(first)
        full = np.flatnonzero(n > 0)
        own = self.size_class(n[full])
        top = self.size_class(n[full] * self.denominator // self.numerator)
        found, owners = [], []
        spread = w.mix(values)
        for step in range(int((top - own).max(initial=0)) + 1):
            sets = full[own + step <= top]
            if not len(sets):
                continue
            kind = self.size_class(n[sets]) + step
            parts = self.parts[kind]
            base = np.concatenate([[0], np.cumsum(parts)])
            count = n[sets]
            at = np.repeat(np.arange(len(sets)), count)
            index = np.arange(len(at)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(first[sets], count)
            place = base[at] + ((values[index] >> np.uint64(11)) % parts[at].astype(np.uint64)).astype(np.int64)
            sums = np.zeros(base[-1], np.uint64)
            np.add.at(sums, place, spread[index])
            size = np.bincount(place, minlength=base[-1])
            owner = np.repeat(np.arange(len(sets)), parts)
            number = np.arange(base[-1]) - base[owner]
            sums = w.mix(sums + w.mix((kind[owner] << 40 | number).astype(np.uint64)))
            weak = size <= self.weak
            few = np.bincount(owner[weak], minlength=len(sets)) <= self.spare[kind]
            keep = ~(weak & few[owner])
            found.append(sums[keep])
            owners.append(sets[owner[keep]])
        if not found:
            return np.zeros(0, np.uint64), np.zeros(len(first), np.int64)
        values, owner = np.concatenate(found), np.concatenate(owners)
        order = np.argsort(owner, kind="stable")
        return values[order], np.searchsorted(owner[order], np.arange(len(first)))


def _slots(values: np.ndarray) -> np.ndarray:
    return (w.mix(values) & np.uint64(SLOTS - 1)).astype(np.int64)


def _counted(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for _, block in w.slices(batches, "text"):
            np.add.at(counts, _slots(_sets(block, size)[0]), 1)
        if counts.any():
            part = TaskContext.get().partitionId() % TASKS
            packed = [zlib.compress(x.tobytes(), 1) for x in np.minimum(counts, 65535).astype("<u2").reshape(RANGES, -1)]
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(RANGES, dtype=np.int32)), pa.array(np.full(RANGES, part, np.int32)), pa.array(packed, pa.binary())], names=["range", "part", "counts"])

    return run


def _added(kind: str):
    def run(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zlib.decompress(x), kind).astype(np.int64) for x in table.column("counts").to_pylist())
        return pa.table({"range": table.column("range").slice(0, 1), "counts": pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())})

    return run


def levels(source: DataFrame, size: int) -> bytes:
    """How frequent the n-grams of every hash slot are in all documents: a quarter of a power of two
    per step, a byte per slot.

    A task sends its counts as RANGES packed arrays, a few bits per slot; they are added up for
    TASKS tasks at a time, and RANGES rows reach the driver.
    """
    counts = source.select("text").mapInArrow(_counted(size), "range int, part int, counts binary")
    some = counts.groupBy("range", "part").applyInArrow(_added("<u2"), "range int, counts binary")
    found = np.zeros((RANGES, SLOTS // RANGES), np.uint8)
    for r in some.groupBy("range").applyInArrow(_added("<i8"), "range int, counts binary").collect():
        total = np.frombuffer(zlib.decompress(r.counts), "<i8")
        found[r.range] = np.minimum(np.log2(np.maximum(total, 1)) * 4, 255)
    return found.tobytes()


def prefixes(values: np.ndarray, first: np.ndarray, similarity: tuple[int, int], frequency: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The rarest n-grams of the sets values[first[i]:first[i + 1]], and where each set's begin.

    Linked sets share at least o = ceil(similarity * size) n-grams, seen from either side, so the
    first size - o + 1 in one common order of all n-grams have one in common.
    """
    p, q = similarity
    n = np.diff(first)
    owner = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((w.mix(values), np.frombuffer(frequency, np.uint8)[_slots(values)], owner))
    long = np.where(n > 0, n + 1 + -(p * n) // q, 0)
    keep = np.arange(len(values)) - first[owner] < long[owner]
    return values[order][keep], np.concatenate([[0], np.cumsum(long)])


def _sets(block: w.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    lowered = block.lowered()
    found = w.words(lowered)
    values, of, _ = w.shingles(w.word_hashes(lowered, found), found.first, size, whole=True)
    return w.distinct(values, of, len(block))


def sketches(values: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Parities of the hash slots of each set: a power of two of bits, as many as n-grams or more."""
    n = np.diff(first)
    width = np.maximum(SKETCH_BITS, 1 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(width)])
    owner = np.repeat(np.arange(len(n)), n)
    spread = w.mix(values ^ np.uint64(0x5851F42D4C957F2D))
    place = base[owner] + (spread & (width[owner] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.bincount(place, minlength=int(base[-1])).astype(np.uint8) & 1
    packed, ends = np.packbits(bits, bitorder="little").tobytes(), (base // 8).tolist()
    return [packed[a:b] for a, b in zip(ends, ends[1:])]


def _folded(matrix: np.ndarray, width: int) -> np.ndarray:
    """Sketches of fewer words: slots that fall together add their parities."""
    while matrix.shape[1] > width:
        half = matrix.shape[1] // 2
        matrix = matrix[:, :half] ^ matrix[:, half:]
    return matrix


def may_link(a: np.ndarray, b: np.ndarray, n: np.ndarray, sketch: list[bytes | None], similarity: tuple[int, int]) -> np.ndarray:
    """Which pairs of sets (by number) their sizes and sketches do not rule out. A set without
    sketch is not ruled out."""
    p, q = similarity
    width = np.array([0 if x is None else len(x) // 8 for x in sketch])
    may = (q * np.minimum(n[a], n[b]) >= p * np.maximum(n[a], n[b])) | (width[a] == 0) | (width[b] == 0)
    row = np.zeros(len(n), np.int64)
    tables = {}
    for size in np.unique(width[width > 0]).tolist():
        at = np.flatnonzero(width == size)
        row[at] = np.arange(len(at))
        tables[size] = np.frombuffer(b"".join([sketch[i] for i in at.tolist()]), "<u8").reshape(-1, size)
    for x in tables:
        for y in tables:
            at = np.flatnonzero(may & (width[a] == x) & (width[b] == y))
            for part in np.array_split(at, max(1, len(at) * min(x, y) // 2_000_000)):
                i, j = a[part], b[part]
                least = min(x, y)
                apart = np.bitwise_count(_folded(tables[x][row[i]], least) ^ _folded(tables[y][row[j]], least)).sum(axis=1, dtype=np.int64)
                may[part] = (p + q) * apart <= (q - p) * (n[i] + n[j])
    return may


def _labels(count: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest number that each of ``count`` nodes reaches by edges."""
    label = np.arange(count)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if np.array_equal(label, before):
            break
    return label


def _sketched(similarity: tuple[int, int]):
    """Of rows with a common signature (``run``), those that others of another component may be
    similar to, with a leader for all that hang together."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(np.asarray(table.column("run")), kind="stable")
        key, node, component, n = (np.asarray(table.column(c))[order] for c in ("run", "node", "component", "n"))
        names, lead, which = np.unique(node, return_index=True, return_inverse=True)
        held = table.column("bits").to_pylist()
        sketch = [held[order[i]] for i in lead.tolist()]
        sizes = n[lead]
        begin = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        length = np.diff(np.append(begin, len(key)))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]

        def test(x: np.ndarray, y: np.ndarray) -> None:
            apart = component[x] != component[y]
            # Pairs that share several signatures are looked at once.
            one, two = np.divmod(np.unique(which[x[apart]] * len(names) + which[y[apart]]), len(names))
            good = may_link(one, two, sizes, sketch, similarity)
            a.append(one[good])
            b.append(two[good])
            if sum(map(len, a)) > 300_000:
                # What hangs together is enough.
                label = _labels(len(names), np.concatenate(a), np.concatenate(b))
                tied = np.flatnonzero(label != np.arange(len(names)))
                a[:], b[:] = [tied], [label[tied]]

        for m in np.unique(length[length > 1]).tolist():
            starts = begin[length == m]
            if m <= 64:
                i, j = np.triu_indices(m, 1)
                step = max(1, 200_000 // len(i))
                for k in range(0, len(starts), step):
                    test((starts[k : k + step, None] + i).reshape(-1), (starts[k : k + step, None] + j).reshape(-1))
                continue
            step = max(1, 200_000 // m)
            for start in starts.tolist():
                for k in range(0, m, step):
                    i, j = np.divmod(np.arange(min(step, m - k) * m), m)
                    ahead = j > i + k
                    test(start + k + i[ahead], start + j[ahead])
        x, y = np.concatenate(a), np.concatenate(b)
        label = _labels(len(names), x, y)
        some = np.unique(np.concatenate([x, y]))
        w.give_back()
        return pa.table({"node": pa.array(names[some]), "component": pa.array(component[lead][some]), "leader": pa.array(names[label[some]])})

    return run


def _signed(size: int, sign):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in w.slices(batches, "text"):
            values, first = _sets(block, size)
            signatures, begins = sign(values, first)
            sums = np.concatenate([np.zeros((2, 1), np.uint64), np.cumsum([w.mix(values), w.mix(values ^ np.uint64(0xA5A5A5A5A5A5A5A5))], axis=1, dtype=np.uint64)], axis=1)
            keys = w.mix(sums[:, first[1:]] - sums[:, first[:-1]])
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), pa.array(np.diff(first)), *(pa.array(k.view(np.int64)) for k in keys), pa.array(sketches(values, first), pa.binary()), w.long_lists(signatures, begins)],
                names=["doc_id", "n_shingles", "k1", "k2", "bits", "signatures"],
            )

    return run


def _held(bits: bytes):
    """The rows whose node may be in the bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(bitmap.holds(bits, np.asarray(batch.column("node")))))

    return run


def compare(nodes: np.ndarray, values: np.ndarray, first: np.ndarray, queries: int, similarity: tuple[int, int], known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between sets, as far as they join components; by the token-group matrix.

    ``queries``: only the first so many sets are compared with the others; 0: all with all.
    ``known``: components that are known already; sets of one are not compared.
    """
    p, q = similarity
    n, size = len(nodes), np.diff(first)
    lowest = np.minimum.reduceat(values, first[:-1])
    side = np.arange(n) < queries
    order = np.lexsort((size, lowest, ~side))
    distinct, token = np.unique(values, return_inverse=True)
    token = np.concatenate([token[first[i] : first[i + 1]] for i in order])
    nodes, size = nodes[order], size[order]
    first = np.concatenate([[0], np.cumsum(size)])
    begin = queries
    width = max(16, -(-(n - begin) // GROUPS))
    edges = [*range(begin, n, width), n]
    matrix = np.zeros((len(distinct), len(edges) - 1), np.uint8)
    low, high = np.empty(len(edges) - 1, np.int64), np.empty(len(edges) - 1, np.int64)
    for g, (a, b) in enumerate(zip(edges, edges[1:])):
        matrix[token[first[a] : first[b]], g] = 1
        low[g], high[g] = size[a:b].min(), size[a:b].max()
    parent = list(range(n))
    if known is not None:
        _, lead, which = np.unique(known[order], return_index=True, return_inverse=True)
        parent = lead[which].tolist()

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    links = []
    mark = np.zeros(len(distinct), bool)
    for i in range(queries or n):
        own = token[first[i] : first[i + 1]]
        overlap = matrix[own].sum(axis=0, dtype=np.int64)
        may = (q * overlap >= p * (size[i] + np.maximum(low, overlap) - overlap)) & (q * high >= p * size[i])
        here = 0 if queries else i // width
        may[:here] = False
        if not may.any():
            continue
        mark[own] = True
        mine = root(i)
        for g in np.flatnonzero(may).tolist():
            a, b = max(edges[g], 0 if queries else i + 1), edges[g + 1]
            if a >= b or all(root(j) == mine for j in range(a, b)):
                continue
            shared = np.add.reduceat(mark[token[first[a] : first[b]]], first[a:b] - first[a], dtype=np.int64)
            for j in (a + np.flatnonzero(q * shared >= p * (size[i] + size[a:b] - shared))).tolist():
                other = root(j)
                if other != mine:
                    parent[other] = mine
                    links.append((int(nodes[i]), int(nodes[j])))
        mark[own] = False
    return links


def _block(similarity: tuple[int, int], sets):
    """Compare the sets of a block, or of two; ``sets`` reads them from the column ``held``."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        second = np.asarray(table.column("second"))
        table = table.take(pa.array(np.argsort(second, kind="stable")))
        values, first = sets(table.column("held"))
        filled = np.diff(first) > 0
        nodes, known = (np.asarray(table.column(c))[filled] for c in ("node", "component"))
        first = np.append(first[:-1][filled], first[-1])
        queries = int((np.sort(second)[filled] == 0).sum()) if second.any() else 0
        alone = len(nodes) < 2 or second.any() and queries in (0, len(nodes))
        links = [] if alone else compare(nodes, values, first, queries, similarity, known)
        w.give_back()
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([x for _, x in links], pa.int64())})

    return run


def _union(sets):
    """The n-grams that a block's sets have together, counted in UNION_SLOTS hash slots."""

    def run(table: pa.Table) -> pa.Table:
        values, _ = sets(table.column("held"))
        counts = np.bincount((w.mix(np.unique(values)) & np.uint64(UNION_SLOTS - 1)).astype(np.int64), minlength=UNION_SLOTS)
        return pa.table({**{c: table.column(c).slice(0, 1) for c in ("family", "part")}, "counts": pa.array([zlib.compress(counts.astype("<u4").tobytes(), 1)], pa.binary())})

    return run


def _may_meet(similarity: tuple[int, int]):
    """The pairs of blocks whose unions share as many n-grams as their smallest sets need."""
    p, q = similarity

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ([np.frombuffer(zlib.decompress(b), "<u4") for b in batch.column(c).to_pylist()] for c in ("of_x", "of_y"))
            # In every slot, no more n-grams are common than the smaller count.
            common = np.array([int(np.minimum(a, b).sum()) for a, b in zip(x, y)], np.int64)
            may = (p + q) * common >= p * np.asarray(batch.column("least"))
            yield batch.select(["family", "x", "y"]).filter(pa.array(may))

    return run


def token_lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sets that are stored as lists of numbers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = np.asarray(lists.offsets).astype(np.int64)
    return np.asarray(lists.values)[offsets[0] : offsets[-1]].view(np.uint64), offsets - offsets[0]


def similar(rows: DataFrame, sizes: DataFrame, held, sets, similarity: tuple[int, int]) -> DataFrame:
    """Links between sets, as far as they join components: columns ``a`` and ``b``, stored.

    ``rows`` (node, s) has the signatures of every set; sets with a common one are compared.
    ``sizes``: node and ``n``, and ``bits`` where there are sketches. ``held`` gets a bitmap of nodes and returns their sets as (node, held),
    possibly with others; ``sets`` reads the column held inside a task.
    """
    spark, links, done = rows.sparkSession, "a long, b long", []

    def keep(df: DataFrame, label: str) -> DataFrame:
        df, path = stage(df, label)
        done.append(path)
        return df

    shared = rows.groupBy("s").agg(F.min("node").alias("leader"), F.max("node").alias("last")).where("leader < last").drop("last")
    shared = keep(shared, "shared")
    met = keep(bitmap.keep(rows, "s", bitmap.build(shared, "s")).join(shared, "s"), "met")
    sketched = "bits" in sizes.columns
    size = [F.max("n").alias("n")]
    if sketched:
        # A node with several sets has no sketch.
        size.append(F.when(F.min("bits") == F.max("bits"), F.min("bits")).alias("bits"))
    nodes = keep(met.select("node").distinct().join(sizes, "node").groupBy("node").agg(*size), "nodes")

    # Every set with the leader it shares most signatures with, the leader in every block.
    often = met.where("node <> leader").groupBy("node", "leader").agg(F.count("*").alias("c"))
    led = often.groupBy("node").agg(F.max(F.struct("c", (-F.col("leader")).alias("leader"))).alias("best")).select("node", (-F.col("best.leader")).alias("leader"))
    led = keep(led.join(nodes, "node"), "led")
    blocks = led.groupBy("leader").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("long").alias("blocks"))
    follow = led.join(blocks, "leader").select("leader", "node", F.pmod(F.xxhash64("node"), "blocks").alias("block"))
    heads = blocks.select("leader", F.col("leader").alias("node"), F.explode(F.expr("sequence(0L, blocks - 1)")).alias("block"))
    table = held(bitmap.build(nodes, "node"))
    first = follow.unionByName(heads).join(table, "node").withColumns({"second": F.lit(0), "component": F.col("node")})
    found = keep(first.groupBy("leader", "block").applyInArrow(_block(similarity, sets), links), "links")

    # Signatures whose sets are in different components.
    near = components(found, "a", "b").withColumnRenamed("node", "near")
    one = F.coalesce("component", "node").alias("component")
    placed = keep(met.join(near, F.col("node") == F.col("near"), "left").select("node", "s", one), "placed")
    open_at = placed.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("node").alias("leader")).where("low < high")
    if sketched:
        open_at = keep(placed.groupBy("s").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("c")).where("low < high").drop("low", "high"), "open")
        rows = placed.join(open_at, "s").join(nodes, "node")
        # Rows of a frequent signature are cut in parts, and all parts meet.
        parts = F.ceil(F.col("c") / RUN).cast("long")
        own = F.pmod(F.xxhash64("node"), parts)
        met_by = F.transform(F.sequence(F.lit(0).cast("long"), parts - 1), lambda j: F.xxhash64("s", F.least(own, j), F.greatest(own, j)))
        rows = rows.select("node", "component", "n", "bits", F.explode(met_by).alias("run"))
        groups = max(1, -(-(placed.join(open_at, "s").count()) // SKETCH_ROWS))
        left = rows.groupBy(F.pmod("run", F.lit(groups)).alias("group")).applyInArrow(_sketched(similarity), "node long, component long, leader long")
    else:
        left = placed.join(open_at.select("s", "leader"), "s").select("node", "component", "leader").distinct()
    left = keep(left, "left")
    result = found
    if not left.isEmpty():
        result = found.unionByName(_across(left, nodes, held, sets, similarity, keep))
    result, _ = stage(result, "links")
    drop(spark, *done)
    return result


def _across(left: DataFrame, nodes: DataFrame, held, sets, similarity: tuple[int, int], keep) -> DataFrame:
    """Links between sets of different components that ``left`` (node, component, leader) brings together.

    Families of sets are cut in blocks. A component that fills blocks has blocks of its own; the
    others are pooled. Blocks of one component do not meet, nor do blocks whose sizes are too
    unlike, or whose unions of n-grams have too few in common for any two of their sets.
    """
    p, q = similarity
    ties = components(left.select("node", "leader"), "node", "leader").withColumnRenamed("node", "tied").withColumnRenamed("component", "family")
    nodes = nodes.select("node", "n")
    members = left.select("node", "component").distinct().join(ties, F.col("node") == F.col("tied"), "left")
    members = keep(members.select("node", "component", F.coalesce("family", "node").alias("family")).join(nodes, "node"), "members")
    parts = members.groupBy("family", "component").agg(F.sum("n").alias("n"))
    large = parts.where(F.col("n") >= BLOCK_TOKENS).select("family", "component", F.ceil(F.col("n") / BLOCK_TOKENS).cast("long").alias("own"))
    pooled = parts.where(F.col("n") < BLOCK_TOKENS).groupBy("family").agg(F.ceil(F.sum("n") / BLOCK_TOKENS).cast("long").alias("pool"))
    cut = members.join(large, ["family", "component"], "left").join(pooled, "family", "left")
    own = F.col("own").isNotNull()
    # A block: of which component (or pooled), and its number.
    whose = F.when(own, F.col("component")).alias("whose")
    number = F.when(own, F.pmod(F.xxhash64("node"), "own")).otherwise(F.pmod(F.xxhash64("component"), "pool")).alias("block")
    cut = keep(cut.select("family", "node", "component", "n", whose, number, F.xxhash64(whose, number).alias("part")), "cut")
    blocks = cut.groupBy("family", "part", "whose").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.count_distinct("component").alias("held"))
    one, two = blocks.alias("one"), blocks.alias("two")
    apart = (F.col("one.part") < F.col("two.part")) & (F.col("one.whose").isNull() | ~F.col("one.whose").eqNullSafe(F.col("two.whose")))
    within = (F.col("one.part") == F.col("two.part")) & F.col("one.whose").isNull() & (F.col("one.held") > 1)
    alike = (q * F.col("one.high") >= p * F.col("two.low")) & (q * F.col("two.high") >= p * F.col("one.low"))
    meet = one.join(two, F.col("one.family") == F.col("two.family")).where((apart & alike) | within)
    meet = keep(meet.select(F.col("one.family").alias("family"), F.col("one.part").alias("x"), F.col("two.part").alias("y")), "meet")
    several = meet.where("x <> y")
    if not several.isEmpty():
        # The unions of the blocks that may meet others, as counts in hash slots.
        ends = several.select("family", F.explode(F.array("x", "y")).alias("part")).distinct()
        shown = cut.join(ends, ["family", "part"], "left_semi")
        shown = shown.join(held(bitmap.build(shown, "node")), "node").select("family", "part", "held")
        unions = keep(shown.groupBy("family", "part").applyInArrow(_union(sets), "family long, part long, counts binary"), "unions")
        least = blocks.select("family", "part", F.col("low").alias("least"))
        known = unions.join(least, ["family", "part"])
        one, two = (known.select("family", F.col("part").alias(c), F.col("counts").alias(f"of_{c}"), F.col("least").alias(f"least_{c}")) for c in ("x", "y"))
        both = several.join(one, ["family", "x"]).join(two, ["family", "y"]).select("family", "x", "y", "of_x", "of_y", (F.col("least_x") + F.col("least_y")).alias("least"))
        meet = keep(meet.where("x = y").unionByName(both.mapInArrow(_may_meet(similarity), "family long, x long, y long")), "meet")
    sides = meet.select("family", F.col("x").alias("part"), "x", "y", F.lit(0).alias("second")).unionByName(
        meet.where("x <> y").select("family", F.col("y").alias("part"), "x", "y", F.lit(1).alias("second"))
    )
    sent = cut.join(sides.select("family", "part").distinct(), ["family", "part"], "left_semi")
    spread = sent.join(held(bitmap.build(sent, "node")), "node").join(sides, ["family", "part"])
    spread = spread.select("family", "x", "y", "node", "component", "held", "second")
    return spread.groupBy("family", "x", "y").applyInArrow(_block(similarity, sets), "a long, b long")


def ngram_join(df: DataFrame, size: int = 5, similarity: tuple[int, int] = (4, 5), doc_id: str = "doc_id", text: str = "text", by_parts: bool = False) -> DataFrame:
    """Components of documents linked by the Jaccard similarity of their n-gram sets.

    A text's words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became lower case; its set holds the
    distinct sequences of ``size`` words, or its whole sequence if that is shorter. Two
    documents link when intersection / union >= similarity (a fraction), compared in integers.

    Returns a row per row of ``df``: ``doc_id``, ``n_shingles`` (long, size of the set) and
    ``component_id`` (smallest doc_id reachable by links, itself included). A null or empty text,
    or one without words, has size 0 and is linked with nothing. Rows of the same doc_id are
    one node with the links of all its texts. A row without doc_id links nothing, and gets the
    component of an equal set if there is one, else null. Other columns are not read.
    ``by_parts`` finds candidates by equal parts instead of rare n-grams; links are the same. Short
    n-grams that unlike documents share favour it, a lower similarity does not.
    N-grams are told apart by 64-bit, whole sets by 128-bit hashes.
    """
    spark = df.sparkSession
    source = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    sign = Parts(*similarity).signatures if by_parts else partial(prefixes, similarity=similarity, frequency=levels(source, size))
    signed, path = stage(source.mapInArrow(_signed(size, sign), "doc_id long, n_shingles long, k1 long, k2 long, bits binary, signatures array<long>"), "signed")
    filled = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")

    # One document stands for all with its set.
    sets = filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.min_by("signatures", "doc_id").alias("signatures"))
    rows, rows_path = stage(sets.select("node", F.explode("signatures").alias("s")), "signatures")
    result, _ = stage(signed.drop("signatures"), "sizes")
    drop(spark, path)
    filled = result.where("n_shingles > 0 AND doc_id IS NOT NULL")
    sizes = filled.select(F.col("doc_id").alias("node"), F.col("n_shingles").alias("n"), "bits")
    named = source.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), F.col("text").alias("held"))
    links = similar(rows, sizes, lambda bits: named.mapInArrow(_held(bits), "node long, held string"), lambda column: _sets(w.texts(column), size), similarity)
    drop(spark, rows_path)
    result = result.join(filled.groupBy("k1", "k2").agg(F.min("doc_id").alias("same")), ["k1", "k2"], "left")
    repeated = result.where("n_shingles > 0").groupBy("doc_id").agg(F.min("same").alias("a"), F.max("same").alias("z")).where("a < z")
    repeated = result.where("n_shingles > 0").join(repeated, "doc_id").select("a", F.col("same").alias("b"))
    found = components(links.unionByName(repeated), "a", "b")
    near = result.join(found.select(F.col("node").alias("same"), "component"), "same", "left")
    near = near.select("doc_id", "n_shingles", F.coalesce("component", "same", "doc_id").alias("component_id"))
    return near.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
