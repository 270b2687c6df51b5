"""Near copies by SimHash fingerprints, found with unequal radii for groups of bits.

Bits that go together are put in the same group. A fingerprint looks for others within a
radius of its own in each group; the radii differ from fingerprint to fingerprint, and a group may be
left out. If (radius + 1) adds up to the wanted distance + 1 over the groups, no partner is lost:
else each group would differ in more bits than its radius, and all of them in more than the
distance. Of all such radii, dynamic programming picks those with the fewest expected
candidates. Candidates are joined by group and value, and compared in all bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.llm import words as w
from hitmill.llm.components import components
from hitmill.llm.scratch import stage

BITS = 64
SEED = 42
# Fingerprints and probes that meet in one value of a group of bits and are compared in pairs; where more
# meet, links are found by values at one bit's distance, of which no more than BITS + 1 are alike.
CROWD = 128
# Bits of a histogram for the estimates: 2048 counts.
_PART_BITS = 11
_CHUNK = 1 << 16


def fingerprints(block: w.Texts, size: int) -> np.ndarray:
    """The fingerprint of every text: bits that more than half of its shingles' XXH64 have."""
    import xxhash

    lowered = block.lowered()
    found = w.words(lowered)
    length = found.ends - found.starts
    # All words with one space in between, so that a shingle is one stretch of bytes.
    begins = np.concatenate([[0], np.cumsum(length + 1)])
    joined = np.full(begins[-1], 32, np.uint8)
    at = np.arange(int(length.sum())) + np.repeat(np.arange(len(length)), length)
    joined[at] = lowered.data[at - np.repeat(begins[:-1] - found.starts, length)]
    raw = joined.tobytes()
    n = np.maximum(found.counts - size + 1, np.minimum(found.counts, 1))
    of = np.repeat(np.arange(len(n)), n)
    first = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + found.first[:-1][of]
    last = np.minimum(first + size, found.first[1:][of]) - 1
    set_bits = np.zeros((len(n), BITS), np.int64)
    digest = xxhash.xxh64_intdigest
    for a in range(0, len(of), _CHUNK):
        part = slice(a, a + _CHUNK)
        spans = zip(begins[first[part]].tolist(), (begins[last[part]] + length[last[part]]).tolist())
        hashes = np.array([digest(raw[x:y], SEED) for x, y in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        text, edge = np.unique(of[part], return_index=True)
        set_bits[text] += np.add.reduceat(bits, edge, axis=0, dtype=np.int64)
    return np.packbits(2 * set_bits > n[:, None], axis=1, bitorder="little").view("<u8").reshape(-1).astype(np.uint64)


def _signed(size: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in w.slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints(block, size).view(np.int64))], names=["doc_id", "fp"])

    return run


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(fps, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The chosen bits of each fingerprint as one number."""
    out = np.zeros(len(fps), np.int64)
    for place, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)).astype(np.int64) << place
    return out


def _fps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for a in range(0, batch.num_rows, _CHUNK):
            rows = batch.slice(a, _CHUNK)
            yield rows, np.asarray(rows.column("fp")).view(np.uint64)


def group_bits(nodes: DataFrame, groups: int) -> list[list[int]]:
    """All bits in ``groups`` groups of like size, correlated ones together (BITS**2 counts reach the driver)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        together = np.zeros((BITS, BITS), np.int64)
        for _, fps in _fps(batches):
            both = _bits(fps).astype(np.float32)
            together += (both.T @ both).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BITS * BITS, dtype=np.int32)), pa.array(together.reshape(-1))], names=["place", "n"])

    counts = nodes.select("fp").mapInArrow(run, "place int, n long").groupBy("place").agg(F.sum("n").alias("n")).toArrow()
    together = np.zeros(BITS * BITS)
    together[np.asarray(counts.column("place"))] = np.asarray(counts.column("n"))
    together = together.reshape(BITS, BITS) / max(nodes.count(), 1)
    share = np.diag(together)
    spread = np.sqrt(np.maximum(share * (1 - share), 1e-12))
    alike = np.abs(together - np.outer(share, share)) / np.outer(spread, spread)
    free, out = list(range(BITS)), []
    for left in range(groups, 0, -1):
        size = -(-len(free) // left)
        chosen = [max(free, key=lambda b: (alike[b, free].sum(), -b))]
        while len(chosen) < size:
            chosen.append(max((b for b in free if b not in chosen), key=lambda b: (alike[b, chosen].sum(), -b)))
        out.append(sorted(chosen))
        free = [b for b in free if b not in chosen]
    return out


def _parts(group: list[int]) -> list[list[int]]:
    n = -(-len(group) // _PART_BITS)
    return [group[i::n] for i in range(n)]


def near_counts(nodes: DataFrame, groups: list[list[int]], distance: int) -> list[list[np.ndarray]]:
    """For each small part of each group: how many fingerprints are 0, 1 ... bits away from each value
    (a histogram of 2**_PART_BITS counts per part reaches the driver)."""
    parts = [part for group in groups for part in _parts(group)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << len(part), np.int64) for part in parts]
        for _, fps in _fps(batches):
            for count, part in zip(counts, parts):
                count += np.bincount(_values(fps, part), minlength=len(count))
        for i, count in enumerate(counts):
            at = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), i, np.int32)), pa.array(at.astype(np.int32)), pa.array(count[at])], names=["part", "value", "n"])

    found = nodes.select("fp").mapInArrow(run, "part int, value int, n long").groupBy("part", "value").agg(F.sum("n").alias("n")).toArrow()
    which, value, n = (np.asarray(found.column(c)) for c in ("part", "value", "n"))
    out = []
    for i, part in enumerate(parts):
        exact = np.zeros(1 << len(part))
        exact[value[which == i]] = n[which == i]
        every = np.arange(len(exact))
        out.append([sum((exact[every ^ mask] for mask in _masks(len(part), r)), np.zeros(len(exact))) for r in range(distance + 1)])
    edges = np.cumsum([0] + [len(_parts(group)) for group in groups])
    return [out[a:b] for a, b in zip(edges, edges[1:])]


def _masks(width: int, r: int) -> list[int]:
    """All numbers with ``r`` of ``width`` bits."""
    return [sum(1 << b for b in bits) for bits in itertools.combinations(range(width), r)]


def expected(fps: np.ndarray, group: list[int], near: list, total: int, distance: int) -> np.ndarray:
    """Candidates and probes expected of each fingerprint for a group, by radius from -1 (left out) on.

    Within a group, the counts of its parts are multiplied as if the parts were independent.
    """
    away = [np.full(len(fps), float(total))] + [np.zeros(len(fps))] * distance
    for part, counts in zip(_parts(group), near):
        value = _values(fps, part)
        shares = [count[value] / max(total, 1) for count in counts]
        away = [sum(away[i] * shares[r - i] for i in range(r + 1)) for r in range(distance + 1)]
    probes = np.cumsum([len(_masks(len(group), r)) for r in range(distance + 1)])
    return np.stack([np.zeros(len(fps)), *(np.cumsum(away, axis=0) + probes[:, None])], axis=1)


def allot(costs: list[np.ndarray], distance: int) -> list[np.ndarray]:
    """The radius + 1 of every group that together make distance + 1 at the least cost, by
    dynamic programming over the groups, for all fingerprints at once."""
    n, whole = len(costs[0]), distance + 1
    best = np.full((n, whole + 1), np.inf)
    best[:, 0] = 0
    picks = []
    for cost in costs:
        ways = np.full((n, whole + 1, whole + 1), np.inf)
        for spent in range(whole + 1):
            ways[:, spent, : spent + 1] = best[:, spent::-1][:, : spent + 1] + cost[:, : spent + 1]
        picks.append(ways.argmin(axis=2))
        best = ways.min(axis=2)
    left, out = np.full(n, whole), []
    for pick in reversed(picks):
        out.append(pick[np.arange(n), left])
        left = left - out[-1]
    return out[::-1]


def _slots(groups: list[list[int]], near: list, total: int, distance: int, probing: bool):
    """Rows (slot, fp, node) under which fingerprints are found, or look for others."""
    around = [[np.array(sum((_masks(len(group), i) for i in range(r + 1)), []), np.int64) for r in range(distance + 1)] for group in groups]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, fps in _fps(batches):
            node = np.asarray(rows.column("node"))
            picks = allot([expected(fps, g, c, total, distance) for g, c in zip(groups, near)], distance) if probing else [np.ones(len(fps), np.int64)] * len(groups)
            for number, (group, pick) in enumerate(zip(groups, picks)):
                for r in range(distance + 1):
                    at = np.flatnonzero(pick == r + 1)
                    if not len(at):
                        continue
                    slot = (_values(fps[at], group)[:, None] ^ around[number][r]) * len(groups) + number
                    times = slot.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(slot.reshape(-1)), *(pa.array(np.repeat(c[at], times)) for c in (fps.view(np.int64), node))], names=["slot", "fp", "node"]
                    )

    return run


def links(nodes: DataFrame, distance: int, groups: int | None = None) -> DataFrame:
    """Links between the ``node`` numbers of distinct fingerprints ``fp`` at most ``distance`` bits
    apart, as far as they join components: columns ``a`` and ``b``.

    ``groups``: into how many groups the bits are cut; more groups look up fewer, shorter values, which
    serves up to some ten million fingerprints. At distance 2, rows of a value with more than CROWD
    of them are not compared in pairs: each takes its BITS + 1 values at most one bit away, and
    those with such a value in common, BITS + 1 at most, are linked; this is exact as well.
    """
    total = nodes.count()
    groups = groups or (distance + 1 if total < 1 << 24 else distance)
    cut = group_bits(nodes, groups)
    near = near_counts(nodes, cut, distance)
    rows = "slot long, fp long, node long"
    index, _ = stage(nodes.mapInArrow(_slots(cut, near, total, distance, False), rows), "simhash-index")
    probes, _ = stage(nodes.mapInArrow(_slots(cut, near, total, distance, True), rows), "simhash-probes")
    one, two = probes.alias("one"), index.alias("two")
    if distance == 2:
        both = index.unionByName(probes)
        crowded, _ = stage(both.groupBy("slot").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("slot"), "simhash-crowded")
        one = probes.join(crowded, "slot", "left_anti").alias("one")
    apart = F.bit_count(F.col("one.fp").bitwiseXOR(F.col("two.fp")))
    pairs = one.join(two, "slot").where((F.col("one.node") != F.col("two.node")) & (apart <= distance))
    pairs = pairs.select(F.col("one.node").alias("a"), F.col("two.node").alias("b"))
    if distance != 2:
        return pairs
    crowd = both.join(crowded, "slot", "left_semi").select("fp", "node").distinct()
    values = F.expr(f"transform(sequence(0, {BITS}), i -> IF(i = {BITS}, fp, fp ^ shiftleft(1L, i)))")
    alike = crowd.select("node", F.explode(values).alias("value")).groupBy("value").agg(F.min("node").alias("a"), F.collect_list("node").alias("nodes"))
    return pairs.unionByName(alike.where(F.size("nodes") > 1).select("a", F.explode("nodes").alias("b")).where("a <> b"))


def near_copies(df: DataFrame, size: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of documents linked by fingerprints that differ in at most ``distance`` bits.

    A text's words are ``[^\\x20\\x09-\\x0D]+`` after A-Z became lower case, its shingles all
    sequences of ``size`` words with one space in between, repeats included, or its whole
    sequence if that is shorter. A bit of the fingerprint is 1 if it is set in over half of the
    shingles' XXH64 (UTF-8, seed 42).

    Returns a row per row of ``df``: ``doc_id`` (long), ``fingerprint`` (16 hex digits) and
    ``component_id`` (smallest doc_id reachable by links, itself included). A null or empty text, or
    one without words, has fingerprint zero and is linked like any other. Rows of the same
    doc_id are one node with the links of all its texts. A row without doc_id links nothing; it gets the
    component of an equal fingerprint if there is one, else null. Other columns are not read.
    """
    source = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text"))
    signed, _ = stage(source.mapInArrow(_signed(size), "doc_id long, fp long"), "simhash")
    # One document stands for all with its fingerprint.
    nodes, _ = stage(signed.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("node")), "simhash-nodes")
    result = signed.join(nodes, "fp", "left")
    several = result.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").drop("z")
    several = result.join(several, "doc_id").where("a <> node").select("a", F.col("node").alias("b"))
    found = components(links(nodes, distance).unionByName(several), "a", "b")
    joined = result.join(found.withColumnRenamed("node", "found"), F.col("node") == F.col("found"), "left")
    return joined.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component", "node").alias("component_id"))
