"""Byte-level BPE by merge replay over a block of the corpus, and the way back.

A block's texts are cut into pieces; each distinct piece is kept once. An inverted
index leads from a pair's rank to the positions where the pair stands in these
pieces. Ranks are taken in ascending order from a heap; a merge changes its positions
and re-ranks only the two neighbours of each. Blocks are independent, so Spark runs
one task per partition without a shuffle, and a lost task is simply run again.
"""

from __future__ import annotations

import base64
import heapq
import itertools
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from hitmill.llm import words as w

# Bytes of text whose distinct pieces are encoded together.
BLOCK_BYTES = 16 << 20

_LETTER, _NUMBER, _SPACE, _OTHER = range(4)
_NONE = np.int32(2**31 - 1)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of every code point in the pattern's sense."""
    import regex

    out = np.full(0x110000, _OTHER, np.uint8)
    points = [*range(0xD800), *range(0xE000, 0x110000)]
    every = "".join(map(chr, points))
    places = np.array(points)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            out[places[m.start() : m.end()]] = kind
    return out


def pieces(block: w.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Where the pieces of the pattern begin (byte offsets), and the first piece of each text.

    The pattern is public_tokenizers.PATTERN: contractions, runs of letters, numbers
    or other signs with one leading space, and white space.
    """
    n = len(block.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(len(block) + 1, np.int64)
    points = np.frombuffer(block.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    wide = 1 + (points > 0x7F).astype(np.int8) + (points > 0x7FF) + (points > 0xFFFF)
    at_byte = np.zeros(len(points) + 1, np.int64)
    np.cumsum(wide, out=at_byte[1:])
    # Runs of one class within one text.
    begins = np.ones(len(points), bool)
    begins[1:] = kind[1:] != kind[:-1]
    edges = np.searchsorted(at_byte, block.offsets[:-1][np.diff(block.offsets) > 0])
    begins[edges] = True
    heads = np.zeros(len(points) + 1, bool)
    heads[edges] = True
    run = np.flatnonzero(begins)
    stop = np.append(run[1:], len(points))
    starts = begins.copy()
    # White space before other signs: its last character stands apart, a space joins them.
    last = stop - 1
    followed = (kind[run] == _SPACE) & (stop < len(points)) & ~heads[stop]
    starts[last[followed]] = True
    joins = followed & (points[last] == 32)
    starts[stop[joins]] = False
    # 's 't 'm 'd 're 've 'll behind a sign of its own.
    quote = (points[run] == 39) & (stop - run == 1) & starts[run] & (stop < len(points)) & ~heads[stop]
    at = stop[quote]
    at = at[kind[at] == _LETTER]
    if len(at):
        one, two = points[at], points[np.minimum(at + 1, len(points) - 1)]
        inside = np.zeros(len(at), bool)
        inside[at + 1 < len(points)] = ~begins[at[at + 1 < len(points)] + 1]
        single = np.isin(one, [ord(c) for c in "stmd"])
        double = inside & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        taken = np.where(single, 1, np.where(double, 2, 0))
        hit = taken > 0
        starts[at[hit]] = False
        rest = at[hit] + taken[hit]
        rest = rest[rest < len(points)]
        starts[rest] = True
    places = at_byte[np.flatnonzero(starts)]
    return places, np.searchsorted(places, block.offsets)


class Vocabulary:
    """Byte strings by id, and the pairs of ids that merge.

    ``splits``: every two ids whose strings together are a string of the vocabulary
    merge, by the rank of that string. Else ``merges`` lists the pairs in their order.
    """

    def __init__(self, strings: dict[bytes, int], merges: list[tuple[int, int, int]] | None = None):
        size = max(strings.values()) + 1
        by_id: list[bytes] = [b""] * size
        for string, i in strings.items():
            by_id[i] = string
        self.lengths = np.array([len(s) for s in by_id], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)])
        self.bytes = np.frombuffer(b"".join(by_id), np.uint8)
        self.base = np.array([strings[bytes([i])] for i in range(256)], np.int32)
        if merges is None:
            merges = [
                (strings[s[:k]], strings[s[k:]], i)
                for s, i in strings.items()
                for k in range(1, len(s))
                if s[:k] in strings and s[k:] in strings
            ]
            ranked = [(a, b, i, i) for a, b, i in merges]
        else:
            ranked = [(a, b, rank, i) for rank, (a, b, i) in enumerate(merges)]
        table = np.array(ranked, np.int64).reshape(-1, 4)
        keys = table[:, 0] << 32 | table[:, 1]
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], table[order, 2].astype(np.int32), np.zeros(int(table[:, 2].max(initial=0)) + 1, np.int32)
        self.made[table[:, 2]] = table[:, 3]
        # Ranks whose result can meet a neighbour in a pair of lower rank: their merges are
        # made one at a time in a piece, the others all at once.
        rank_of = np.full(size, -1, np.int64)
        for _, _, rank, i in ranked:
            rank_of[i] = max(rank_of[i], rank)
        self.careful = np.zeros(len(self.made), bool)
        for side in (0, 1):
            lower = table[:, 2] < rank_of[table[:, side]]
            self.careful[rank_of[table[lower, side]]] = True

    @staticmethod
    @lru_cache(maxsize=4)
    def from_ranks(path: str) -> Vocabulary:
        """A file of base64 strings and ranks."""
        with open(path, "rb") as lines:
            return Vocabulary({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)})

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        wanted = left.astype(np.int64) << 32 | right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.ranks[at], _NONE)

    def replay(self, data: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces data[first[i]:first[i + 1]], and each piece's first id."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(first), np.int64)
        symbol = self.base[data]
        after = np.arange(1, n + 1, dtype=np.int32)
        before = np.arange(-1, n - 1, dtype=np.int32)
        after[first[1:][np.diff(first) > 0] - 1] = -1
        before[first[:-1][np.diff(first) > 0]] = -1
        alive = np.ones(n, bool)
        pair = np.full(n, _NONE, np.int32)
        open_at = np.flatnonzero(after >= 0)
        pair[open_at] = self.rank(symbol[open_at], symbol[open_at + 1])
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def note(at: np.ndarray) -> None:
            ranks = pair[at]
            at, ranks = at[ranks != _NONE], ranks[ranks != _NONE]
            if not len(at):
                return
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            edges = [0, *cuts.tolist(), len(at)]
            for rank, a, b in zip(ranks[edges[:-1]].tolist(), edges, edges[1:]):
                if rank in index:
                    index[rank].append(at[a:b])
                else:
                    index[rank] = [at[a:b]]
                    heapq.heappush(heap, rank)

        note(open_at.astype(np.int32))
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            at = at[(pair[at] == rank) & alive[at]]
            if not len(at):
                continue
            if len(at) > 1:
                at = np.sort(at)
                at = at[np.append(True, at[1:] != at[:-1])]
                if self.careful[rank]:
                    piece = np.searchsorted(first, at, "right")
                    lead = np.append(True, piece[1:] != piece[:-1])
                    if not lead.all():
                        index[rank] = [at[~lead]]
                        heapq.heappush(heap, rank)
                        at = at[lead]
                touching = np.append(False, after[at[:-1]] == at[1:])
                if touching.any():
                    # Of overlapping places the first, third, fifth ... merge.
                    place = np.arange(len(at))
                    run = np.maximum.accumulate(np.where(touching, 0, place))
                    at = at[(place - run) % 2 == 0]
            gone = after[at]
            follow = after[gone]
            symbol[at] = self.made[rank]
            alive[gone] = False
            pair[gone] = _NONE
            after[at] = follow
            has = follow >= 0
            before[follow[has]] = at[has]
            pair[at] = _NONE
            right = at[has]
            left = before[at]
            left = left[left >= 0]
            touched = np.concatenate([left, right])
            if len(touched):
                pair[touched] = self.rank(symbol[touched], symbol[after[touched]])
                note(touched)
        kept = np.flatnonzero(alive)
        return symbol[kept], np.searchsorted(kept, first)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids."""
        return gather(self.bytes, self.starts[ids], self.lengths[ids])


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """values[start:start + length] of every pair, one after another."""
    total = int(lengths.sum())
    if not total:
        return values[:0]
    kind = np.int32 if max(total, len(values)) < 1 << 31 else np.int64
    ends = np.cumsum(lengths)
    places = np.repeat((starts - (ends - lengths)).astype(kind), lengths)
    places += np.arange(total, dtype=kind)
    return values[places]


def split_at(block: w.Texts, strings: tuple[bytes, ...]) -> tuple[w.Texts, np.ndarray]:
    """The texts cut before and behind every one of ``strings`` (the leftmost, then longest, first),
    and where the cut-out strings begin (byte offsets)."""
    raw = block.data.tobytes()
    if not any(s in raw for s in strings):
        return block, np.zeros(0, np.int64)
    found = re.compile(b"|".join(map(re.escape, sorted(strings, key=len, reverse=True))))
    places = [m.span() for a, b in itertools.pairwise(block.offsets.tolist()) for m in found.finditer(raw, a, b)]
    edges = np.array(places, np.int64).reshape(-1, 2)
    return w.Texts(block.data, np.unique(np.concatenate([block.offsets, edges.reshape(-1)]))), edges[:, 0]


class Block:
    """Texts of a block as numbers of distinct pieces; each of the strings ``whole`` is one piece."""

    def __init__(self, whole: tuple[bytes, ...] = ()):
        self.whole = whole
        self.rows: list[pa.RecordBatch] = []
        self.counts: list[np.ndarray] = []
        self.seen: list = []
        self.size = 0
        # Of every slice: its pieces as numbers of its own, and its distinct pieces.
        self._own: list[np.ndarray] = []
        self._hashes: list[np.ndarray] = []
        self._data: list[np.ndarray] = []
        self._lengths: list[np.ndarray] = []
        self._numbered: tuple[list[np.ndarray], np.ndarray, np.ndarray] | None = None

    def add(self, rows: pa.RecordBatch, block: w.Texts) -> None:
        """Cut a slice into pieces and number its distinct ones."""
        self.rows.append(rows)
        self.size += len(block.data)
        parts, cut_out = split_at(block, self.whole) if self.whole else (block, [])
        starts, first = pieces(parts)
        if len(cut_out):
            # Nothing but its first piece is left of a string that is whole.
            part = np.searchsorted(parts.offsets, starts, "right") - 1
            inside = np.isin(parts.offsets[part], cut_out)
            starts = starts[~inside | (starts == parts.offsets[part])]
            first = np.searchsorted(starts, block.offsets)
        ends = np.append(starts[1:], len(block.data))
        self.counts.append(np.diff(first))
        hashes, length = w.hash_spans(block.data, starts, ends), ends - starts
        own, lead = number(hashes)
        if not same_spans(block.data, starts, length, own, lead):
            raise ValueError("two different pieces share a hash")
        self._own.append(own)
        self._hashes.append(hashes[lead])
        self._data.append(gather(block.data, starts[lead], length[lead]))
        self._lengths.append(length[lead])

    def _all(self) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """The numbers of each slice's pieces in the whole block, and the distinct pieces' bytes and bounds."""
        if self._numbered is None:
            hashes, length, data = (np.concatenate(x) for x in (self._hashes, self._lengths, self._data))
            starts = np.cumsum(length) - length
            which, lead = number(hashes)
            if not same_spans(data, starts, length, which, lead):
                raise ValueError("two different pieces share a hash")
            edges = np.cumsum([0] + [len(x) for x in self._hashes])
            numbers = [which[a:b][own] for a, b, own in zip(edges, edges[1:], self._own)]
            first = np.concatenate([[0], np.cumsum(length[lead])])
            self._numbered = numbers, gather(data, starts[lead], length[lead]), first
            self._own, self._hashes, self._data, self._lengths = [], [], [], []
        return self._numbered

    @property
    def numbers(self) -> list[np.ndarray]:
        """The distinct pieces, by number, that every slice's texts are made of."""
        return self._all()[0]

    def leave_out(self, unwanted: np.ndarray) -> None:
        """Take the pieces of these numbers (a mark for each) out of all texts."""
        numbers, _, _ = self._all()
        for i, (own, counts) in enumerate(zip(numbers, self.counts)):
            keep = ~unwanted[own]
            sums = np.concatenate([[0], np.cumsum(keep)])
            ends = np.concatenate([[0], np.cumsum(counts)])
            numbers[i], self.counts[i] = own[keep], np.diff(sums[ends])

    def distinct(self) -> list[bytes]:
        """The distinct pieces by number."""
        _, data, first = self._all()
        raw, at = data.tobytes(), first.tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def encode(self, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the distinct pieces, and each piece's first id."""
        _, data, first = self._all()
        return vocabulary.replay(data, first)

    def texts(self, ids: np.ndarray, first: np.ndarray) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        """The rows of each slice, the ids of their texts, and each text's first id."""
        lengths = np.diff(first)
        for rows, numbers, counts in zip(self.rows, self.numbers, self.counts):
            size = lengths[numbers]
            ends = np.concatenate([[0], np.cumsum(size)])
            yield rows, gather(ids, first[numbers], size), ends[np.concatenate([[0], np.cumsum(counts)])]


def number(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes' numbers in order of their first places, and these places."""
    coded = pa.array(hashes).dictionary_encode()
    which = np.asarray(coded.indices)
    return which, np.flatnonzero(np.diff(np.maximum.accumulate(which), prepend=-1))


def same_spans(data: np.ndarray, starts: np.ndarray, length: np.ndarray, which: np.ndarray, lead: np.ndarray) -> bool:
    """Whether every span data[start:start + length] equals the first one of its number."""
    if not np.array_equal(length, length[lead][which]):
        return False
    # Only spans that are not themselves the first need a look.
    rest = np.ones(len(which), bool)
    rest[lead] = False
    at = np.flatnonzero(rest)
    return np.array_equal(gather(data, starts[at], length[at]), gather(data, starts[lead][which[at]], length[at]))


def blocks(batches: Iterable[pa.RecordBatch], column: str, limit: int = BLOCK_BYTES, each=None, whole: tuple[bytes, ...] = ()) -> Iterator[Block]:
    """The batches' texts in blocks of about ``limit`` bytes; ``each`` looks at every slice."""
    block = Block(whole)
    for rows, texts in w.slices(batches, column):
        if block.size and block.size + len(texts.data) > limit:
            yield block
            block = Block(whole)
        keep = [name for name in rows.schema.names if name != column]
        # A slice holds on to its whole batch; the other columns are copied off it.
        rows = pa.RecordBatch.from_arrays([pa.concat_arrays([rows.column(name)]) for name in keep], schema=pa.schema([rows.schema.field(name) for name in keep]))
        block.add(rows, texts)
        block.seen.append(each(rows, texts) if each else None)
    if block.rows:
        yield block


def encode(df, path: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)):
    """The ids of every text as little-endian unsigned 32-bit numbers.

    Returns the columns ``keep``, ``n_tokens`` (long) and ``ids`` (binary). A null text
    counts as empty and has no ids; rows and repeated rows stay as they are, other columns
    are not read. ``path`` names a file of base64 strings and ranks on every machine.
    Code points assigned after the Unicode version of the ``regex`` module are signs
    without a class.
    """
    from pyspark.sql import types as t

    names = [f"k{i}" for i in range(len(keep))]
    out = t.StructType(
        [t.StructField(n, df.schema[k].dataType) for n, k in zip(names, keep)]
        + [t.StructField("n_tokens", t.LongType()), t.StructField("ids", t.BinaryType())]
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.from_ranks(path)
        for block in blocks(batches, "text"):
            for rows, ids, first in block.texts(*block.encode(vocabulary)):
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns, pa.array(np.diff(first)), binaries(ids.astype("<u4"), first)],
                    names=[*names, "n_tokens", "ids"],
                )

    picked = df.select(*(df[k].alias(n) for n, k in zip(names, keep)), df[text].alias("text"))
    return picked.mapInArrow(run, out).toDF(*keep, "n_tokens", "ids")


def decode(df, path: str, ids: str = "ids", to: str = "decoded"):
    """Replace the column ``ids`` by the bytes of its ids (binary); null stays null."""
    from pyspark.sql import types as t

    others = [c for c in df.columns if c != ids]
    out = t.StructType([df.schema[c] for c in others] + [t.StructField(to, t.BinaryType())])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.from_ranks(path)
        for batch in batches:
            column = batch.column(len(others))
            pieces = [None if x is None else vocabulary.decode(np.frombuffer(x.as_buffer(), "<u4")).tobytes() if len(x.as_buffer()) else b"" for x in column]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(pieces, pa.binary())], names=[*others, to])

    return df.select(*others, ids).mapInArrow(run, out)


def binaries(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """values[first[i]:first[i + 1]] as binary values."""
    places = (first * values.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(places.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())]).cast(pa.binary())
