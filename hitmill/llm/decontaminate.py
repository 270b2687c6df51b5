"""Benchmark items in documents, by an inverted index of the items and BM25.

Every document is cut into overlapping passages, such that an item's whole text fits into one,
and each passage is a query to the index. An item's score is the BM25 weight of the
words it shares with the passage, divided by the weight of all its words. As in block-max
WAND, bounds come before scores: a list of essential words per item, without which the
threshold is out of reach, and for each block of items the largest weight of each word. Only
blocks whose bound reaches the threshold are scored. What scores enough is compared with the
item's question and with its answer. Items of a few words have no weights to tell them from
chance; their words are looked up as they stand, beside the index.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from hitmill.llm import words as w
from hitmill.llm.scratch import stage

K1, B = 1.2, 0.75
# Share of an item's BM25 weight that a passage must hold.
SCORE = 0.6
# Share of the three-word sequences of question and answer that must stand in the passage.
OVERLAP = 0.5
# Items of fewer words are not in the index but found as they stand; those of fewer than GRAM words
# stand in any text by chance and count where they are a whole line.
LEAST_WORDS = 5
# Essential words leave at most this share of an item's weight to all other words.
REST = SCORE / 2
BLOCK_ITEMS = 16
# Words of items in one index; more items make several indexes, each asked in turn.
INDEX_WORDS = 2_000_000
GRAM = 3


def _halves(text: str) -> tuple[str, str]:
    """Question and answer: the last sentence answers what stands before it."""
    bare = text.rstrip()
    cut = max(bare.rfind(end, 0, max(len(bare) - 1, 0)) for end in ENDS)
    return (bare[: cut + 1], bare[cut + 1 :]) if cut > 0 else (bare, "")


# What ends a sentence.
ENDS = (". ", "? ", "! ", ".\n", "?\n", "!\n", "\n", "。", "？", "！", "।")

_SIGN = np.ones(256, bool)
_SIGN[[i for i in range(128) if not chr(i).isalnum()]] = False
# Ranges of code points of scripts without spaces: every sign is a word.
ALONE = ((0x0E00, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
# Punctuation and spaces of these scripts, and the general ones beyond ASCII.
APART = ((0x00A0, 0x00A0), (0x00AB, 0x00AB), (0x00BB, 0x00BB), (0x2000, 0x206F), (0x3000, 0x3004), (0x3008, 0x3020), (0x30FB, 0x30FB), (0xFF00, 0xFF0F), (0xFF1A, 0xFF20), (0xFF3B, 0xFF40), (0xFF5B, 0xFF65))


def _within(points: np.ndarray, ranges: tuple[tuple[int, int], ...]) -> np.ndarray:
    return np.logical_or.reduce([(points >= a) & (points <= b) for a, b in ranges])


def _words(block: w.Texts) -> w.Words:
    """Words of ASCII letters, digits and signs beyond ASCII but for punctuation; in scripts
    without spaces every sign is a word."""
    data = block.data
    inside = _SIGN[data]
    begins = np.zeros(len(data) + 1, bool)
    lead = np.flatnonzero(data >= 0xC2)
    if len(lead):
        b = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int32) & 63 for i in range(4)]
        size = 2 + (data[lead] >= 0xE0).astype(np.int64) + (data[lead] >= 0xF0)
        two, three, four = (b[0] & 31) << 6 | b[1], (b[0] & 15) << 12 | b[1] << 6 | b[2], (b[0] & 7) << 18 | b[1] << 12 | b[2] << 6 | b[3]
        points = np.where(size == 2, two, np.where(size == 3, three, four))
        apart, alone = _within(points, APART), _within(points, ALONE)
        for i in range(4):
            at = lead[apart & (size > i)] + i
            inside[at[at < len(data)]] = False
        begins[lead[alone]] = True
        begins[np.minimum(lead[alone] + size[alone], len(data))] = True
    begins = begins[:-1]
    previous = np.concatenate([[False], inside[:-1]]) if len(data) else inside
    edges = block.offsets[:-1][block.offsets[:-1] < block.offsets[1:]]
    begins[edges] = True
    begins |= ~previous
    starts = np.flatnonzero(begins & inside)
    stops = np.append(np.flatnonzero(begins | ~inside), len(data))
    ends = stops[np.searchsorted(stops, starts, "right")]
    return w.Words(starts, ends, np.searchsorted(starts, block.offsets))


def _hashes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    block = w.Texts(raw, np.array([0, len(raw)]))
    return w.word_hashes(block, _words(block))


def _grams(hashes: np.ndarray) -> np.ndarray:
    return np.unique(w.shingles(hashes, np.array([0, len(hashes)]), GRAM, whole=False)[0])


def _parts(text: str, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three-word sequences of the question, and those that hold a word of the answer."""
    asked = len(_hashes(_halves(text)[0]))
    return _grams(hashes[:asked]), _grams(hashes[max(asked - GRAM + 1, 0) :] if asked < len(hashes) else hashes[:0])


@dataclass
class Index:
    """Items of up to ``size`` words: postings by word, weights as shares of each item's own."""

    size: int
    items: list[tuple[object, np.ndarray, np.ndarray]]  # item_id, grams of question and answer
    terms: np.ndarray  # all words of the items, ascending
    blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # per block: terms, items, weights
    essential: np.ndarray  # essential words, ascending
    first: np.ndarray  # where the postings of each essential word begin
    block_of: np.ndarray  # their blocks
    most: np.ndarray  # their largest weights within the block
    rest: np.ndarray  # per block, what words that are not essential can add


def build(rows: list[tuple[object, str]], frequency: dict[int, int], n_items: int, mean: float) -> list[Index]:
    """Indexes of (item_id, text) rows by length class; ``frequency``: items by word hash."""
    classes: dict[int, list] = {}
    for item, text in rows:
        hashes = _hashes(text)
        if len(hashes) >= LEAST_WORDS:
            classes.setdefault(max(32, 1 << (len(hashes) - 1).bit_length()), []).append((item, text, hashes))
    out = []
    for size, members in sorted(classes.items()):
        # Items that share rare words come next to each other, so that their blocks are alike.
        members.sort(key=lambda m: (int(m[2].min()), m[1], repr(m[0])))
        postings, rests, items, heavy = [], [], [], []
        for number, (item, text, hashes) in enumerate(members):
            terms, counts = np.unique(hashes, return_counts=True)
            df = np.array([frequency.get(int(x), 1) for x in terms], float)
            idf = np.log1p((n_items - df + 0.5) / (df + 0.5))
            weight = idf * counts * (K1 + 1) / (counts + K1 * (1 - B + B * len(hashes) / mean))
            weight = weight / weight.sum()
            order = np.lexsort((terms, -weight))
            left = 1 - np.cumsum(weight[order])
            enough = int(np.argmax(left <= REST)) + 1
            heavy.append(np.isin(np.arange(len(terms)), order[:enough]))
            rests.append(max(left[enough - 1], 0.0))
            postings.append((terms, np.full(len(terms), number), weight))
            items.append((item, *_parts(text, hashes)))
        terms, number, weight = (np.concatenate(x) for x in zip(*postings))
        heavy = np.concatenate(heavy)
        blocks = []
        for begin in range(0, len(members), BLOCK_ITEMS):
            own = (number >= begin) & (number < begin + BLOCK_ITEMS)
            order = np.argsort(terms[own], kind="stable")
            blocks.append((terms[own][order], number[own][order], weight[own][order]))
        at = np.lexsort((number[heavy] // BLOCK_ITEMS, terms[heavy]))
        e_terms, e_blocks, e_weights = terms[heavy][at], number[heavy][at] // BLOCK_ITEMS, weight[heavy][at]
        new = np.append(True, (e_terms[1:] != e_terms[:-1]) | (e_blocks[1:] != e_blocks[:-1]))
        most = np.maximum.reduceat(e_weights, np.flatnonzero(new))
        e_terms, e_blocks = e_terms[new], e_blocks[new]
        essential, first = np.unique(e_terms, return_index=True)
        rest = np.maximum.reduceat(np.array(rests), np.arange(0, len(rests), BLOCK_ITEMS))
        out.append(Index(size, items, np.unique(terms), blocks, essential, np.append(first, len(e_terms)), e_blocks, most, rest))
    return out


def _lookup(sorted_values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``wanted`` whose value is known, and its number."""
    slots = np.zeros(1 << 18, bool)
    slots[sorted_values >> np.uint64(46)] = True
    near = np.flatnonzero(slots[wanted >> np.uint64(46)])
    at = np.searchsorted(sorted_values, wanted[near])
    at[at == len(sorted_values)] = 0
    hit = sorted_values[at] == wanted[near]
    return near[hit], at[hit]


def search(index: Index, hashes: np.ndarray, first: np.ndarray, score: float, overlap: float) -> Iterator[tuple[int, int, float, float, float, int]]:
    """Text, item, score, overlaps with question and answer, first word of the passage: the
    best passage of each text and item (ties: the first)."""
    stride = index.size
    counts = np.diff(first)
    passages = -(-counts // stride)
    base = np.concatenate([[0], np.cumsum(passages)])
    position, term = _lookup(index.essential, hashes)
    if not len(position):
        return
    text = np.searchsorted(first, position, "right") - 1
    near = (position - first[text]) // stride
    # A word lies in the passage that begins in its stretch, and in the one before.
    passage = np.concatenate([base[text] + near, (base[text] + near - 1)[near > 0]])
    term = np.concatenate([term, term[near > 0]])
    seen = np.unique(passage * len(index.essential) + term)
    passage, term = np.divmod(seen, len(index.essential))
    size = index.first[term + 1] - index.first[term]
    ends = np.cumsum(size)
    at = np.arange(int(ends[-1])) + np.repeat(index.first[term] - (ends - size), size)
    key = np.repeat(passage, size) * len(index.rest) + index.block_of[at]
    keys, which = np.unique(key, return_inverse=True)
    bound = np.bincount(which, weights=index.most[at]) + index.rest[keys % len(index.rest)]
    best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
    for k in keys[bound >= score - 1e-9].tolist():
        passage, block = divmod(k, len(index.rest))
        text = int(np.searchsorted(base, passage, "right")) - 1
        begin = int(first[text]) + (passage - int(base[text])) * stride
        words = hashes[begin : min(begin + 2 * stride, int(first[text + 1]))]
        terms, numbers, weights = index.blocks[block]
        held = np.isin(terms, words)
        low = block * BLOCK_ITEMS
        scores = np.bincount(numbers[held] - low, weights=weights[held])
        good = np.flatnonzero(scores >= score - 1e-9)
        if not len(good):
            continue
        grams = _grams(words)
        for i in (good + low).tolist():
            _, question, answer = index.items[i]
            asked, told = int(np.isin(question, grams).sum()), int(np.isin(answer, grams).sum())
            if asked < overlap * len(question) or told < overlap * len(answer):
                continue
            found = (float(scores[i - low]), asked / max(len(question), 1), told / max(len(answer), 1), begin - int(first[text]))
            if (text, i) not in best or found[0] > best[text, i][0]:
                best[text, i] = found
    for (text, i), found in sorted(best.items()):
        yield text, i, *found


@dataclass
class Phrases:
    """Items of ``size`` words, fewer than LEAST_WORDS, by the hash of their sequence."""

    size: int
    items: list[tuple[object]]
    hashes: np.ndarray  # ascending
    first: np.ndarray  # where the items of each hash begin


def phrases(rows: list[tuple[object, str]]) -> list[Phrases]:
    """The (item_id, text) rows that are too short for an index, by their number of words."""
    out = []
    for size in range(1, LEAST_WORDS):
        found = [(int(_sequences(hashes, np.array([0, size]), size)[0][0]), repr(item), item) for item, hashes in ((i, _hashes(t)) for i, t in rows) if len(hashes) == size]
        if found:
            found.sort(key=lambda x: x[:2])
            hashes, first = np.unique(np.array([x[0] for x in found], np.uint64), return_index=True)
            out.append(Phrases(size, [(x[2],) for x in found], hashes, np.append(first, len(found))))
    return out


def _sequences(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return w.shingles(hashes, first, size, whole=False)


def find(index: Phrases, block: w.Texts, found: w.Words, hashes: np.ndarray) -> Iterator[tuple[int, int, float, float, float, int]]:
    """Where items stand word by word, in the form of :func:`search`: the first place in each
    text. Items of fewer than GRAM words must be all of a line."""
    values, text, at = _sequences(hashes, found.first, index.size)
    near, which = _lookup(index.hashes, values)
    text, at = text[near], at[near]
    if index.size < GRAM and len(at):
        line = np.searchsorted(np.flatnonzero(block.data == 10), found.starts)
        last, n = at + index.size - 1, len(line)
        whole = line[at] == line[last]
        whole &= (at == found.first[text]) | (line[np.maximum(at - 1, 0)] != line[at])
        whole &= (last + 1 == found.first[text + 1]) | (line[np.minimum(last + 1, n - 1)] != line[last])
        text, at, which = text[whole], at[whole], which[whole]
    seen = set()
    for j, place, k in zip(text.tolist(), at.tolist(), which.tolist()):
        if (j, k) not in seen:
            seen.add((j, k))
            for i in range(int(index.first[k]), int(index.first[k + 1])):
                yield j, i, 1.0, 1.0, 1.0, place - int(found.first[j])


def _asked(indexes: list[Index], short: list[Phrases], names: list[str], schema: pa.Schema, score: float, overlap: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in w.slices(batches, "text"):
            found = _words(block)
            hashes = w.word_hashes(block, found)
            hits = [(index.items[hit[1]][0], hit) for index in indexes for hit in search(index, hashes, found.first, score, overlap)]
            hits += [(index.items[hit[1]][0], hit) for index in short for hit in find(index, block, found, hashes)]
            if hits:
                at = pa.array([hit[0] for _, hit in hits])
                columns = [rows.column(n).take(at) for n in names]
                columns += [pa.array([item for item, _ in hits], schema.field("item_id").type)]
                columns += [pa.array([hit[i] for _, hit in hits], schema.field(i + len(names) - 1).type) for i in range(2, 6)]
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def leaks(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item_id: str = "item_id", item_text: str = "text", score: float = SCORE, overlap: float = OVERLAP) -> DataFrame:
    """Every row of ``df`` and benchmark item whose text stands in the row's text.

    Returns the columns ``keep``, ``item_id``, ``score`` (share of the item's BM25 weight),
    ``question_overlap`` and ``answer_overlap`` (shares of their three-word sequences in the
    passage; 0 without an answer), and ``first_word`` (start of the best passage, in words).
    Kept are pairs with ``score`` or more whose sequences overlap by ``overlap`` or more, those of
    the question as well as those that hold a word of the answer (the last sentence). Words are
    runs of ASCII letters, digits and signs beyond ASCII without punctuation, after A-Z became
    lower case; in scripts without spaces (ALONE) every sign is a word.

    Items of fewer than LEAST_WORDS words are found where their words stand one after another, items of
    one or two words only where they are a whole line; score and overlaps are 1. Null and
    empty texts leak nothing; null ids and repeated rows stay; repeated items are reported one by
    one; items without words stand nowhere; without items there are no rows. The items are read to
    the driver in indexes of INDEX_WORDS words; with several, each is asked and its rows are stored before the
    next is built. Documents are never shuffled.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    items = benchmark.select(benchmark[item_id].alias("item_id"), F.lower(F.coalesce(benchmark[item_text], F.lit(""))).alias("text"))
    items, _ = stage(items.select("item_id", "text").mapInArrow(_sized, f"item_id {items.schema['item_id'].dataType.simpleString()}, text string, n long"), "items")
    n_items, total = items.agg(F.count("*"), F.sum("n")).first()
    names = [f"k{i}" for i in range(len(keep))]
    source = df.select(*(df[c].alias(n) for n, c in zip(names, keep)), F.lower(F.coalesce(df[text], F.lit(""))).alias("text"))
    schema = t.StructType(
        [source.schema[n] for n in names]
        + [t.StructField("item_id", items.schema["item_id"].dataType)]
        + [t.StructField(n, t.DoubleType()) for n in ("score", "question_overlap", "answer_overlap")]
        + [t.StructField("first_word", t.LongType())]
    )
    kinds = to_arrow_schema(schema)
    parts = max(1, -(-(total or 0) // INDEX_WORDS))
    frequency = items.select("text").mapInArrow(_item_words, "h long").groupBy("h").agg(F.count("*").alias("df"))
    out = None
    for part in range(parts):
        rows = [(r.item_id, r.text) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).collect()]
        known = frequency
        if parts > 1:
            own = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part).select("text").mapInArrow(_item_words, "h long").distinct()
            known = frequency.join(own, "h")
        counts = {h & (1 << 64) - 1: n for h, n in known.collect()}
        indexes = build(rows, counts, n_items, (total or 0) / max(n_items, 1))
        found = source.mapInArrow(_asked(indexes, phrases(rows), names, kinds, score, overlap), schema)
        if parts > 1:
            found, _ = stage(found, "leaks")
        out = found if out is None else out.unionByName(found)
    return out.toDF(*keep, *schema.names[len(names) :])


def _sized(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items with their number of words."""
    for rows, block in w.slices(batches, "text"):
        yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(_words(block).counts)], names=["item_id", "text", "n"])


def _item_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct word hashes of every item."""
    for _, block in w.slices(batches, "text"):
        found = _words(block)
        values, _ = w.distinct(w.word_hashes(block, found), found.text_of(), len(block))
        yield pa.RecordBatch.from_arrays([pa.array(values.view(np.int64))], names=["h"])
