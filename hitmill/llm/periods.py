"""Stretches of words that repeat with a period, found by synchronising sets of positions.

For tau = 8, 16, 32 ..., hashes of tau words choose positions: one is chosen if, among the
tau + 1 hashes from it on, the least is the first or the last. Equal surroundings choose
alike, and every stretch of tau positions has a chosen one, except where tau words repeat with a
period of tau / 4 or less; those regions are known from smaller periods and left out, which keeps the
sets small. In a run of period tau to 2 tau - 1 and four periods, a chosen position and the one a
period later are followed by the same 2 tau words, and none in between is. So next
positions of equal contexts propose the periods, and each proposal is extended to both ends.
Periods below 8 are read off by comparing words with those shortly behind.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hitmill.llm import words as w

# A run holds its period this many times, and so many words, at least.
REPEATS = 4
LEAST_WORDS = 6
# Periods below are compared directly; the first scale of the chosen positions.
BASE = 8

FIELDS = "doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of values[i:i + width] (fewer at the end), from least values of blocks."""
    n = len(values)
    padded = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    table = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])


def _equal(values: np.ndarray, a: int, b: int, step: int) -> int:
    """For how long values[a], values[a + step] ... equal values[b], values[b + step] ..."""
    done, size = 0, 64
    while True:
        if step > 0:
            size = min(size, len(values) - b - done)
            same = values[a + done : a + done + size] == values[b + done : b + done + size]
        else:
            size = min(size, a + 1 - done)
            same = (values[a + 1 - done - size : a + 1 - done] == values[b + 1 - done - size : b + 1 - done])[::-1]
        if size <= 0:
            return done
        if not same.all():
            return done + int(same.argmin())
        done, size = done + size, size * 2


def find_runs(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The runs of texts values[first[i]:first[i + 1]] (numbers for words): rows of the first and
    the last word (exclusive) in ``values``, and the smallest period, in this order.

    A run holds four periods at least and cannot be made longer on either side.
    """
    counts = np.diff(first)
    # A number of its own ends every text.
    n = len(values) + len(counts)
    ends = first[1:] + np.arange(len(counts))
    text = np.empty(n, np.uint64)
    own = np.ones(n, bool)
    own[ends] = False
    text[own] = values
    text[ends] = w.mix(np.arange(1, len(counts) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    seen: dict[tuple[int, int], int] = {}

    for period in range(1, min(BASE, n)):
        same = np.zeros(n - period + 2, np.int8)
        same[1:-1] = text[:-period] == text[period:]
        change = np.diff(same)
        starts, stops = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
        long = stops - starts >= (REPEATS - 1) * period
        for a, b in zip(starts[long].tolist(), (stops[long] + period).tolist()):
            seen.setdefault((a, b), period)

    # Of texts long enough for a scale: hashes of tau words, and where they stand in ``text``.
    hashes, place, bounds, tau = text, np.arange(n), np.append(0, ends + 1), 1
    while len(hashes):
        if tau >= BASE:
            _at_scale(text, hashes, place, tau, seen)
        doubled = np.empty_like(hashes)
        tail = len(hashes) - tau
        if tail <= 0:
            break
        doubled[:tail] = w.mix(w.mix(hashes[:tail]) + hashes[tau:] * np.uint64(0xD6E8FEB86659FD93))
        doubled[tail:] = w.mix(place[tail:].astype(np.uint64) + np.uint64(tau * 0xA5A5A5A5A5A5A5A5 % (1 << 64)))
        tau *= 2
        # Shorter texts have no run of such a period.
        size = np.diff(bounds)
        stay = size > REPEATS * tau
        keep = np.repeat(stay, size)
        hashes, place = doubled[keep], place[keep]
        bounds = np.concatenate([[0], np.cumsum(size[stay])])
    found = np.array([(a, b, period) for (a, b), period in seen.items()], np.int64).reshape(-1, 3)
    shift = np.searchsorted(ends, found[:, 0])
    found[:, :2] -= shift[:, None]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def _at_scale(text: np.ndarray, hashes: np.ndarray, place: np.ndarray, tau: int, seen: dict[tuple[int, int], int]) -> None:
    """Add the runs of periods from tau to 2 tau - 1; ``hashes`` are of the tau words at ``place``."""
    n = len(hashes)
    known = np.array([(a, b) for (a, b), p in seen.items() if 4 * p <= tau <= b - a], np.int64).reshape(-1, 2)
    begin = np.searchsorted(place, known[:, 0])
    here = place[np.minimum(begin, n - 1)] == known[:, 0]
    begin, size = begin[here], (known[:, 1] - known[:, 0])[here]
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + size - tau + 1, -1)
    left_out = np.cumsum(edges[:n]) > 0
    highest = np.iinfo(np.uint64).max
    ranked = np.where(left_out, highest, hashes)
    least = _least(ranked, tau + 1)
    behind = np.append(ranked[tau:], np.full(min(tau, n), highest, np.uint64))[:n]
    chosen = np.flatnonzero((least != highest) & ((ranked == least) | (behind == least)))
    chosen = chosen[chosen + tau < n]
    # The context of 2 tau words: two hashes of tau.
    context = w.mix(w.mix(hashes[chosen]) + hashes[chosen + tau] * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(context, kind="stable")
    at, context = chosen[order], context[order]
    period = np.diff(at)
    good = (context[1:] == context[:-1]) & (period >= tau) & (period < 2 * tau)
    at, period = place[at[:-1][good]], period[good]
    order = np.lexsort((at, period))
    last, until = 0, -1
    for p, a in zip(period[order].tolist(), at[order].tolist()):
        if p != last:
            last, until = p, -1
        if a < until:
            continue
        until = a + _equal(text, a, a + p, 1)
        begin = a - _equal(text, a - 1, a - 1 + p, -1) if a else a
        if until + p - begin >= REPEATS * p:
            seen.setdefault((begin, until + p), p)


def repeated(doc_id: int | None, n: int) -> np.ndarray | None:
    """For one in ten documents, by crc32 of the doc_id: which word stands at each place once a
    part of the text is repeated to its end; None: the text stays as it is."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    places = np.arange(n)
    return np.where(places < a, places, a + (places - a) % p)


def _scan(repeat: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in w.slices(batches, "text"):
            found = w.words(block)
            values, first, ids = w.word_hashes(block, found), found.first.tolist(), rows.column("doc_id").to_pylist()
            orders = [repeated(i, b - a) if repeat else None for i, a, b in zip(ids, first, first[1:])]
            if any(x is not None for x in orders):
                values = values[np.concatenate([np.arange(b - a) + a if x is None else x + a for x, a, b in zip(orders, first, first[1:])])]
            runs = find_runs(values, found.first)
            runs = runs[runs[:, 1] - runs[:, 0] >= LEAST_WORDS]
            cuts = np.searchsorted(runs[:, 0], found.first).tolist()
            raw, edges = block.data.tobytes(), block.offsets.tolist()
            out = []
            for k, i in enumerate(ids):
                words, n = raw[edges[k] : edges[k + 1]].split(), first[k + 1] - first[k]
                if orders[k] is not None:
                    words = [words[j] for j in orders[k].tolist()]
                mine = [(a - first[k], b - a, p) for a, b, p in runs[cuts[k] : cuts[k + 1]].tolist()]
                best = None
                gone = bytearray(n)
                for run_ in mine:
                    start, length, period = run_
                    gone[start + period : start + length] = b"\1" * (length - period)
                    # length / period as integers; earlier runs win ties.
                    if best is None or length * best[2] > best[1] * period:
                        best = run_
                lines = "".join(f"{a},{b},{p}\n" for a, b, p in mine)
                kept = [x for x, drop in zip(words, gone) if not drop] if mine else words
                shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                out.append((i, n, len(mine), *shown, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(kept)).hexdigest()))
            kinds = [pa.int64()] * 7 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=[f.split()[0] for f in FIELDS.split(", ")])

    return run


def periodic_runs(df: DataFrame, doc_id: str = "doc_id", text: str = "text", repeat: bool = False) -> DataFrame:
    """Runs of every text, and a digest of the text with each run cut to one period.

    A run is a stretch of words ``[^\\x20\\x09-\\x0D]+`` with a smallest period q, of at least
    max(6, 4 q) words, that no word on either side continues. Returns a row per row of ``df``:
    ``doc_id`` (long), ``n_words``, ``n_runs``; ``start`` (from 0), ``length``, ``period`` and
    ``exponent_milli`` (1000 * length / period, cut) of the run with the most periods (ties: the first,
    then the shorter period; null without a run); ``runs_sha256`` of all runs as lines
    ``start,length,period``; ``collapsed_sha256`` of the words that no run holds behind its
    first period, with one space in between.

    A null or empty text has no words and no run. Rows and repeated rows all come back; other columns are not
    read. ``repeat``: first repeat a part of one text in ten, chosen by doc_id (never without one).
    Words are told apart by 64-bit hashes. Texts are independent, so there is no shuffle; a
    task holds one text or SLICE_BYTES of several at a time.
    """
    return df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).mapInArrow(_scan(repeat), FIELDS)
