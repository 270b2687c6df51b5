"""Paragraphs and passages that repeat across documents.

Paragraphs are lines. Their word five-grams are banded by MinHash, with bands tuned for the wanted
recall; paragraphs that collide in a band become families, families are verified by exact
Jaccard, and components of the links are the groups.

A passage may also stand inside longer lines, at any place. Texts are cut, too, at words chosen by
the words around them, so that a passage gives the same pieces wherever it stands, and runs of repeated
pieces are passages. That is cheap and finds long passages; those of hardly more than the
least length have too few whole pieces. The other way, for all of them: of every stretch of as many words
as a passage has at least, the eight words with the least hash are a seed, so equal stretches
have a seed in common wherever they stand. Seeds that other documents hold and that follow one
another as they do in the first of these documents are a passage once they span enough words; where they
span fewer, and at both ends, all stretches around a seed are compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hitmill.llm import bitmap
from hitmill.llm import words as w
from hitmill.llm.components import components
from hitmill.llm.ngram_join import similar, token_lists
from hitmill.llm.scratch import drop, stage

SHINGLE = 5
SIMILARITY = (4, 5)
# Paragraphs and passages of fewer words are not looked at.
LEAST_WORDS = 20
# Chance that a pair of exactly the wanted similarity collides in a band.
RECALL = 0.999
ROWS = 2
# A piece of a text begins at a word that is the least of so many words on either side.
REACH = 4
# Words that may lie between two repeated pieces of one passage.
GAP = 4
# Words of a seed.
SEED_WORDS = 8


def bands(similarity: float, rows: int, recall: float) -> int:
    """The fewest bands of ``rows`` MinHashes in which similar pairs collide with that chance."""
    return int(np.ceil(np.log(1 - recall) / np.log(1 - similarity**rows)))


def _lines(block: w.Texts) -> tuple[w.Texts, np.ndarray, w.Words, np.ndarray]:
    """The lines of a slice in lower case, the text of each, their words, and the number of each
    line's first word within its text."""
    lowered = block.lowered()
    cuts = np.unique(np.concatenate([lowered.offsets, np.flatnonzero(lowered.data == 10) + 1]))
    lines = w.Texts(lowered.data, cuts)
    text = np.searchsorted(lowered.offsets, cuts[:-1], "right") - 1
    found = w.words(lines)
    base = found.first[np.searchsorted(cuts, lowered.offsets[:-1])]
    return lines, text, found, found.first[:-1] - base[text]


def _sets(lines: w.Texts, found: w.Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lines of ``least`` words or more: their numbers, five-grams, where each begins, and a key."""
    values, of, _ = w.shingles(w.word_hashes(lines, found), found.first, SHINGLE, whole=True)
    long = found.counts >= least
    values, first = w.distinct(values[long[of]], of[long[of]], len(lines))
    at = np.flatnonzero(long)
    first = np.append(first[at], len(values))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(w.mix(values), dtype=np.uint64)])
    return at, values, first, w.mix(sums[first[1:]] - sums[first[:-1]])


def _paragraphs(n_bands: int, least: int):
    seeds = w.mix(np.arange(1, 2 * n_bands * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, n_bands, ROWS)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in w.slices(batches, "text"):
            lines, text, found, number = _lines(block)
            at, values, first, key = _sets(lines, found, least)
            if not len(at):
                continue
            out = np.empty((len(at), n_bands), np.uint64)
            for band in range(n_bands):
                mark = np.full(len(at), np.uint64(band + 1))
                for row in range(ROWS):
                    lowest = np.minimum.reduceat(values * (seeds[0, band, row] | np.uint64(1)) + seeds[1, band, row], first[:-1])
                    mark = w.mix(mark * np.uint64(0x9E3779B97F4A7C15) + lowest)
                out[:, band] = mark
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(text[at])),
                    pa.array(number[at]),
                    pa.array(found.counts[at]),
                    pa.array(np.diff(first)),
                    pa.array(key.view(np.int64)),
                    w.long_lists(out.reshape(-1), np.arange(len(at) + 1) * n_bands),
                ],
                names=["doc_id", "first_word", "n_words", "n", "key", "bands"],
            )

    return run


def _tokens(least: int, bits: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in w.slices(batches, "text"):
            lines, _, found, _ = _lines(block)
            _, values, first, key = _sets(lines, found, least)
            lists = w.long_lists(values, first)
            held = pa.array(bitmap.holds(bits, key.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), lists], names=["node", "held"]).filter(held)

    return run


def seeds(hashes: np.ndarray, first: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the seeds of every text, the text of each, and its first word.

    A seed is the least (of equal ones the last) of all SEED_WORDS words in a row in some stretch of
    ``least`` words.
    """
    values, of, at = w.shingles(hashes, first, SEED_WORDS, whole=False)
    width = least - SEED_WORDS + 1
    if len(values) < width:
        return values[:0], of[:0], at[:0]
    chosen = []
    for a in range(0, len(values) - width + 1, 1 << 16):
        part = np.lib.stride_tricks.sliding_window_view(values[a : a + (1 << 16) + width - 1], width)
        lowest = np.arange(a, a + len(part)) + width - 1 - np.argmin(part[:, ::-1], axis=1)
        chosen.append(lowest[of[a : a + len(part)] == of[a + width - 1 : a + width - 1 + len(part)]])
    chosen = np.unique(np.concatenate(chosen))
    return values[chosen], of[chosen], at[chosen]


def _seeds(least: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in w.slices(batches, "text"):
            lowered = block.lowered()
            found = w.words(lowered)
            values, of, at = seeds(w.word_hashes(lowered, found), found.first, least)
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(of)), pa.array(at - found.first[of]), pa.array(values.view(np.int64))], names=["doc_id", "first_word", "key"]
            )

    return run


def _stretches(least: int):
    """All stretches of ``least`` words that hold a seed at one of the row's ``places``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in w.slices(batches, "text"):
            lowered = block.lowered()
            found = w.words(lowered)
            values, of, at = w.shingles(w.word_hashes(lowered, found), found.first, least, whole=False)
            lists = rows.column("places")
            row = np.repeat(np.arange(len(block)), np.asarray(lists.value_lengths()))
            place = np.asarray(lists.flatten()) + found.first[row]
            edges = np.zeros(len(found.starts) + 1, np.int64)
            np.add.at(edges, np.maximum(place - (least - SEED_WORDS), found.first[row]), 1)
            np.add.at(edges, np.minimum(place + 1, found.first[row + 1]), -1)
            asked = np.cumsum(edges)[at] > 0
            values, of, at = values[asked], of[asked], at[asked]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id").take(pa.array(of)), pa.array(at - found.first[of]), pa.array(values.view(np.int64))], names=["doc_id", "first_word", "key"]
            )

    return run


def cuts(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Words at which a piece begins: by the words around it, and at each text's first word."""
    n = len(hashes)
    value = w.mix(hashes + np.concatenate([[np.uint64(0)], w.mix(hashes[:-1] if n else hashes)]))
    least = np.ones(n, bool)
    for d in range(1, REACH + 1):
        least[d:] &= value[d:] < value[:-d]
        least[:-d] &= value[:-d] < value[d:]
    least[first[:-1][np.diff(first) > 0]] = True
    return np.flatnonzero(least)


def _pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, block in w.slices(batches, "text"):
        lowered = block.lowered()
        found = w.words(lowered)
        hashes = w.word_hashes(lowered, found)
        starts = cuts(hashes, found.first)
        ends = np.append(starts[1:], len(hashes))
        text = found.text_of()[starts]
        powers, inverses = w._powers(len(hashes) + 1)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(hashes * powers[: len(hashes)], dtype=np.uint64)])
        key = w.mix((sums[ends] - sums[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
        yield pa.RecordBatch.from_arrays(
            [rows.column("doc_id").take(pa.array(text)), pa.array(starts - found.first[text]), pa.array(ends - starts), pa.array(key.view(np.int64))],
            names=["doc_id", "first_word", "n_words", "key"],
        )


def near_paragraphs(source: DataFrame, least: int, similarity: tuple[int, int], recall: float) -> DataFrame:
    """Paragraphs in groups of similar ones: doc_id, first_word, n_words, component."""
    n_bands = bands(similarity[0] / similarity[1], ROWS, recall)
    units, _ = stage(source.mapInArrow(_paragraphs(n_bands, least), "doc_id long, first_word long, n_words long, n long, key long, bands array<long>"), "paragraphs")
    # A line that many documents hold is banded and compared once.
    distinct = units.groupBy("key").agg(F.first("bands").alias("bands"))
    rows = distinct.select(F.col("key").alias("node"), F.explode("bands").alias("s"))
    held = lambda bits: source.select("text").mapInArrow(_tokens(least, bits), "node long, held array<long>").dropDuplicates(["node"])
    links = similar(rows, units.select(F.col("key").alias("node"), "n"), held, token_lists, similarity)
    groups = components(links, "a", "b")
    placed = units.select("doc_id", "first_word", "n_words", "key").join(groups, F.col("key") == F.col("node"), "left")
    return placed.select("doc_id", "first_word", "n_words", F.coalesce("component", "key").alias("component"))


def _homes(units: DataFrame) -> DataFrame:
    """The keys that two documents hold, with the first place of each."""
    place = F.struct("doc_id", "first_word")
    found = units.groupBy("key").agg(F.min(place).alias("home"), F.max("doc_id").alias("high")).where("home.doc_id < high")
    return found.select("key", F.col("home.doc_id").alias("home_id"), F.col("home.first_word").alias("home_word"))


def all_passages(source: DataFrame, least: int) -> DataFrame:
    """All stretches of ``least`` words or more that other documents hold too: doc_id, first_word,
    n_words, component.

    The first place of a seed or stretch, by doc_id and word, is the copy that is kept. What follows one
    another as in one kept copy is one passage; a component is all passages whose kept
    copies lie in one such stretch of the document that keeps them.
    """
    spark, unit, done = source.sparkSession, "doc_id long, first_word long, key long", []

    def keep(df: DataFrame, label: str) -> DataFrame:
        df, path = stage(df, label)
        done.append(path)
        return df

    found = keep(source.mapInArrow(_seeds(least), unit), "seeds")
    shared = keep(_homes(found), "shared-seeds")
    met = bitmap.keep(found, "key", bitmap.build(shared, "key")).join(shared, "key")
    by_doc = Window.partitionBy("doc_id").orderBy("first_word", "key")
    shift = F.col("home_word") - F.col("first_word")
    turns = (F.col("first_word") - F.lag("first_word").over(by_doc) > least - SEED_WORDS + 1) | (F.col("home_id") != F.lag("home_id").over(by_doc)) | (shift != F.lag(shift).over(by_doc))
    runs = met.withColumn("run", F.sum(F.coalesce(turns, F.lit(True)).cast("int")).over(by_doc))
    whole = Window.partitionBy("doc_id", "run")
    low, high = F.min("first_word").over(whole), F.max("first_word").over(whole)
    long = high - low + SEED_WORDS >= least
    runs = keep(runs.select("doc_id", "first_word", "key", "home_id", "home_word", long.alias("long"), (~long | F.col("first_word").isin(low, high)).alias("asked")), "runs")
    # Whoever holds a seed that needs a closer look shows the stretches around it.
    asked = runs.join(runs.where("asked").select("key").distinct(), "key", "left_semi").groupBy("doc_id").agg(F.collect_set("first_word").alias("places"))
    asked = keep(asked, "asked")
    texts = bitmap.keep(source, "doc_id", bitmap.build(asked, "doc_id")).join(asked, "doc_id").select("doc_id", "text", "places")
    around = keep(texts.mapInArrow(_stretches(least), unit).distinct(), "stretches")
    seeded = runs.where("long").select("doc_id", "first_word", "home_id", "home_word", F.lit(SEED_WORDS).alias("n"))
    units = seeded.distinct().unionByName(around.join(_homes(around), "key").select("doc_id", "first_word", "home_id", "home_word", F.lit(least).alias("n")))

    # What follows one another in the same document as in the home.
    units = units.withColumn("shift", shift).withColumn("end", F.col("first_word") + F.col("n"))
    line = Window.partitionBy("doc_id", "home_id", "shift").orderBy("first_word", "n")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    apart = F.coalesce(F.col("first_word") > before + (least - 2 * SEED_WORDS + 1), F.lit(True))
    units = units.withColumn("begin", F.max(F.when(apart, F.col("first_word"))).over(line))
    units = keep(units, "units")
    own = units.where("doc_id = home_id AND shift = 0").select(F.col("doc_id").alias("own_id"), F.col("first_word").alias("own_word"), F.col("n").alias("own_n"), F.col("begin").alias("own_begin"))
    lead = F.min(F.struct("first_word", "n", "home_word"))
    lines = units.groupBy("doc_id", "home_id", "shift", "begin").agg(F.max("end").alias("end"), lead.alias("lead"))
    placed = lines.join(own, (F.col("home_id") == F.col("own_id")) & (F.col("lead.home_word") == F.col("own_word")) & (F.col("lead.n") == F.col("own_n")))
    result, _ = stage(placed.select("doc_id", F.col("begin").alias("first_word"), (F.col("end") - F.col("begin")).alias("n_words"), F.xxhash64("home_id", "own_begin").alias("component")), "passages")
    drop(spark, *done)
    return result


def passages(source: DataFrame, least: int) -> DataFrame:
    """Runs of pieces that other documents hold too: doc_id, first_word, n_words, component.

    The first place of a piece, by doc_id and word, is the copy that is kept. Runs are cut where
    the kept copy changes: pieces that stand first in a document side by side are one component
    with all that repeats them, so no component has pieces without a copy in its first row.
    """
    pieces, _ = stage(source.mapInArrow(_pieces, "doc_id long, first_word long, n_words long, key long"), "pieces")
    ends = pieces.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    shared, _ = stage(ends.where("low < high").select("key"), "shared-pieces")
    repeated = bitmap.keep(pieces, "key", bitmap.build(shared, "key")).join(shared, "key")
    by_doc = Window.partitionBy("doc_id").orderBy("first_word", "key")
    end = F.col("first_word") + F.col("n_words")
    apart = F.coalesce(F.col("first_word") > F.lag(end).over(by_doc) + GAP, F.lit(True))
    numbered = repeated.withColumn("apart", apart.cast("int")).withColumn("run", F.sum("apart").over(by_doc))
    whole = Window.partitionBy("doc_id", "run")
    spans = numbered.select("doc_id", "key", "first_word", "n_words", F.sum("n_words").over(whole).alias("held"))
    spans, _ = stage(spans.where(F.col("held") >= least).drop("held"), "passages")

    homes = spans.groupBy("key").agg(F.min(F.struct("doc_id", "first_word", "n_words")).alias("home")).select("key", "home.*")
    begin = F.max(F.when(apart, F.col("first_word"))).over(by_doc)
    homes = homes.select("key", F.col("doc_id").alias("home_id"), F.col("first_word").alias("home_word"), F.xxhash64("doc_id", begin).alias("component"))
    own = (F.col("doc_id") == F.col("home_id")) & (F.col("first_word") == F.col("home_word"))
    placed = spans.join(homes, "key").select("doc_id", "key", "first_word", "n_words", "component", own.alias("own"))
    turns = apart | (F.col("component") != F.lag("component").over(by_doc)) | (F.col("own") != F.lag("own").over(by_doc))
    stretches = placed.withColumn("turns", turns.cast("int")).withColumn("stretch", F.when(F.col("own"), 0).otherwise(F.sum("turns").over(by_doc)))
    runs = stretches.groupBy("doc_id", "component", "stretch").agg(F.min("first_word").alias("first_word"), F.max(end).alias("end"))
    return runs.select("doc_id", "first_word", (F.col("end") - F.col("first_word")).alias("n_words"), "component")


def repeats(df: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = LEAST_WORDS, similarity: tuple[int, int] = SIMILARITY, recall: float = RECALL, every: bool = False) -> DataFrame:
    """Paragraphs and passages that two documents or more hold.

    Paragraphs are lines of ``least`` words or more (``[^\\x20\\x09-\\x0D]+`` after A-Z became lower
    case); two are linked at a Jaccard similarity of ``similarity`` of their five-word sequences,
    exactly compared; pairs of that similarity are found with the chance ``recall``, more similar
    ones nearly always, equal ones always.

    A passage is a run of pieces of REACH + 1 to some twenty words, found in other documents word by
    word, of ``least`` words together, cut where the document that keeps the pieces changes;
    each piece of a passage keeps its first copy. Of passages of 20 words none is found in this way, of 30
    four in ten, of 40 nine in ten, of over 50 nearly all. With ``every``, all passages of ``least``
    words are found, and to their true ends (but for gaps of up to ``least`` - 2 * SEED_WORDS + 1 words
    within longer ones), at about twice the cost.

    Returns a row per paragraph and passage of a group that spans two documents: ``doc_id``, ``kind``
    (``paragraph`` or ``passage``), ``first_word`` and ``n_words`` (long; place in the text),
    ``component_id`` (long; the same for all of a group) and ``removed`` (all but the one of the
    smallest doc_id and place). Null and empty texts have none. Rows without doc_id are not
    compared; rows of one doc_id are one document, and its equal places count once. Other
    columns are not read.
    """
    source = df.select(df[doc_id].cast("long").alias("doc_id"), df[text].alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    both = near_paragraphs(source, least, similarity, recall).withColumn("kind", F.lit("paragraph")).unionByName((all_passages if every else passages)(source, least).withColumn("kind", F.lit("passage")))
    both, _ = stage(both.distinct(), "repeats")
    place = F.struct("doc_id", "first_word")
    groups = both.groupBy("kind", "component").agg(F.min(place).alias("kept"), F.max("doc_id").alias("high")).where("kept.doc_id < high")
    found = both.join(groups, ["kind", "component"])
    removed = (F.col("doc_id") != F.col("kept.doc_id")) | (F.col("first_word") != F.col("kept.first_word"))
    return found.select("doc_id", "kind", "first_word", "n_words", F.col("component").alias("component_id"), removed.alias("removed"))
