"""Toxicity by weak supervision: many voters, a generative label model, a linear classifier.

Voters are words (lexicon) and beginnings of words (patterns), each from some share of a
text's words on, that a bounded sample of labelled texts shows in toxic ones. A label model then estimates from the votes on all
texts, without labels, how often each voter speaks on toxic and on other texts, and how voters
go together. Its posteriors, not the labels, train a logistic regression, whose scores are
the result. Label, language, source and id of a text are no inputs of its score.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from hitmill.llm import words as w
from hitmill.llm.scratch import drop, stage

# Labelled rows that the voters are taken from and the classifier is fitted on, at most.
SAMPLE_ROWS = 20_000
# Voters, and marks that the classifier weighs, at most.
VOTERS = 128
FEATURES = 2048
# A voter's share of toxic texts in the sample, smoothed, at least.
PRECISION = 0.75
VOICES = 6
# The classifier is not asked to be surer than this.
SOFT = 0.02
# Marks that a task of the sample sums up at a time.
FLUSH = 300_000
ROUNDS = 8
THRESHOLD = 0.3
# Bytes of a word's beginning that make a pattern.
BEGINNINGS = (4, 5, 6, 7, 8)
# Shares of a text's words from which a feature counts as a mark: any, and often.
SHARES = (0.0, 0.006, 0.015)

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def features(block: w.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words and beginnings of words of a slice, the text of each, and the
    number of words of each text."""
    lowered = block.lowered()
    starts, ends = w.spans(_LETTER[lowered.data], lowered.offsets)
    of = np.searchsorted(lowered.offsets, starts, "right") - 1
    values, owners = [w.hash_spans(lowered.data, starts, ends)], [of]
    for i, size in enumerate(BEGINNINGS):
        longer = ends - starts > size
        at = starts[longer]
        values.append(w.hash_spans(lowered.data, at, at + size) ^ np.uint64(0x9E3779B97F4A7C15 * (i + 1) & (1 << 64) - 1))
        owners.append(of[longer])
    # The two lowest bits are for marks.
    return np.concatenate(values) & ~np.uint64(3), np.concatenate(owners), np.bincount(of, minlength=len(block))


def _marks(block: w.Texts, bases: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct marks of each text, and where each text's begin.

    A mark is a feature (one of ``bases``, if given) that makes up a share of the text's words.
    """
    values, of, n_words = features(block)
    if bases is not None:
        slots = np.zeros(1 << 16, bool)
        slots[bases >> np.uint64(48)] = True
        near = np.flatnonzero(slots[values >> np.uint64(48)])
        near = near[np.isin(values[near], bases)]
        values, of = values[near], of[near]
    order = np.lexsort((values, of))
    values, of = values[order], of[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (of[1:] != of[:-1])
    at = np.flatnonzero(new)
    share = np.diff(np.append(at, len(values))) / n_words[of[at]]
    values, of = values[at], of[at]
    marks = [(mark(values[share >= least], i), of[share >= least]) for i, least in enumerate(SHARES)]
    return w.distinct(np.concatenate([m for m, _ in marks]), np.concatenate([o for _, o in marks]), len(block))


def mark(values: np.ndarray, level: int) -> np.ndarray:
    """The mark of a feature at one of SHARES; reversible, so that the feature can be told."""
    return values ^ np.uint64(level)


def _matches(block: w.Texts, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of known marks of each text, and where each text's begin."""
    values, first = _marks(block, np.unique(known & ~np.uint64(3)))
    of = np.repeat(np.arange(len(block)), np.diff(first))
    at = np.searchsorted(known, values)
    at[at == len(known)] = 0
    hit = known[at] == values
    return w.distinct(at[hit].astype(np.uint64), of[hit], len(block))


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts by mark and label, summed within the task."""
    found: list[np.ndarray] = []
    labels: list[np.ndarray] = []
    for rows, block in w.slices(batches, "text"):
        toxic = np.asarray(rows.column("toxic")).astype(bool)
        values, first = _marks(block, None)
        found.append(values)
        labels.append(np.repeat(toxic, np.diff(first)))
        if sum(map(len, found)) > FLUSH:
            yield _summed(found, labels)
            found, labels = [], []
    if found:
        yield _summed(found, labels)


def _summed(found: list[np.ndarray], labels: list[np.ndarray]) -> pa.RecordBatch:
    values, which = np.unique(np.concatenate(found), return_inverse=True)
    toxic = np.bincount(which, weights=np.concatenate(labels), minlength=len(values)).astype(np.int64)
    every = np.bincount(which, minlength=len(values))
    return pa.RecordBatch.from_arrays([pa.array(values.view(np.int64)), pa.array(toxic), pa.array(every - toxic)], names=["f", "toxic", "clean"])


def _marked(known: np.ndarray, names: list[str]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, block in w.slices(batches, "text"):
            values, first = _matches(block, known)
            lists = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(values.astype(np.int32)))
            keep = [rows.column(i) for i, n in enumerate(rows.schema.names) if n != "text"]
            yield pa.RecordBatch.from_arrays([*keep, lists], names=names)

    return run


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def choose_voters(rows: np.ndarray, columns: np.ndarray, toxic: np.ndarray, sure: np.ndarray) -> np.ndarray:
    """Marks that together let every toxic text of the sample hear VOICES voters, if they can.

    Each next one is the mark that most texts with too few voters have (ties: smallest number).
    """
    use = toxic[rows] & sure[columns]
    rows, columns = rows[use], columns[use]
    order = np.argsort(columns, kind="stable")
    rows, bounds = rows[order], np.searchsorted(columns[order], np.arange(len(sure) + 1))
    heard, left, chosen = np.zeros(len(toxic), np.int64), set(np.flatnonzero(sure).tolist()), []
    while left and len(chosen) < VOTERS:
        wanting = heard < VOICES
        gain = np.add.reduceat(np.append(wanting[rows], 0), np.minimum(bounds[:-1], len(rows)), dtype=np.int64) * (np.diff(bounds) > 0)
        best = max(left, key=lambda j: (gain[j], -j))
        if not gain[best]:
            break
        left.discard(best)
        chosen.append(best)
        heard[rows[bounds[best] : bounds[best + 1]]] += 1
    return np.array(chosen, np.int64)


def label_model(patterns: DataFrame, on: np.ndarray, off: np.ndarray, toxic_rows: int, clean_rows: int, quiet: float) -> tuple[np.ndarray, float]:
    """Log odds that each voter adds when it speaks (silent ones abstain and add none), and the
    toxic share of all texts.

    ``patterns``: ``votes`` (distinct numbers of the voters that speak) and ``n`` (texts).
    ``quiet``: toxic share of the texts without votes. Expectation maximisation starts at the
    shares ``on`` (of toxic texts) and ``off`` (of others) for which each voter speaks; the
    sampled rows these come from keep counting as rows of known class, so that the voters of a
    smaller language do not drift to the other class. Voters that speak together on toxic texts,
    beyond their shares, share their weight: each is divided by the sum of its squared
    correlations. Every round is one aggregation to as many numbers as there are voters.
    """
    k = len(on)
    total = patterns.agg(F.sum("n")).first()[0] or 0
    if not k or not total:
        return np.zeros(k), 0.5
    share, on_0, off_0 = np.ones(k), on, off
    rows = toxic_rows + clean_rows
    prior = (toxic_rows + 1) / (rows + 2)

    def posterior() -> Column:
        weights = F.array(*map(F.lit, (np.log(on / off) * share).tolist()))
        base = F.lit(float(np.log(prior / (1 - prior))))
        odds = F.aggregate("votes", base, lambda a, j: a + F.get(weights, j))
        return F.when(F.size("votes") == 0, F.lit(quiet)).otherwise(1 / (1 + F.exp(-F.least(F.lit(30.0), odds))))

    for step in range(ROUNDS):
        seen = patterns.withColumn("p", posterior() * F.col("n"))
        sums = seen.select(F.explode(F.concat("votes", F.array(F.lit(-1)))).alias("j"), "n", "p").groupBy("j").agg(F.sum("n"), F.sum("p")).collect()
        spoken, toxic = np.zeros(k + 1), np.zeros(k + 1)
        for j, n, p in sums:
            spoken[j], toxic[j] = n, p
        mass = toxic[-1]
        prior = float(np.clip((mass + toxic_rows) / (total + rows), 1e-4, 0.5))
        on = np.clip((toxic[:k] + on_0 * toxic_rows) / (mass + toxic_rows), 1e-4, 1 - 1e-4)
        off = np.clip((spoken[:k] - toxic[:k] + off_0 * clean_rows) / (total - mass + clean_rows), 1e-6, 1 - 1e-4)
        # A voter never speaks for a text being clean.
        off = np.minimum(off, on)
        if step == 0:
            share = 1 / np.maximum(_together(seen, k, on, mass), 1)
    return np.log(on / off) * share, prior


def _together(seen: DataFrame, k: int, on: np.ndarray, mass: float) -> np.ndarray:
    """Of each voter, the sum of its squared positive correlations with all voters on toxic texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, k))
        for batch in batches:
            for votes, p in zip(batch.column("votes"), np.asarray(batch.column("p"))):
                v = np.asarray(votes.values)
                sums[np.ix_(v, v)] += p
        i, j = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(sums[i, j])], names=["i", "j", "p"])

    pairs = seen.where(F.size("votes") > 0).select("votes", "p").mapInArrow(run, "i int, j int, p double")
    both = np.zeros((k, k))
    for i, j, p in pairs.groupBy("i", "j").agg(F.sum("p")).collect():
        both[i, j] = p
    spread = np.sqrt(on * (1 - on))
    correlation = (both / max(mass, 1) - np.outer(on, on)) / np.outer(spread, spread)
    np.fill_diagonal(correlation, 1)
    return (np.clip(correlation, 0, 1) ** 2).sum(axis=1)


def fit_linear(rows: np.ndarray, columns: np.ndarray, target: np.ndarray, k: int, rounds: int = 200, penalty: float = 1e-3) -> tuple[np.ndarray, float]:
    """Logistic regression of probabilities on sets of features, by scaled gradient steps.

    The penalty is the same for all, so marks that many texts share carry the weight.
    """
    n = len(target)
    weights, moved = np.zeros(k + 1), np.zeros(k + 1)
    weights[k] = np.log((target.sum() + 0.5) / (n - target.sum() + 0.5)) if n else -5.0
    scale = np.sqrt(np.append(np.bincount(columns, minlength=k), n) / max(n, 1)) + 0.02
    for _ in range(rounds if n else 0):
        ahead = weights + 0.9 * moved
        miss = _sigmoid(np.bincount(rows, weights=ahead[columns], minlength=n) + ahead[k]) - target
        slope = np.append(np.bincount(columns, weights=miss[rows], minlength=k), miss.sum()) / n
        slope[:k] += penalty * ahead[:k]
        moved = 0.9 * moved - 2.0 * slope / scale
        weights += moved
    return weights[:k], float(weights[k])


def toxicity(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", keep: tuple[str, ...] = (), sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Toxicity scores of all texts.

    ``labels`` are the rows that may teach (doc_id and a 0/1 label); at most ``sample_rows``
    of them, those with the smallest hashes of their ids, are used. From the marks of these texts
    the model takes FEATURES (those that tell the labels apart best), and VOTERS of them vote. Conflicting labels of an id
    count as toxic; rows with a null id or label teach nothing; without toxic ones all scores
    are 0. Returns a row per row of ``df``: ``doc_id``, the columns ``keep``, and ``score``
    (0 to 1). A null or empty text scores as one without any feature; null doc_ids and repeated
    rows stay.
    """
    taught = labels.select(labels[doc_id].alias("id"), labels[label].alias("toxic")).where("id IS NOT NULL AND toxic IS NOT NULL").groupBy("id").agg(F.max("toxic").cast("int").alias("toxic"))
    taught, taught_path = stage(taught.orderBy(F.xxhash64("id"), "id").limit(sample_rows), "taught")
    source = df.select(df[doc_id].alias("doc_id"), *(df[c].alias(f"k{i}") for i, c in enumerate(keep)), F.coalesce(df[text], F.lit("")).alias("text"))
    # At most sample_rows ids of 16 bytes.
    sample, sample_path = stage(source.join(F.broadcast(taught), F.col("doc_id") == F.col("id")).select("doc_id", "toxic", "text"), "sample")

    n_toxic, n_clean = (x or 0 for x in sample.agg(F.sum("toxic"), F.sum(1 - F.col("toxic"))).first())
    counted = sample.mapInArrow(_counts, "f long, toxic long, clean long").groupBy("f").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    often = counted.where(F.col("toxic") >= max(2, int(0.005 * n_toxic)))
    told = F.abs(F.ln((F.col("toxic") + 0.5) / (n_toxic + 1) / ((F.col("clean") + 0.5) / (n_clean + 1))))
    best = often.orderBy(F.desc(told * F.sqrt(F.col("toxic") + F.col("clean"))), "f").limit(FEATURES).collect()
    if not best:
        drop(df.sparkSession, taught_path, sample_path)
        return source.select("doc_id", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), F.lit(0.0).alias("score"))
    f = np.array([r.f for r in best], np.int64).view(np.uint64)
    order = np.argsort(f)
    f, toxic, clean = f[order], np.array([r.toxic for r in best], float)[order], np.array([r.clean for r in best], float)[order]
    rate, other = (toxic + 0.5) / (n_toxic + 1), (clean + 0.5) / (n_clean + 1)
    rows, columns, labelled = [], [], []
    own = sample.select("toxic", "text").mapInArrow(_marked(f, ["toxic", "marks"]), "toxic int, marks array<int>")
    for i, (label_of, marks) in enumerate(own.collect()):
        rows += [i] * len(marks)
        columns += marks
        labelled.append(label_of)
    rows, columns = np.array(rows, np.int64), np.array(columns, np.int64)
    voters = choose_voters(rows, columns, np.array(labelled) == 1, (toxic + 0.5) / (toxic + clean + 1) >= PRECISION)

    # One reading of all texts: the features each has, and from them the votes.
    names = ["doc_id", *(f"k{i}" for i in range(len(keep))), "marks"]
    schema = t.StructType([source.schema[n] for n in names[:-1]] + [t.StructField("marks", t.ArrayType(t.IntegerType()))])
    marked, _ = stage(source.mapInArrow(_marked(f, names), schema), "marked")
    place = np.full(len(f), -1)
    place[voters] = np.arange(len(voters))
    numbers = F.array(*map(F.lit, place.tolist()))
    votes = F.array_sort(F.filter(F.transform("marks", lambda m: F.get(numbers, m)), lambda v: v >= 0))
    patterns, patterns_path = stage(marked.groupBy(votes.alias("votes")).agg(F.count("*").alias("n")), "votes")
    labelled = np.array(labelled)
    spoken = np.bincount(rows[np.isin(columns, voters)], minlength=len(labelled)) > 0
    quiet = float((labelled[~spoken].sum() + 0.5) / ((~spoken).sum() + 1))
    gain, prior = label_model(patterns, rate[voters], np.minimum(other[voters], rate[voters]), int(n_toxic), int(n_clean), quiet)
    gains = np.zeros(len(f))
    gains[voters] = gain
    odds = np.log(prior / (1 - prior)) + np.bincount(rows, weights=gains[columns], minlength=len(labelled))
    target = np.clip(np.where(spoken, _sigmoid(odds), quiet), SOFT, 1 - SOFT)
    weights, bias = fit_linear(rows, columns, target, len(f))
    drop(df.sparkSession, taught_path, sample_path, patterns_path)
    table = F.array(*map(F.lit, weights.tolist()))
    logit = F.aggregate("marks", F.lit(bias), lambda a, m: a + F.get(table, m))
    return marked.select("doc_id", *(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), (1 / (1 + F.exp(-logit))).alias("score"))


def held_out(doc_id: Column) -> Column:
    """The fold that never teaches: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))
