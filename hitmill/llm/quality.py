"""Quality rules: simple text counts, and how well public vocabularies fit a text.

Three measures come from tokenizers: characters per token and the entropy of the tokens
(byte-level BPE), and the share of byte-fallback tokens (piece BPE), all without white space
between words. Texts outside the band of their language and script are rejected. Bands come from
counts over all documents. Where documents are few, those of the same script, and at last all
documents, count beside them with a small fixed weight.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as t

from hitmill.llm import bpe
from hitmill.llm import words as w
from hitmill.llm.scratch import stage

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
# A band reaches this many interquartile ranges beyond the quartiles.
REACH = 3.0
# All documents of the script weigh as much as this many in the band of a language, and all
# documents as much in that of a script.
PRIOR_DOCUMENTS = 10
# Weights are counted in steps of one to this many.
_PARTS = 1000
# Texts of fewer tokens than each bound form a size class; entropy depends on size.
SIZE_BOUNDS = (128, 256, 512, 1024, 4096)
MEASURES = ("chars_per_token", "byte_share", "entropy")
# Steps in which the measures are counted.
STEPS = {"chars_per_token": 0.01, "byte_share": 0.002, "entropy": 0.01}

SCRIPTS = ("Latin", "Cyrillic", "Greek", "Arabic", "Hebrew", "Devanagari", "Thai", "Hangul", "Hiragana", "Katakana", "Han")

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@lru_cache(maxsize=1)
def _scripts() -> np.ndarray:
    """Script number of every code point; 0 is none of the listed ones."""
    import regex

    points = np.array([*range(0xD800), *range(0xE000, 0x110000)])
    every = "".join(map(chr, points.tolist()))
    out = np.zeros(0x110000, np.uint8)
    for i, name in enumerate(SCRIPTS):
        for m in regex.finditer(rf"\p{{Script={name}}}+", every):
            out[points[m.start() : m.end()]] = i + 1
    return out


def script(text: bytes) -> str:
    """The script most of a text's code points belong to."""
    points = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    counts = np.bincount(_scripts()[points], minlength=len(SCRIPTS) + 1)[1:]
    return SCRIPTS[int(counts.argmax())] if counts.sum() else "none"


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]


_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _repeats(values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every value: does its text hold it twice or more; did it stand there earlier."""
    order = np.lexsort((np.arange(len(values)), values, of))
    same = np.zeros(len(values), bool)
    same[1:] = (values[order[1:]] == values[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    many = same.copy()
    many[:-1] |= same[1:]
    out_many, out_later = np.zeros_like(many), np.zeros_like(same)
    out_many[order], out_later[order] = many, same
    return out_many, out_later


def base_counts(block: w.Texts) -> dict[str, np.ndarray]:
    """The counts of :func:`quality` for each text of a slice."""
    n = len(block)
    found = w.words(block)
    inside = ~w._SEPARATORS[block.data]
    out = {
        "n_words": found.counts,
        "word_chars": _per_text(inside & ((block.data & 0xC0) != 0x80), block.offsets),
        "n_symbols": _per_text(_SYMBOL[block.data], block.offsets),
    }
    starts, ends = w.spans(block.data != 10, block.offsets)
    sums = np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])
    filled = sums[ends] > sums[starts]
    starts, ends = starts[filled], ends[filled]
    of = np.searchsorted(block.offsets, starts, "right") - 1
    _, later = _repeats(w.hash_spans(block.data, starts, ends), of)
    out["n_dup_lines"] = np.bincount(of[later], minlength=n)
    values, of, at = w.shingles(w.word_hashes(block, found), found.first, 3, whole=False)
    many, _ = _repeats(values, of)
    covered = np.zeros(len(found.starts) + 2, bool)
    for i in range(3):
        covered[at[many] + i] = True
    out["n_repeat_words"] = _per_text(covered[:-2], found.first)
    return out


@lru_cache(maxsize=2)
def _piece_model(path: str):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return model, np.array([model.is_byte(i) for i in range(model.get_piece_size())])


def piece_counts(pieces: list[bytes], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and byte-fallback tokens of each piece by a piece BPE model."""
    model, is_byte = _piece_model(path)
    tokens, fallback = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
    for a in range(0, len(pieces), 20_000):
        found = model.encode([p.decode() for p in pieces[a : a + 20_000]], num_threads=1)
        sizes = np.array([len(x) for x in found])
        flags = is_byte[np.array([i for x in found for i in x], np.int64)]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        sums = np.concatenate([[0], np.cumsum(flags)])
        tokens[a : a + len(found)], fallback[a : a + len(found)] = sizes, sums[ends[1:]] - sums[ends[:-1]]
    return tokens, fallback


def entropies(ids: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Entropy in bits of each text's tokens; 0 without tokens."""
    n = np.diff(first)
    keys = np.repeat(np.arange(len(n), dtype=np.int64), n) << 32 | ids
    values, counts = np.unique(keys, return_counts=True)
    total = np.bincount(values >> 32, weights=counts * np.log2(counts), minlength=len(n))
    size = np.maximum(n, 1)
    return np.maximum(np.log2(size) - total / size, 0.0)


def _measure(ranks_path: str, model_path: str, names: list[str]):
    def look(rows: pa.RecordBatch, block: w.Texts) -> tuple:
        raw, at = block.data.tobytes(), block.offsets.tolist()
        scripts = [script(raw[a:b]) for a, b in zip(at, at[1:])]
        keys = [f"script:{own}" if x is None else f"lang:{x}" for x, own in zip(rows.column("lang").to_pylist(), scripts)]
        return base_counts(block), keys, scripts

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = bpe.Vocabulary.from_ranks(ranks_path)
        for block in bpe.blocks(batches, "text", each=look):
            distinct = block.distinct()
            tokens, fallback = piece_counts(distinct, model_path)
            blank = np.array([x.isspace() for x in (p.decode() for p in distinct)], bool)
            chars = np.array([len(p) for p in (p.decode() for p in distinct)], np.int64)
            block.leave_out(blank)
            coded = block.texts(*block.encode(vocabulary))
            for (rows, ids, first), numbers, counts, (base, keys, scripts) in zip(coded, block.numbers, block.counts, block.seen):
                ends = np.concatenate([[0], np.cumsum(counts)])
                n = np.diff(first)
                share = _per_text(fallback[numbers], ends) / np.maximum(_per_text(tokens[numbers], ends), 1)
                columns = [rows.column("doc_id"), *(pa.array(base[c]) for c in COUNTS), pa.array(keys, pa.string()), pa.array(scripts, pa.string()), pa.array(n)]
                columns += [pa.array(_per_text(chars[numbers], ends) / np.maximum(n, 1)), pa.array(share), pa.array(entropies(ids, first))]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def quality(df: DataFrame, ranks_path: str, model_path: str, doc_id: str = "doc_id", text: str = "text", lang: str | None = "lang") -> DataFrame:
    """Counts, measures and verdict of every text.

    Returns a row per row of ``df``: ``doc_id``, ``n_words``, ``word_chars`` (code points in
    words), ``n_symbols`` (characters of SYMBOLS), ``n_dup_lines`` (lines with a word that
    equal an earlier line), ``n_repeat_words`` (words in windows of three words that the text
    holds twice or more), ``band`` (``lang:...`` or ``script:...``), ``n_tokens``, the three
    measures, ``base_failed`` (fewer than MIN_WORDS words, or over half of them repeated), and
    ``kept`` (not failed, and all measures inside the bands).

    A null text counts as empty: zeros, measures 0, failed. Null doc_ids and repeated rows stay.
    With a null language (or ``lang=None``) the text's script names the band. The measures leave out
    white space that stands apart from words, so blank lines change nothing.

    Edges are exact quartiles of values counted in STEPS, widened by REACH interquartile ranges
    and at least by five steps, over the documents that passed the simple rules: those of the
    text's band and script (the most frequent one of its characters); beside them, with the weight of
    PRIOR_DOCUMENTS documents, those of the script, and beside these in the same way all.
    Entropy, which grows with the text, has bands by size class as well. The rule is the
    same for any number of documents. Ties and order of rows change nothing. Other columns are not read.
    """
    names = ["doc_id", *COUNTS, "band", "script", "n_tokens", *MEASURES]
    schema = t.StructType(
        [t.StructField("doc_id", df.schema[doc_id].dataType)]
        + [t.StructField(c, t.LongType()) for c in COUNTS]
        + [t.StructField(c, t.StringType()) for c in ("band", "script")]
        + [t.StructField("n_tokens", t.LongType())]
        + [t.StructField(c, t.DoubleType()) for c in MEASURES]
    )
    named = F.lit(None).cast("string") if lang is None else df[lang].cast("string")
    source = df.select(df[doc_id].alias("doc_id"), named.alias("lang"), df[text].alias("text"))
    size = sum((F.when(F.col("n_tokens") >= bound, 1).otherwise(0) for bound in SIZE_BOUNDS), F.lit(0))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    measured, _ = stage(source.mapInArrow(_measure(ranks_path, model_path, names), schema).withColumns({"base_failed": failed, "size": size}), "measured")

    # Entropy has bands by size class; to the other measures all sizes are one class.
    steps = F.array(*(F.struct(F.lit(m).alias("m"), (F.col("size") if m == "entropy" else F.lit(0)).alias("class"), (F.round(F.col(m) / STEPS[m]) * STEPS[m]).alias("v")) for m in MEASURES))
    passed = measured.where(~F.col("base_failed")).select("band", "script", F.explode(steps).alias("x"))
    counted, _ = stage(passed.groupBy("band", "script", "x.m", "x.class", "x.v").agg(F.count("*").alias("n")), "measure-counts")
    step = F.create_map(*(F.lit(x) for m in MEASURES for x in (m, STEPS[m])))[F.col("m")]

    def mixed(own: DataFrame, wider: DataFrame, by: list[str], on: list[str]) -> DataFrame:
        """Values with weights: documents of ``own``, and all of ``wider`` as PRIOR_DOCUMENTS more."""
        total = wider.groupBy(*on).agg(F.sum("weight").alias("total"))
        prior = own.select(*by).distinct().join(wider.join(total, on), on)
        prior = prior.select(*by, "v", (F.col("weight") * PRIOR_DOCUMENTS / F.col("total")).alias("weight"))
        return own.select(*by, "v", "weight").unionByName(prior).groupBy(*by, "v").agg(F.sum("weight").alias("weight"))

    kind = ["m", "class"]

    def weighed(keys: list[str]) -> DataFrame:
        return counted.groupBy(*keys, *kind, "v").agg(F.sum("n").cast("double").alias("weight"))

    by_script = mixed(weighed(["script"]), weighed([]), ["script", *kind], kind)
    by_band = mixed(weighed(["band", "script"]), by_script, ["band", "script", *kind], ["script", *kind])
    parts = by_band.withColumn("parts", F.ceil(F.col("weight") * _PARTS).cast("long"))
    quartiles = parts.groupBy("band", "script", *kind).agg(F.expr("percentile(v, array(0.25D, 0.75D), parts)").alias("q"))
    reach = F.greatest(REACH * (F.col("q")[1] - F.col("q")[0]), 5 * step)
    edges = quartiles.select("band", "script", *kind, F.struct((F.col("q")[0] - reach).alias("low"), (F.col("q")[1] + reach).alias("high")).alias("edges"))
    limits = edges.groupBy("band", "script", "class").agg(*(F.max(F.when(F.col("m") == m, F.col("edges"))).alias(f"{m}_band") for m in MEASURES))
    # Languages times scripts times size classes: as many rows as there are kinds of text.
    limits, _ = stage(limits, "bands")
    entropy = limits.select("band", "script", F.col("class").alias("size"), "entropy_band").where("entropy_band IS NOT NULL")
    others = limits.where("class = 0").select("band", "script", "chars_per_token_band", "byte_share_band")
    judged = measured.join(others, ["band", "script"], "left").join(entropy, ["band", "script", "size"], "left")
    # A text that passed the simple rules counts itself, so it has all three bands.
    inside = [F.col(m).between(F.col(f"{m}_band.low"), F.col(f"{m}_band.high")) for m in MEASURES]
    return judged.select(*names, "base_failed", F.coalesce(~F.col("base_failed") & inside[0] & inside[1] & inside[2], F.lit(False)).alias("kept"))
