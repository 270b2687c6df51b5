"""License notices in texts, by an exact set-similarity join with license templates.

A text block is a stretch of words, half as long again as the template, that may cross the ends of
lines but not blank ones. It meets a template when it contains at least the wanted
share of the template's distinct words, and the words that the template may not miss. The words of
all templates are ordered by the number of paragraphs that hold them, rarest first. With
an overlap of c words needed, one of a template's first |T| - c + 1 words is in every block that
meets it; blocks are opened around these words only, in paragraphs that are long enough, where c words
can still stand around that position. Everything is DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Phrases that name a license, and wordings of license notices.
PHRASES = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
# Label, wording, and words that may not be missing.
TEMPLATES = [
    ("apache-2", "Licensed under the Apache License, Version 2.0", "apache"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted", "redistribution"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License", "creative commons"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc nc"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3", "gnu 3"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "gnu lesser"),
    ("mit", "Released under the MIT License", "mit"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "permission"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla"),
]
# Share of a template's words that a block must contain, as a fraction.
CONTAINMENT = (4, 5)

# A block has this many words for each of the template's, as a fraction.
STRETCH = (3, 2)
# Ends of paragraphs.
BLANK = r"\n[ \t\r]*\n"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Signs between words, before A-Z became lower case.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def words(text: Column) -> Column:
    """Words of ASCII letters, digits and all signs beyond ASCII, with A-Z in lower case."""
    return F.array_remove(F.split(F.translate(text, _UPPER, _LOWER), f"{BETWEEN}+"), "")


def template_words(text: str) -> list[str]:
    """The distinct words of a template (ASCII), in order."""
    return list(dict.fromkeys("".join(c if c.isalnum() else " " for c in text.lower()).split()))


def _needed(n: int, share: tuple[int, int]) -> int:
    return -(-share[0] * n // share[1])


def span(text: str) -> int:
    """Words of a block for a template."""
    return -(-STRETCH[0] * len("".join(c if c.isalnum() else " " for c in text.lower()).split()) // STRETCH[1])


def template_hits(df: DataFrame, keys: list[str], text: str, templates: list[tuple[str, str, str]] | DataFrame = TEMPLATES, share: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """Every template that a block of a paragraph meets: ``keys``, ``paragraph`` (number from 0),
    ``label``, ``containment`` (largest share of the template's words in a block).

    ``templates``: rows of label, text (ASCII) and the words that may not be missing; a DataFrame
    of them is read to the driver, as it is to stand in the plan. Null and empty texts have no
    hits; repeated rows give repeated hits.
    """
    spark = df.sparkSession
    if isinstance(templates, DataFrame):
        templates = [tuple(r) for r in templates.select("label", "text", "must").collect()]
    wanted = [(label, template_words(t), template_words(must or ""), span(t)) for label, t, must in templates]
    wanted = [x for x in wanted if x[1]]
    vocabulary = sorted({x for _, tokens, _, _ in wanted for x in tokens})
    reach = max((s for *_, s in wanted), default=1)
    parts = df.select(*keys, F.posexplode(F.split(text, BLANK, -1)).alias("paragraph", "part"))
    # lower() finds all A-Z words and possibly a few more; those that pass are cut exactly.
    rough = F.split(F.lower("part"), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    names = F.array(*map(F.lit, vocabulary)) if vocabulary else F.array().cast("array<string>")
    counts = dict(parts.select(F.explode(F.array_intersect(names, rough)).alias("w")).groupBy("w").count().collect())
    rank = {x: i for i, x in enumerate(sorted(vocabulary, key=lambda x: (counts.get(x, 0), x)))}
    prefixes = []
    for number, (label, tokens, must, size) in enumerate(wanted):
        tokens = sorted(tokens, key=rank.__getitem__)
        need = _needed(len(tokens), share)
        prefixes += [(number, label, tokens, must, need, size, tokens[i]) for i in range(len(tokens) - need + 1)]
    table = spark.createDataFrame(prefixes, "number int, label string, tokens array<string>, must array<string>, need int, size int, w string")
    starts = sorted({p[-1] for p in prefixes})
    first = F.array(*map(F.lit, starts)) if starts else F.array().cast("array<string>")
    some = parts.where(F.arrays_overlap(first, rough)).withColumn("words", words(F.col("part")))
    least = min((p[4] for p in prefixes), default=1)
    some = some.where(F.size("words") >= least)
    # The words around each word of a prefix, as far as a block reaches, and where it stands in them.
    around = F.transform(
        "words",
        lambda x, i: F.when(
            F.array_contains(first, x),
            F.struct(x.alias("w"), F.least(i, F.lit(reach - 1)).alias("at"), F.slice("words", F.greatest(i - (reach - 2), F.lit(1)), F.least(i, F.lit(reach - 1)) + reach).alias("near")),
        ),
    )
    anchors = some.select(*keys, "paragraph", F.explode(F.array_compact(around)).alias("a")).select(*keys, "paragraph", "a.*")
    before, after = F.least("at", F.col("size") - 1), F.least(F.size("near") - F.col("at") - 1, F.col("size") - 1)
    found = anchors.join(table, "w").where(before + after + 1 >= F.col("need"))
    own = F.expr("slice(near, at - least(at, size - 1) + 1, least(at, size - 1) + size)")
    found = found.where(F.size(F.array_intersect("tokens", own)) >= F.col("need"))
    held = F.transform(F.sequence(F.lit(1), before + 1), lambda k: F.array_intersect("tokens", F.slice(own, k, F.col("size"))))
    good = F.filter(held, lambda block: (F.size(block) >= F.col("need")) & (F.size(F.array_except("must", block)) == 0))
    met = found.withColumn("most", F.array_max(F.transform(good, lambda block: F.size(block)))).where(F.col("most").isNotNull())
    return met.groupBy(*keys, "paragraph", "label").agg(F.max(F.col("most") / F.size("tokens")).alias("containment"))


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str, str]] | DataFrame = TEMPLATES, share: tuple[int, int] = CONTAINMENT) -> DataFrame:
    """License phrases and notices of every text.

    Returns a row per row of ``df``: ``doc_id``, ``n_words``, ``n_base`` (places of all
    PHRASES), ``first_word`` and ``last_word`` (smallest and largest start of a phrase, in words
    from 0; else null), ``base_labels``, ``labels`` (with those of the templates met; both
    distinct, sorted, comma-joined, empty without any) and ``score`` (1 with a phrase, else the
    largest containment of a template met, else 0).

    A null text counts as empty. Null doc_ids and repeated rows stay: rows are told apart by
    doc_id and the 64-bit hash of the text, and equal rows have equal results. Other columns
    are not read.
    """
    rows = df.select(df[doc_id].alias("doc_id"), F.coalesce(df[text], F.lit("")).alias("text"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    hits = template_hits(rows, ["doc_id", "hash"], "text", templates, share)
    met = hits.groupBy(F.col("doc_id").alias("hit_id"), F.col("hash").alias("hit_hash")).agg(F.collect_set("label").alias("met"), F.max("containment").alias("containment"))

    apart = [f"{BETWEEN}+".join(phrase.split()) for phrase in PHRASES.values()]
    may = F.col("text").rlike("(?i)" + "|".join(apart))
    spaced = F.when(may, F.concat(F.lit(" "), F.array_join(words(F.col("text")), "  "), F.lit(" ")))
    base = rows.select("doc_id", "hash", F.size(F.array_remove(F.split("text", f"{BETWEEN}+"), "")).cast("long").alias("n_words"), spaced.alias("spaced"))

    def count(part: Column) -> Column:
        return (F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2

    places, firsts, lasts, labels = [], [], [], []
    for label, phrase in PHRASES.items():
        parts = F.split("spaced", f" {'  '.join(phrase.split())} ", -1)
        n = F.size(parts) - 1
        places.append(F.when(n > 0, n).otherwise(0))
        firsts.append(F.when(n > 0, count(parts[0])))
        lasts.append(F.when(n > 0, F.col("n_words") - count(F.element_at(parts, -1)) - len(phrase.split())))
        labels.append(F.when(n > 0, F.lit(label)))
    found = base.select(
        "doc_id",
        "hash",
        "n_words",
        sum(places, F.lit(0)).cast("long").alias("n_base"),
        F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*labels))).alias("base"),
    )
    joined = found.join(met, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("hash") == F.col("hit_hash")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("met", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), score.alias("score"))
