"""Lines that many pages of a site share, and pages without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hitmill.llm.scratch import stage

# Lines on more than this share of a host's pages are boilerplate.
RATIO = 0.1

# Parts of HTML that are not shown, and tags that end a line.
HIDDEN = r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
BLOCKS = r"(?i)</?(?:p|br|div|li|ul|ol|h[1-6]|tr|td|th|table|nav|header|footer|article|section|title|head|body|html)\b[^>]*>"
HOST = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:@]+)"


def host(url: Column) -> Column:
    """The host of a URL in lower case, without user, port or a final dot; null without one."""
    return F.lower(F.nullif(F.regexp_replace(F.regexp_extract(url, HOST, 1), r"\.$", ""), F.lit("")))


def html_lines(html: Column) -> Column:
    """The text of HTML with a line for each block element; scripts, styles and comments go."""
    text = F.regexp_replace(html, HIDDEN, "")
    return F.regexp_replace(F.regexp_replace(text, BLOCKS, "\n"), "<[^>]*>", "")


def _bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r"))


def drop_boilerplate(df: DataFrame, site: Column, text: str, ratio: float = RATIO, copies_once: bool = False) -> DataFrame:
    """Replace ``text`` by its lines that are not boilerplate of the row's ``site``.

    For every line, the pages of a site that contain it are divided by the site's pages;
    lines above ``ratio`` that stand on two pages or more are dropped wherever they
    stand, and all other lines stay as they are, in order. The rule is the same for sites of any size. Spaces, tabs and carriage returns
    at a line's ends do not tell lines apart, and lines of nothing else stay.

    Rows, repeated ones included, are pages of their own and all come back, with all columns.
    A null text stays null but counts as a page; a null site keeps all lines; a text that
    loses all its lines is empty. Lines are compared by 64-bit hashes within their site.

    ``copies_once``: rows of a site with equal texts (by their 64-bit hash) are one page, in
    both counts, and a text that would lose all its lines stays whole.

    The pages of a line are counted with partial sums, so a site with a third of all pages is
    not gathered. A site has at most (its lines per page) / ratio boilerplate lines, which
    come back to its pages as one array; a skewed join splits large sites.
    """
    names = df.columns
    at = f"c{names.index(text)}"
    rows = df.select(*(df[c].alias(f"c{i}") for i, c in enumerate(names)), site.alias("site"))
    lines = F.split(at, "\n", -1)
    hashes = F.transform(lines, lambda line: F.when(_bare(line) != "", F.xxhash64(_bare(line))))
    own = F.array_distinct(F.coalesce(hashes, F.array().cast("array<bigint>"))).alias("lines")
    pages = rows.where(F.col("site").isNotNull()).select("site", *([F.xxhash64(at).alias("hash")] if copies_once else []), own)
    if copies_once:
        pages = pages.groupBy("site", "hash").agg(F.first("lines").alias("lines"))
    counts = pages.select("site", F.explode("lines").alias("line")).where(F.col("line").isNotNull()).groupBy("site", "line").agg(F.count("*").alias("n"))
    totals = pages.groupBy("site").agg(F.count("*").alias("pages"))
    often = counts.where(F.col("n") > 1).join(totals, "site").where(F.col("n") > ratio * F.col("pages"))
    boilerplate, _ = stage(often.groupBy("site").agg(F.collect_set("line").alias("boilerplate")), "boilerplate")
    joined = rows.join(boilerplate, "site", "left")
    kept = F.filter(lines, lambda line: (_bare(line) == "") | ~F.array_contains("boilerplate", F.xxhash64(_bare(line))))
    whole = F.col("boilerplate").isNull()
    if copies_once:
        whole |= ~F.exists(kept, lambda line: _bare(line) != "")
    clean = F.when(whole, F.col(at)).otherwise(F.array_join(kept, "\n"))
    return joined.select(*((clean if c == text else F.col(f"c{i}")).alias(c) for i, c in enumerate(names)))
