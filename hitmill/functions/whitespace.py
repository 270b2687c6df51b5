"""Trimming, words and lines over all Unicode separators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# All characters that count as space, as a pattern and as the list
# the pattern stands for, and all line breaks.
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NOT_SPACE = SPACE.replace("[", "[^", 1)
SPACES = "".join(
    chr(code)
    for code in [
        *range(0x09, 0x0E),
        *range(0x1C, 0x21),
        0x85,
        0xA0,
        0x1680,
        *range(0x2000, 0x200B),
        0x2028,
        0x2029,
        0x202F,
        0x205F,
        0x3000,
    ]
)
LINE_BREAK = r"\r\n|[\n-\r\x1c-\x1e\x85\u2028\u2029]"


def no_texts() -> Column:
    return F.array().cast("array<string>")


def strip(text: Column) -> Column:
    """Text without leading and trailing space."""
    return F.trim(text, F.lit(SPACES))


def words(text: Column) -> Column:
    """The words of a text; none for a text of space only."""
    return F.when(strip(text) == "", no_texts()).otherwise(F.split(strip(text), f"{SPACE}+"))


def lines(text: Column) -> Column:
    """The lines of a text without their breaks."""
    return F.split(text, LINE_BREAK)
