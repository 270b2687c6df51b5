"""Text expressions of the web-analytics suite."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the host of an absolute link, without a leading "www.".
HOST_PATTERN = r"^https?://(?:www\.)?([^/]+)/.*$"


def link_host(url: str) -> Column:
    """The host part of a link; text that is no absolute link stays as it is."""
    return F.regexp_replace(url, HOST_PATTERN, "$1")


def link_parameter(url: str, marker: str) -> Column:
    """The text after ``marker`` up to the next ``&`` (empty when absent)."""
    tail = F.split_part(F.col(url), F.lit(marker), F.lit(2))
    return F.split_part(tail, F.lit("&"), F.lit(1))


def digits_or_zero(value: Column) -> Column:
    """An all-digit text as int, any other text as 0.

    A number that does not fit an int gives NULL instead of an ANSI error, so
    comparisons drop the row.
    """
    return F.when(value.rlike(r"\A[0-9]+\z"), value.try_cast("int")).otherwise(F.lit(0))
