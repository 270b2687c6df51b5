"""Revision times as text with mixed UTC offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: how chart points print a UTC time.
ISO_UTC = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"


def to_utc(text: Column | str) -> Column:
    """The UTC time of a text with an offset, NULL when it is no time."""
    text = F.col(text) if isinstance(text, str) else text
    return F.try_to_timestamp(text).cast("timestamp_ntz")


def iso_utc(time: Column | str) -> Column:
    """A UTC time in the chart's text format."""
    return F.date_format(time, ISO_UTC)
