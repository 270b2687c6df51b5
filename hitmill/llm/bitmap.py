"""A bitmap of numbers that keeps most rows without a partner out of a shuffle.

It has a fixed size, so it may be broadcast at any size of data. A row it lets through may
still have no partner; a join decides.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.llm import words as w

# 8 MB.
SLOTS = 1 << 26


def _slots(values: np.ndarray) -> np.ndarray:
    return (w.mix(values.view(np.uint64)) & np.uint64(SLOTS - 1)).astype(np.int64)


def _marked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(SLOTS // 8, np.uint8)
    for batch in batches:
        slot = _slots(np.asarray(batch.column(0)))
        np.bitwise_or.at(bits, slot >> 3, (1 << (slot & 7)).astype(np.uint8))
    packed = bits.view(np.int64)
    at = np.flatnonzero(packed)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(packed[at])], names=["word", "bits"])


def build(df: DataFrame, column: str) -> bytes:
    """The bitmap of a long column without nulls (at most SLOTS / 64 rows reach the driver)."""
    packed = np.zeros(SLOTS // 64, np.int64)
    words = df.select(column).mapInArrow(_marked, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    packed[np.asarray(words.column("word"))] = np.asarray(words.column("bits"))
    return packed.tobytes()


def holds(bitmap: bytes, values: np.ndarray) -> np.ndarray:
    """Which of the 64-bit numbers may be in the bitmap."""
    slot = _slots(values)
    return (np.frombuffer(bitmap, np.uint8)[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def keep(df: DataFrame, column: str, bitmap: bytes) -> DataFrame:
    """The rows whose long (no nulls) may be in the bitmap."""
    place = df.columns.index(column)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(holds(bitmap, np.asarray(batch.column(place)))))

    return df.mapInArrow(run, df.schema)
