"""Result shaping for the comparison with the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def result(df: DataFrame, places: int | None = 6) -> DataFrame:
    """Doubles rounded, so that summation order does not show; times as UTC.

    Applied to results only; operators return full precision. ``places=None``
    keeps doubles that both engines must have bit by bit.
    """

    def shaped(f: T.StructField):
        if isinstance(f.dataType, T.DoubleType) and places is not None:
            return F.round(f.name, places).alias(f.name)
        if isinstance(f.dataType, T.TimestampType):
            return F.col(f.name).cast("timestamp_ntz").alias(f.name)
        return F.col(f.name)

    kinds = (T.DoubleType, T.TimestampType)
    if not any(isinstance(f.dataType, kinds) for f in df.schema):
        return df
    return df.select(*[shaped(f) for f in df.schema])
