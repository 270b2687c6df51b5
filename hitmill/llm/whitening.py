"""Whitened principal components of vectors by Chebyshev-filtered subspace iteration.

The covariance is never formed. Spark multiplies it with a block of directions: each
task centres its rows X and adds up Xᵀ(XQ). A polynomial recurrence over such passes damps
all eigenvalues below the block's least one and lifts those above; then the block is made
orthonormal (QR) and rotated to its best approximations (Rayleigh-Ritz). This repeats until the
residuals of the wanted components certify them.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hitmill.llm.scratch import stage

SCALE = 256
COMPONENTS = 4
# Directions more than wanted: the more, the faster the wanted ones stand out.
SPARE = 28
# Passes between two Rayleigh-Ritz steps.
DEGREE = 8
# A component is certified if ||Vq - eq|| is below this share of the largest eigenvalue.
RESIDUAL = 1e-13
MAX_PASSES = 4000
# Eigenvalues below this share of the largest are rounding.
ZERO = 1e-13
BLOCK_ROWS = 8192

_SAFE = 1 << 62


def _pack(x: np.ndarray) -> list[bytes]:
    """Each row as bytes of the least width of 2, 4 or 8 that holds its numbers."""
    top = np.maximum(x.max(axis=1), -(x.min(axis=1) + 1))
    out: list[bytes] = [b""] * len(x)
    for kind, low, high in (("<i2", -1, 1 << 15), ("<i4", 1 << 15, 1 << 31), ("<i8", 1 << 31, 1 << 63)):
        at = np.flatnonzero((top >= low) & (top <= high - 1))
        for i, row in zip(at.tolist(), x[at].astype(kind)):
            out[i] = row.tobytes()
    return out


def _unpack(packed: pa.Array, size: int) -> np.ndarray:
    """The packed rows as 64-bit numbers."""
    out = np.empty((len(packed), size), np.int64)
    raw = packed.to_pylist()
    width = np.array([len(x) for x in raw], np.int64) // size
    for kind, w in (("<i2", 2), ("<i4", 4), ("<i8", 8)):
        at = np.flatnonzero(width == w)
        if len(at):
            out[at] = np.frombuffer(b"".join([raw[i] for i in at.tolist()]), kind).reshape(-1, size)
    return out


def _scaled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    limit = float(2**63 - 1024)
    for batch in batches:
        lists = batch.column("vector")
        size = np.asarray(lists.value_lengths()).astype(np.int64)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * np.asarray(lists.flatten(), np.float64)), -(2.0**63), limit).astype(np.int64)
        begins = np.cumsum(size) - size
        out: list[bytes] = [b""] * len(size)
        for d in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == d)
            for i, row in zip(at.tolist(), _pack(x[begins[at][:, None] + np.arange(d)])):
                out[i] = row
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(size.astype(np.int32)), pa.array(out, pa.binary())], names=["vec_id", "d", "x"])


def _blocks(size: int):
    """Many packed rows as one: a pass reads few values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK_ROWS):
                x = _unpack(batch.column(0).slice(a, BLOCK_ROWS), size)
                width = len(_pack(np.array([[x.min(), x.max()]]))[0]) // 2
                yield pa.RecordBatch.from_arrays([pa.array([width], pa.int32()), pa.array([x.astype(f"<i{width}").tobytes()], pa.binary())], names=["width", "x"])

    return run


def _matrices(batches: Iterable[pa.RecordBatch], size: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for width, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
            yield np.frombuffer(raw.as_buffer(), f"<i{width}").reshape(-1, size).astype(np.int64)


def _deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact (Python's integers where 64 bits might not hold them)."""
    most = n * int(max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))) + max(map(abs, sums))
    if most < _SAFE:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def _squares(deviations: np.ndarray) -> list[int | None]:
    """The sum of squares of each row, exact; None beyond 64 bits."""
    most = int(max(abs(deviations.max()), abs(deviations.min()))) if deviations.size else 0
    if deviations.dtype != object and most * most * deviations.shape[1] < _SAFE:
        return (deviations * deviations).sum(axis=1).tolist()
    exact = deviations.astype(object)
    return [x if x < 1 << 63 else None for x in (exact * exact).sum(axis=1).tolist()]


@dataclass
class Fit:
    """The distinct vectors in blocks, their number, length and sums."""

    blocks: DataFrame
    n: int
    size: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        return _deviations(x, self.n, self.sums).astype(np.float64) / self.n

    def total(self, each, shape: tuple[int, ...]) -> np.ndarray:
        """The sum of ``each(centred rows)`` over all blocks, by Spark; an array of ``shape``."""
        size, centred = self.size, Fit(None, self.n, self.size, self.sums).centred

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = np.zeros(int(np.prod(shape)))
            for x in _matrices(batches, size):
                found += each(centred(x)).reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(found), dtype=np.int32)), pa.array(found)], names=["place", "value"])

        rows = self.blocks.mapInArrow(run, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).toArrow()
        out = np.zeros(int(np.prod(shape)))
        out[np.asarray(rows.column("place"))] = np.asarray(rows.column("value"))
        return out.reshape(shape)

    def times(self, q: np.ndarray) -> np.ndarray:
        """The covariance times ``q``: one pass."""
        return self.total(lambda x: x.T @ (x @ q), q.shape) / self.n


def _sums(blocks: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of rows in all blocks, and the exact sums of their columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(size, np.int64), np.zeros(size, np.int64)
        for x in _matrices(batches, size):
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(-1, size, dtype=np.int32)), pa.array(np.append(0, high)), pa.array(np.append(n, low))], names=["place", "high", "low"]
        )

    wide = "decimal(38,0)"
    rows = blocks.mapInArrow(run, "place int, high long, low long").groupBy("place").agg(F.sum(F.col("high").cast(wide)).alias("high"), F.sum(F.col("low").cast(wide)).alias("low"))
    found = {r.place: (int(r.high) << 32) + int(r.low) for r in rows.collect()}
    return found.get(-1, 0), [found.get(i, 0) for i in range(size)]


def eigenpairs(fit: Fit, wanted: int = COMPONENTS, residual: float = RESIDUAL) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of the covariance and their unit eigenvectors (columns), certified.

    Returns fewer than ``wanted`` if the rest are zero. Raises ArithmeticError if MAX_PASSES
    passes leave a residual above ``residual`` that still falls.
    """
    wanted = min(wanted, fit.size)
    width = min(wanted + SPARE, fit.size)
    q = np.linalg.qr(np.random.default_rng(0).standard_normal((fit.size, width)))[0]
    passes, before = 0, np.inf
    while True:
        product = fit.times(q)
        passes += 1
        values, turn = np.linalg.eigh((q.T @ product + product.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        if values[0] <= 0:
            return np.zeros(0), np.zeros((fit.size, 0))
        left = np.linalg.norm(product[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0).max() / values[0]
        # Certified, or as good as the rounding of the sums lets it be.
        if left <= residual or left < 1e-10 and left > before / 2:
            good = values[:wanted] > ZERO * values[0]
            return values[:wanted][good], q[:, :wanted][:, good]
        if passes > MAX_PASSES:
            raise ArithmeticError(f"residual {left:.1e} after {passes} passes")
        before = left
        # Eigenvalues from 0 to the block's least are damped: there the polynomial stays within 1.
        half = max(values[-1], values[0] * 1e-6) / 2
        past, now = q, (product - half * q) / half
        for _ in range(DEGREE - 1):
            past, now = now, 2 / half * (fit.times(now) - half * now) - past
            passes += 1
        q = np.linalg.qr(now / np.linalg.norm(now, axis=0))[0]


def whiten(df: DataFrame, components: int = COMPONENTS, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Every vector's leading whitened components.

    An entry c, as double, counts as floor(256 c) (at most what 64 bits hold). Fitted are the distinct
    vectors of these whole numbers: n vectors with sums S by dimension. Returns, for each row and
    ``component`` (from 1, by falling eigenvalue e of the covariance with divisor n):
    ``vec_id``, ``n`` (long), ``deviation`` (long, exact sum of (n x - S)**2; null if beyond 64
    bits), ``whitened`` ((x - S / n) along the unit eigenvector, over sqrt(e)), ``explained``
    (e over the trace) and ``identity_error`` (largest entry of the whitened vectors' covariance
    minus the identity).

    Rows whose vector is null, empty, or holds a null or a non-finite entry are dropped, and
    so are vectors of another length than most have (ties: the longer). Rows, repeated ones included, come
    back with their vec_id, which may be null. Components without variance have no rows: none at
    all if all vectors are equal or the table is empty. Other columns are not read.
    """
    entries = df[vector].cast("array<double>")
    finite = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    source = df.where(entries.isNotNull() & finite & (F.size(entries) > 0)).select(df[vec_id].alias("vec_id"), entries.alias("vector"))
    kind = df.schema[vec_id].dataType.simpleString()
    rows, _ = stage(source.mapInArrow(_scaled, f"vec_id {kind}, d int, x binary"), "vectors")
    out = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    most = rows.groupBy("d").count().orderBy(F.desc("count"), F.desc("d")).first()
    if most is None:
        return df.sparkSession.createDataFrame([], out)
    size = most.d
    rows = rows.where(F.col("d") == size)
    blocks, _ = stage(rows.select("x").distinct().mapInArrow(_blocks(size), "width int, x binary"), "vector-blocks")
    n, sums = _sums(blocks, size)
    fit = Fit(blocks, n, size, sums)
    values, axes = eigenpairs(fit, components)
    k = len(values)
    onto = axes / np.sqrt(values)

    def spread(x: np.ndarray) -> np.ndarray:
        z = x @ onto
        return np.concatenate([(z.T @ z).reshape(-1), z.sum(axis=0), [(x * x).sum()]])

    found = fit.total(spread, (k * k + k + 1,)) / fit.n
    mean = found[k * k : -1]
    error = float(np.abs(found[: k * k].reshape(k, k) - np.outer(mean, mean) - np.eye(k)).max(initial=0))
    shares = (values / found[-1]).tolist() if found[-1] > 0 else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not k:
                continue
            off = _deviations(_unpack(batch.column("x"), size), n, sums)
            z, squares = off.astype(np.float64) / n @ onto, pa.array(_squares(off), pa.int64())
            m = batch.num_rows
            for i in range(k):
                columns = [batch.column("vec_id"), pa.array(np.full(m, i + 1, np.int32)), pa.array(np.full(m, n)), squares, pa.array(z[:, i])]
                columns += [pa.array(np.full(m, share)) for share in (shares[i], error)]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return rows.select("vec_id", "x").mapInArrow(run, out)

