"""Whitening of vectors by a polarisation covariance.

Var(a + b) = Var(a) + Var(b) + 2 Cov(a, b): exact sums of squares of every dimension and of
every sum of two dimensions give every covariance as a difference of variances. Vectors are
whole numbers (64ths, shifted), so the sums are exact until the one division.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillscope.llm.store import written

#: a number c becomes floor(SCALE * c) + SHIFT
SCALE = 64
SHIFT = 1_000_000
#: numbers from here on have no place in whole 64ths
_LARGEST = float(1 << 53)
#: sums travel as digits of so many bits, which BIGINT sums cannot overflow
_DIGIT = 40
_DIGITS = 7
_CHUNK = 2048
#: an eigenvalue below this share of the trace is rounding, not variance
_NO_VARIANCE = 1e-13
_RESULT = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, "
    "explained double, identity_error double"
)


@dataclass(frozen=True)
class Whitening:
    """What turns a vector of ``len(sums)`` whole numbers into its components."""

    n: int  # different vectors it was fitted on
    sums: tuple[int, ...]  # of each dimension
    covariance: np.ndarray
    values: np.ndarray  # eigenvalues, largest first
    axes: np.ndarray  # unit eigenvectors, one a column

    @property
    def whole(self) -> np.ndarray:
        """Whole part of each mean."""
        return np.array([s // self.n for s in self.sums], np.int64)

    @property
    def rest(self) -> np.ndarray:
        """What the whole part leaves of each sum, from 0 to n - 1."""
        return np.array([s % self.n for s in self.sums], np.int64)

    def components(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN in a component without variance."""
        centred = (x - self.whole).astype(np.float64) - self.rest / self.n
        has = self.values > _NO_VARIANCE * np.trace(self.covariance)
        scale = np.where(has, 1 / np.sqrt(np.where(has, self.values, 1)), np.nan)
        return (centred @ self.axes) * scale

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum of (n * x - sum)^2 over the dimensions of each row; None beyond BIGINT."""
        shifted, rest = x - self.whole, self.rest
        largest = self.n * (int(np.abs(shifted).max(initial=0)) + 1)
        if largest * largest * len(rest) < 1 << 62:
            return ((self.n * shifted - rest) ** 2).sum(1).tolist()
        apart = (self.n * shifted.astype(object) - rest.astype(object)) ** 2
        return [int(v) if v < 1 << 63 else None for v in apart.sum(1)]


def whole_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """vec_id and x, the vector in whole 64ths, of the rows that can be whitened.

    Left out: vectors that are null or empty, or hold a null, a number that is not finite
    or one of 2^53 and more.
    """
    x = F.col("vector")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) >= _LARGEST))
    rows = vectors.select(
        F.col(f"`{vec_id}`").cast("bigint").alias("vec_id"),
        F.col(f"`{embedding}`").cast("array<double>").alias("vector"),
    )
    whole = F.transform(x, lambda c: F.floor(c * SCALE).cast("bigint") + SHIFT)
    return rows.where((F.size(x) > 0) & ~bad).select("vec_id", whole.alias("x"))


def usual_length(rows: DataFrame) -> int | None:
    """The length that most vectors have, the larger one of equals; None without rows."""
    counts = rows.groupBy(F.size("x").alias("length")).count()
    first = counts.orderBy(F.desc("count"), F.desc("length")).first()
    return first["length"] if first else None


def _matrix(batch: pa.RecordBatch, name: str, length: int) -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _column_sums(values: np.ndarray) -> list[int]:
    if int(np.abs(values).max(initial=0)) * len(values) < 1 << 62:
        return values.sum(0).tolist()
    return [int(v) for v in values.astype(object).sum(0)]


def _square_sums(values: np.ndarray) -> list[int]:
    if int(np.abs(values).max(initial=0)) ** 2 * len(values) < 1 << 62:
        return (values * values).sum(0).tolist()
    return [int(v) for v in (values.astype(object) ** 2).sum(0)]


def _digits(value: int) -> list[int]:
    """Base 2^40, lowest first; the last one carries the sign."""
    low = [(value >> (_DIGIT * k)) & ((1 << _DIGIT) - 1) for k in range(_DIGITS - 1)]
    return [*low, value >> (_DIGIT * (_DIGITS - 1))]


_NAMES = [f"d{k}" for k in range(_DIGITS)]


def _exact_sums(parts: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Adds up exact numbers of the tasks: a row per key comes to the driver."""
    added = parts.groupBy(*keys).agg(*(F.sum(d).alias(d) for d in _NAMES)).collect()
    return {
        tuple(row[k] for k in keys): sum(row[d] << (_DIGIT * k) for k, d in enumerate(_NAMES))
        for row in added
    }


def _digit_batch(keys: dict[str, list[int]], values: list[int]) -> pa.RecordBatch:
    digits = list(zip(*map(_digits, values), strict=True))
    columns = [pa.array(k, pa.int32()) for k in keys.values()]
    return pa.RecordBatch.from_arrays(
        columns + [pa.array(d, pa.int64()) for d in digits], names=[*keys, *_NAMES]
    )


_DIGIT_TYPES = ", ".join(f"{d} bigint" for d in _NAMES)


def dimension_sums(fit: DataFrame, length: int) -> list[int]:
    """Exact sum of each dimension."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = [0] * length
        for batch in batches:
            own = _column_sums(_matrix(batch, "x", length))
            total = [a + b for a, b in zip(total, own, strict=True)]
        yield _digit_batch({"a": list(range(length))}, total)

    found = _exact_sums(fit.mapInArrow(emit, f"a int, {_DIGIT_TYPES}"), ["a"])
    return [found[(a,)] for a in range(length)]


def squared_sums(fit: DataFrame, n: int, sums: list[int]) -> dict[tuple[int, int], int]:
    """Exact sum of squares of n * x - sum for each dimension (a, a) and of the sum of two
    such values for each pair a < b.

    A task adds up small numbers, x less the whole part of the mean, and turns its sums into
    those of the centred values in whole numbers of any size. It emits one row per dimension
    and pair, however many vectors it read.
    """
    length = len(sums)
    whole = np.array([s // n for s in sums], np.int64)
    rest = [s % n for s in sums]
    pairs = [(a, b) for a in range(length) for b in range(a, length)]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, plain, squares = 0, [0] * length, [0] * len(pairs)
        for batch in batches:
            every = _matrix(batch, "x", length) - whole
            for at in range(0, len(every), _CHUNK):
                c = every[at : at + _CHUNK]
                rows += len(c)
                plain = [p + q for p, q in zip(plain, _column_sums(c), strict=True)]
                own: list[int] = []
                for a in range(length):
                    own += _square_sums(c[:, a : a + 1])
                    own += _square_sums(c[:, a : a + 1] + c[:, a + 1 :])
                squares = [p + q for p, q in zip(squares, own, strict=True)]
        centred = []
        for (a, b), square in zip(pairs, squares, strict=True):
            left = plain[a] + (plain[b] if b > a else 0)
            away = rest[a] + (rest[b] if b > a else 0)
            centred.append(n * n * square - 2 * n * away * left + rows * away * away)
        yield _digit_batch({"a": [a for a, _ in pairs], "b": [b for _, b in pairs]}, centred)

    return _exact_sums(fit.mapInArrow(emit, f"a int, b int, {_DIGIT_TYPES}"), ["a", "b"])


def polarised_covariance(squares: dict[tuple[int, int], int], n: int, length: int) -> np.ndarray:
    """Covariances, divisor n, each one rounding away from the exact quotient."""
    found = np.zeros((length, length))
    for (a, b), total in squares.items():
        if a == b:
            found[a, a] = total / n**3
        else:
            both = total - squares[a, a] - squares[b, b]
            found[a, b] = found[b, a] = both / (2 * n**3)
    return found


def fit_whitening(fit: DataFrame, length: int) -> Whitening | None:
    """Whitening of the rows of ``fit``, each with an x of ``length`` whole numbers; None
    without rows. Sums and squares, one row per pair of dimensions, come to the driver."""
    n = fit.count()
    if not n:
        return None
    sums = dimension_sums(fit, length)
    covariance = polarised_covariance(squared_sums(fit, n, sums), n, length)
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    # either sign will do; the same one in each run
    turn = np.sign(axes[np.abs(axes).argmax(0), np.arange(length)])
    return Whitening(n, tuple(sums), covariance, values.copy(), axes * turn)


def identity_error(fit: DataFrame, model: Whitening, most: int) -> float:
    """Largest absolute entry of the covariance of ``most`` whitened components over the
    fit list, less the identity; components without variance aside."""
    length = len(model.sums)
    has = model.values[:most] > _NO_VARIANCE * np.trace(model.covariance)
    places = np.flatnonzero(has)
    if not len(places):
        return 0.0
    i, j = (side.ravel().tolist() for side in np.meshgrid(places, places, indexing="ij"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(places), len(places)))
        for batch in batches:
            own = model.components(_matrix(batch, "x", length))[:, places]
            total += own.T @ own
        arrays = [pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(total.ravel())]
        yield pa.RecordBatch.from_arrays(arrays, names=["i", "j", "total"])

    added = fit.mapInArrow(emit, "i int, j int, total double").groupBy("i", "j").agg(F.sum("total"))
    return max(abs(total / model.n - (i == j)) for i, j, total in added.collect())


def _whitened(rows: DataFrame, model: Whitening, most: int, error: float) -> DataFrame:
    length = len(model.sums)
    kept = min(most, length)
    trace = float(np.trace(model.covariance))
    shares = model.values[:kept] / trace if trace > 0 else np.full(kept, np.nan)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch, "x", length)
            values = model.components(x)[:, :kept].ravel()
            apart = np.repeat(np.arange(len(x)), kept)
            n, error_ = np.full(len(apart), model.n), np.full(len(apart), error)
            share = np.tile(shares, len(x))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id").take(pa.array(apart)),
                    pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), len(x))),
                    pa.array(n, pa.int64()),
                    pa.array(model.deviations(x), pa.int64()).take(pa.array(apart)),
                    pa.array(values, mask=np.isnan(values)),
                    pa.array(share, mask=np.isnan(share)),
                    pa.array(error_),
                ],
                names=[part.split()[0] for part in _RESULT.split(", ")],
            )

    return rows.mapInArrow(emit, _RESULT)


def whiten(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    components: int = 16,
) -> DataFrame:
    """Each vector's first ``components`` whitened components, one row each.

    vec_id, component (from 1, by falling eigenvalue), n (different vectors fitted on),
    deviation (exact sum over dimensions of (n * x - sum)^2), whitened, explained (share of
    the variance) and identity_error (the same in all rows: how far the whitened components
    of the fitted vectors are from unit covariance).

    Fitted on all different vectors, each once. Rows whose vector is null, empty, or holds a
    null, a number that is not finite or one of 2^53 and more are left out, and so are vectors
    of another length than most have. Repeated rows and null ids are rows like others. A
    component without variance has a null ``whitened``, and a table of one single vector a
    null ``explained``; a deviation beyond BIGINT is null. Other columns are dropped; an
    empty table gives an empty result.

    Copies are dropped before they are exchanged. What tasks send and the driver holds grows
    with the square of the length, not with the rows.
    """
    rows = whole_vectors(vectors, vec_id, embedding)
    length = usual_length(rows)
    if length is None:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    rows = rows.where(F.size("x") == length)
    fit = written(rows.select("x").distinct(), "whitening-fit")
    model = fit_whitening(fit, length)
    return _whitened(rows, model, components, identity_error(fit, model, components))

