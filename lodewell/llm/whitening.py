"""Whitening of vectors by a randomised range finder.

The components of the covariance V are sought in a random subspace of a few more dimensions than are wanted. Each
power pass multiplies a basis of it by V: all rows, centred first, are read once, and only sums of the size of the
basis reach the driver. Rayleigh-Ritz then gives the components within the subspace. If their residuals are not small
after the last pass, the subspace is expanded to the full dimension, in which one more pass gives V itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType
from pyspark.sql import functions as F

from lodewell.llm.vectors import finite, lengths, matrix, summed, whole_numbers

SCALE, SHIFT = 1024, 100_000
MOST = 1 << 40


def _numbers(x: np.ndarray) -> np.ndarray:
    return whole_numbers(x, SCALE, MOST) + SHIFT


@dataclass(frozen=True)
class Centre:
    """The number of rows and the sum of each dimension."""

    n: int
    sums: np.ndarray

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """n * x - sum, exactly: as long as they fit, integers of 64 bits, else Python's."""
        if len(x) and self.n * int(np.abs(x).max()) >= 1 << 62:
            x = x.astype(object)
        return self.n * x - self.sums

    def centred(self, x: np.ndarray) -> np.ndarray:
        return self.scaled(x).astype(np.float64) / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The sum of squares of n * x - sum of each row; None beyond a long."""
        away = self.scaled(x)
        if away.size and int(np.abs(away).max()) ** 2 * away.shape[1] >= 1 << 63:
            away = away.astype(object)
        return [v if v < 1 << 63 else None for v in map(int, (away * away).sum(axis=1))]


@dataclass(frozen=True)
class Components:
    """Eigenvalues, falling, with unit eigenvectors as columns; the trace of V; and how the search went."""

    values: np.ndarray
    vectors: np.ndarray
    trace: float
    passes: int
    full: bool

    @property
    def whitener(self) -> np.ndarray:
        return self.vectors / np.sqrt(self.values)


def _settled(values: np.ndarray, residuals: np.ndarray, wanted: int, tolerance: float) -> bool:
    """Whether the residuals of the wanted components are small against their distance from the other eigenvalues."""
    gaps = np.abs(values[:, None] - values[None, :]) + np.diag(np.full(len(values), np.inf))
    return bool((residuals[:wanted] <= tolerance * gaps.min(axis=1)[:wanted]).all())


def _ritz(basis: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(values, vectors, residual norms) of the covariance within an orthonormal basis, whose image under it is given."""
    inner = basis.T @ image
    values, turn = np.linalg.eigh((inner + inner.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, basis @ turn, np.linalg.norm(image @ turn - (basis @ turn) * values, axis=0)


def fit(rows: DataFrame, centre: Centre, *, components: int = 8, oversample: int = 8, passes: int = 4, tolerance: float = 1e-11, seed: int = 11) -> Components:
    """The components of the covariance of `rows` (x), divisor n.

    At most `passes` power passes over a basis of components + oversample columns, then, if a residual is larger than
    `tolerance` times the distance to the next eigenvalue, one in full dimension. Components whose eigenvalue is zero
    but for rounding are left out, so rows all alike have none.
    """
    d = len(centre.sums)

    def image(basis: np.ndarray) -> tuple[np.ndarray, float]:
        sent = rows.sparkSession.sparkContext.broadcast(basis)

        def products(x: np.ndarray) -> np.ndarray:
            y = centre.centred(_numbers(x))
            return np.column_stack([y.T @ (y @ sent.value), (y * y).sum(axis=0)])

        total = summed(rows, "x", products, (d, basis.shape[1] + 1), "double") / centre.n
        sent.unpersist()
        return total[:, :-1], float(total[:, -1].sum())

    columns, done, settled = components + oversample, 0, False
    if columns < d:
        basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, columns)))[0]
        while done < passes and not settled:
            y, trace = image(basis)
            done += 1
            values, found, residuals = _ritz(basis, y)
            settled = _settled(values, residuals, components, tolerance)
            basis = np.linalg.qr(y)[0]
    if not settled:
        y, trace = image(np.eye(d))
        values, found, _ = _ritz(np.eye(d), y)
    real = min(components, int((values > max(values[0], 0.0) * d * np.finfo(np.float64).eps).sum()))
    return Components(values[:real], found[:, :real], trace, done, not settled)


def _identity_error(rows: DataFrame, centre: Centre, model: Components) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, measured over all rows."""
    k = len(model.values)

    def products(x: np.ndarray) -> np.ndarray:
        z = centre.centred(_numbers(x)) @ model.whitener
        return np.column_stack([z.T @ z, z.sum(axis=0)])

    total = summed(rows, "x", products, (k, k + 1), "double") / centre.n
    mean = total[:, -1]
    return float(np.abs(total[:, :-1] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", **settings) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every row with a usable vector.

    A component c counts as floor(1024 * c) + 100000. There is one output row for each input row and component, numbered
    from 1 by falling eigenvalue. Rows whose vector is null, empty, or holds a null or non-finite component are dropped,
    and so are those of another length than the commonest. Null keys and repeated rows are rows like any other, and so
    are zero vectors. Components with eigenvalue zero are left out: an empty table, a single row and rows all alike
    give no rows. Eigenvalues that tie leave their eigenvectors open; whichever come out serve all rows. A deviation
    beyond a long is null; a component c of 2^30 or more raises ValueError. Other columns, whatever their names, are
    left out.

    Rows are read once for the sums, once a pass, once to measure the identity error and once for the result, without a
    shuffle of vectors; sums of a matrix an attempt are all that moves.
    """
    schema = StructType([
        StructField(key, vectors.schema[key].dataType), StructField("component", IntegerType()), StructField("n", LongType()), StructField("deviation", LongType()),
        StructField("whitened", DoubleType()), StructField("explained", DoubleType()), StructField("identity_error", DoubleType()),
    ])
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).alias("x")).where(finite("x"))
    d, n = lengths(rows, "x")
    none = vectors.sparkSession.createDataFrame([], schema)
    if not n:
        return none
    rows = rows.where(F.size("x") == d)
    centre = Centre(n, summed(rows, "x", lambda x: _numbers(x).sum(axis=0)[:, None], (d, 1), "long")[:, 0])
    model = fit(rows, centre, **settings)
    k = len(model.values)
    if not k:
        return none
    error, explained = _identity_error(rows, centre, model), model.values / model.trace

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                block = batch.slice(at, 4096)
                x = _numbers(matrix(block.column(1)))
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    block.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(x) * k, n)), pa.array(centre.deviations(x), pa.int64()).take(pa.array(each)),
                    pa.array((centre.centred(x) @ model.whitener).ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return rows.mapInArrow(project, schema)
