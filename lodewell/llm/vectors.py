"""Arrow columns of vectors as matrices."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Whether a vector is neither null, empty nor zero and holds neither null nor non-finite components."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad & F.exists(x, lambda v: v != 0), F.lit(False))


def finite(vector: str) -> Column:
    """Whether a vector is neither null nor empty and holds neither null nor non-finite components; it may be zero."""
    x = F.col(vector)
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce(x.isNotNull() & (F.size(x) > 0) & ~bad, F.lit(False))


def lengths(vectors: DataFrame, vector: str) -> tuple[int, int]:
    """(dimension, rows that have it) of the commonest length of `vector`, of equally common ones the smallest; or (0, 0)."""
    counts = vectors.groupBy(F.size(vector).alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d")
    row = counts.first()
    return (row["d"], row["n"]) if row else (0, 0)


def whole_numbers(x: np.ndarray, scale: int, most: int) -> np.ndarray:
    """floor(scale * x) as integers; a component that reaches `most` raises ValueError rather than wraps around."""
    scaled = np.floor(x * float(scale))
    if scaled.size and np.abs(scaled).max() >= most:
        raise ValueError(f"a component times {scale} reaches {most}")
    return scaled.astype(np.int64)


def summed(rows: DataFrame, vector: str, of: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int], kind: str) -> np.ndarray:
    """The sum, over all rows, of the matrices that `of` makes of blocks of vectors.

    Tasks sum their own blocks; the entries of their sums are added up in a shuffle, and one matrix reaches the driver.
    `kind` is long or double.
    """
    number = np.int64 if kind == "long" else np.float64

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = of(matrix(batch.column(0).slice(at, 4096)))
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(shape[0]), pa.int32()), pa.array(list(total.astype(number)))], names=["i", "v"])

    sums = rows.select(vector).mapInArrow(partial, f"i int, v array<{kind}>").select("i", F.posexplode("v").alias("j", "v"))
    found = sums.groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    out = np.zeros(shape, number)
    out[found["i"], found["j"]] = found["v"]
    return out


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of equal length, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, by way of their largest component, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True, initial=0.0) if len(x) else x
    return x / np.linalg.norm(x, axis=1, keepdims=True)
