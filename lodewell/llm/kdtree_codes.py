"""Compression of vectors to one code a part, by codebooks that k-means fits to all rows.

Components are whole numbers throughout. Each round broadcasts a kd-tree over the entries of every codebook. A part
finds its nearest entry by branch and bound: the child with the nearer bounding box first, then the other one unless
its box is farther than the best entry so far. A box that is just as far is visited as well, since it may hold an
equally near entry of a lower index. Tasks add up the parts of each entry in whole numbers, and a shuffle adds up theirs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from lodewell.llm.vectors import finite, lengths, matrix, summed, whole_numbers
from lodewell.sources.tables import materialize

SCALE = 256
MOST = 1 << 24  # squares of differences, summed over the parts of a vector, stay far below a long


@dataclass
class Node:
    """A box around entries; a leaf holds their indexes, in order."""

    low: np.ndarray
    high: np.ndarray
    leaf: list[int] = field(default_factory=list)
    left: Node | None = None
    right: Node | None = None

    def bound(self, q: np.ndarray) -> np.ndarray:
        """Squared distances of points to the box."""
        away = np.maximum(np.maximum(self.low - q, q - self.high), 0)
        return (away * away).sum(axis=1)


class KdTree:
    """The entries of one codebook, halved along the widest side of their box down to leaves of at most `leaf` entries."""

    def __init__(self, entries: np.ndarray, leaf: int = 8):
        self.entries, self.leaf = entries, leaf
        self.root = self._node(np.arange(len(entries)))

    def _node(self, at: np.ndarray) -> Node:
        own = self.entries[at]
        node = Node(own.min(axis=0), own.max(axis=0))
        if len(at) <= self.leaf:
            node.leaf = sorted(at.tolist())
        else:
            side = int((node.high - node.low).argmax())
            order = at[np.argsort(own[:, side], kind="stable")]
            node.left, node.right = self._node(order[: len(at) // 2]), self._node(order[len(at) // 2 :])
        return node

    def nearest(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry, of equally near ones the lowest index."""
        best = np.full(len(q), np.iinfo(np.int64).max)
        index = np.zeros(len(q), np.int64)

        def visit(node: Node, at: np.ndarray) -> None:
            if not at.size:
                return
            points = q[at]
            if node.left is None:
                least, which = best[at], index[at]
                for e in node.leaf:
                    away = points - self.entries[e]
                    d = (away * away).sum(axis=1)
                    better = (d < least) | ((d == least) & (e < which))
                    least, which = np.where(better, d, least), np.where(better, e, which)
                best[at], index[at] = least, which
                return
            left, right = node.left.bound(points), node.right.bound(points)
            first = left <= right
            visit(node.left, at[first])
            visit(node.right, at[~first | (right <= best[at])])
            visit(node.left, at[~first & (left <= best[at])])

        visit(self.root, np.arange(len(q)))
        return index, best


@dataclass(frozen=True)
class Codebooks:
    """Entries, (parts, entries, width)."""

    entries: np.ndarray

    def trees(self) -> list[KdTree]:
        return [KdTree(book) for book in self.entries]

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def assign(trees: list[KdTree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codes, squared distances), each (rows, parts), of whole vectors."""
    parts = x.reshape(len(x), len(trees), -1)
    found = [tree.nearest(np.ascontiguousarray(parts[:, m])) for m, tree in enumerate(trees)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _improved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """Each entry moved to the mean, rounded down, of the parts that are nearest to it; entries without a part stay."""
    parts, size, width = books.entries.shape
    spark = rows.sparkSession
    sent = spark.sparkContext.broadcast(books.trees())

    def sums(x: np.ndarray) -> np.ndarray:
        x = whole_numbers(x, SCALE, MOST)
        codes, _ = assign(sent.value, x)
        total = np.zeros((parts * size, width + 1), np.int64)
        flat = (codes + np.arange(parts) * size).ravel()
        np.add.at(total[:, :width], flat, x.reshape(-1, width))
        total[:, width] = np.bincount(flat, minlength=parts * size)
        return total

    total = summed(rows, "x", sums, (parts * size, width + 1), "long").reshape(parts, size, width + 1)
    sent.unpersist()
    count = total[:, :, width:]
    return Codebooks(np.where(count > 0, total[:, :, :width] // np.maximum(count, 1), books.entries))


def fit(rows: DataFrame, *, parts: int = 16, entries: int = 64, rounds: int = 2) -> Codebooks:
    """Codebooks of `rows` (key, x), whose vectors all have one length, divisible by `parts`.

    A codebook starts as its part of the vectors of the smallest keys, of equal keys the smaller vectors first, null
    keys last. Only those vectors and one sum an entry reach the driver.
    """
    first = rows.select("key", "x").orderBy(F.asc_nulls_last("key"), "x").limit(entries).toPandas()["x"]
    x = whole_numbers(np.stack([np.asarray(v, np.float64) for v in first]), SCALE, MOST)
    books = Codebooks(np.ascontiguousarray(x.reshape(len(x), parts, -1).transpose(1, 0, 2)))
    for _ in range(rounds):
        books = _improved(rows, books)
    return books


def compress(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2
) -> DataFrame:
    """(key, code, error, label_error, codebooks_sha256), one row per row of `vectors` with a usable vector.

    code has two hex digits a part, error is the sum of the final squared distances, label_error that of all rows of
    the label, null labels together. Rows whose vector is null, empty, or holds a null or non-finite component are
    dropped, and so are those of another length than the commonest; a length that the parts do not divide raises
    ValueError, and so does a component of 65,536 or more. Zero vectors are vectors like any other. Null keys and
    repeated rows are kept, each with a row of its own; of equally near entries the lowest index is taken. With fewer
    than `entries` rows a codebook has as many entries as there are rows. An empty table gives no rows. Other columns,
    whatever their names, are left out.

    The codes are written once; the errors of a label are summed map-side and joined back, a plain exchange on either
    side, so that a label with many rows can be split.
    """
    kept = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("x")).where(finite("x"))
    dimension, _ = lengths(kept, "x")
    kind = lambda name: vectors.schema[name].dataType
    schema = StructType([StructField(key, kind(key)), StructField("code", StringType()), StructField("error", LongType()), StructField("label_error", LongType()), StructField("codebooks_sha256", StringType())])
    if not dimension:
        return vectors.sparkSession.createDataFrame([], schema)
    if dimension % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {dimension} components")
    kept = kept.where(F.size("x") == dimension)
    books = fit(kept, parts=parts, entries=entries, rounds=rounds)
    sent = vectors.sparkSession.sparkContext.broadcast(books.trees())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                block = batch.slice(at, 4096)
                codes, errors = assign(sent.value, whole_numbers(matrix(block.column(2)), SCALE, MOST))
                text = pa.array([row.tobytes().hex() for row in codes.astype(np.uint8)])
                yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), text, pa.array(errors.sum(axis=1))], names=["key", "label", "code", "error"])

    coded = StructType([StructField("key", kind(key)), StructField("label", kind(label)), StructField("code", StringType()), StructField("error", LongType())])
    rows = materialize(kept.mapInArrow(encode, coded), "codes")
    totals = materialize(rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of"), "errors")
    joined = rows.join(totals, F.col("label").eqNullSafe(F.col("of")))
    return joined.select(F.col("key").alias(key), "code", "error", "label_error", F.lit(books.sha256).alias("codebooks_sha256"))
