"""Approximate nearest neighbours by additive quantisation.

A vector's direction is approximated by a sum of full-dimensional codewords, one from each residual codebook, found by
beam search. The index stores a vector's codes, its norm and how far the sum lies from the direction. A query's inner
products with all codewords form a lookup table; the sum of a candidate's entries, times its norm, ranks it, and the best
are scored again on their original vectors. The stored distance bounds the error of the sum, so that every other
candidate that may still be among the nearest is known, and is scored as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodewell.llm.vectors import matrix, units, usable
from lodewell.sources.tables import materialize


@dataclass(frozen=True)
class Codebooks:
    """Codewords, (books, words, dimension)."""

    words: np.ndarray
    beam: int = 4

    @property
    def dimension(self) -> int:
        return self.words.shape[2]

    def encode(self, x: np.ndarray) -> np.ndarray:
        """Codes of each row: of the sums that a beam search reaches, the nearest."""
        n, books = len(x), len(self.words)
        rest = x[:, None, :].astype(np.float32)
        codes = np.zeros((n, 1, 0), np.uint8)
        rows = np.arange(n)[:, None]
        for words in self.words:
            # |r - w|^2 less |x|^2 over all beams; a beam's own |r|^2 counts between beams.
            cost = (rest**2).sum(-1)[:, :, None] - 2 * rest @ words.T + (words**2).sum(-1)
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            source, word = best // len(words), best % len(words)
            rest = rest[rows, source] - words[word]
            codes = np.concatenate([codes[rows, source], word[:, :, None].astype(np.uint8)], axis=2)
        winner = (rest**2).sum(-1).argmin(axis=1)
        return codes[np.arange(n), winner].reshape(n, books)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The sums of the codewords, in double precision."""
        return sum(words[codes[:, m]].astype(np.float64) for m, words in enumerate(self.words))

    @property
    def rounding(self) -> float:
        """What single precision may change at most in a sum of table entries, for a query of length 1."""
        lengths = np.linalg.norm(self.words.astype(np.float64), axis=2).max(axis=1)
        return float((len(self.words) + self.dimension) * np.finfo(np.float32).eps * lengths.sum())

    def table(self, queries: np.ndarray) -> np.ndarray:
        """(books, words, queries): inner products of queries and codewords."""
        return np.matmul(self.words, queries.T.astype(np.float32))


def train(sample: np.ndarray, *, books: int = 32, words: int = 256, rounds: int = 4, seed: int = 11, beam: int = 4) -> Codebooks:
    """Residual k-means: each codebook is fitted to what the ones before leave over."""
    rng = np.random.default_rng(seed)
    rest = sample.astype(np.float32)
    trained = []
    for _ in range(books):
        centres = rest[rng.choice(len(rest), words, replace=len(rest) < words)].copy()
        for _ in range(rounds):
            near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(axis=1)
            count = np.bincount(near, minlength=words)
            total = np.zeros_like(centres)
            np.add.at(total, near, rest)
            centres[count > 0] = total[count > 0] / count[count > 0, None]
        near = ((centres**2).sum(1) - 2 * rest @ centres.T).argmin(axis=1)
        rest = rest - centres[near]
        trained.append(centres)
    return Codebooks(np.stack(trained), beam)


def fit(vectors: DataFrame, *, vector: str = "embedding", sample_rows: int = 8192, **settings) -> Codebooks | None:
    """Codebooks for the directions of at most `sample_rows` distinct vectors, by hash; None if no vector is usable.

    Copies are merged before the sample is cut, so that no number of them displaces another vector. The dimension is the
    commonest in the sample; a codebook for each 128 vectors of it, 8 at least and 32 at most. Only the sample reaches
    the driver.
    """
    return _fit_distinct(vectors.where(usable(vector)).select(F.col(vector).alias("x")).distinct(), sample_rows, **settings)


def _fit_distinct(distinct: DataFrame, sample_rows: int = 8192, **settings) -> Codebooks | None:
    """`fit` for usable vectors `x` of which none occurs twice."""
    picked = distinct.select("x", F.xxhash64("x").alias("h")).orderBy("h").limit(sample_rows).toPandas()
    if not len(picked):
        return None
    sizes = picked["x"].map(len)
    sample = np.stack(picked["x"][sizes == int(sizes.mode().min())].to_numpy()).astype(np.float64)
    return train(units(sample), **{"books": min(32, max(8, len(sample) // 128))} | settings)


def index(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """(rep, x, codes, norm, off) of every row of `vectors` (rep, x).

    off is the distance between the vector's direction and the decoded one.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(1))
                directions = units(x)
                codes = books.encode(directions)
                off = np.linalg.norm(directions - books.decode(codes), axis=1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(_norms(x)), pa.array(off)], names=["rep", "x", "codes", "norm", "off"])

    return vectors.select("rep", "x").mapInArrow(encode, f"rep long, x {vectors.schema['x'].dataType.simpleString()}, codes binary, norm double, off double")


def _norms(x: np.ndarray) -> np.ndarray:
    most = np.abs(x).max(axis=1, initial=0.0)
    return most * np.linalg.norm(x / np.where(most > 0, most, 1.0)[:, None], axis=1)


def candidates(
    indexed: DataFrame, queries: DataFrame, books: Codebooks, *, k: int, pool: int = 128, candidate_rows: int = 65536, query_rows: int = 16384
) -> DataFrame:
    """(query, rep, score): for each of `queries` (query, x) the k nearest of the index.

    Queries and index are dealt by a hash into units, and each pair of units is a group of its own. A group scores the
    `pool` best sums of a query on their vectors, and then all whose sum and bound reach the k-th of these; its k
    nearest meet those of the other groups in a ranking that is cut off map-side.
    """
    there, asked = (max(1, -(-df.count() // rows)) for df, rows in ((indexed, candidate_rows), (queries, query_rows)))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    unit = lambda name, n: F.pmod(F.xxhash64(name), F.lit(n)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    x = F.col("x").cast("array<double>").alias("x")
    left = indexed.select("rep", "codes", "norm", "off", x, unit("rep", there).alias("c"), numbers(asked).alias("q"))
    right = queries.select(F.col("query").alias("rep"), none("binary").alias("codes"), none("double").alias("norm"), none("double").alias("off"), x, numbers(there).alias("c"), unit("query", asked).alias("q"))

    def score(group: pa.Table) -> pa.Table:
        asks = group.column("codes").combine_chunks().is_null().to_numpy(zero_copy_only=False)
        names = group.column("rep").to_numpy()
        these, those = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if len(these) and len(those):
            vectors = matrix(group.column("x"))
            queries, x = vectors[these], vectors[those]
            codes = np.frombuffer(b"".join(group.column("codes").take(pa.array(those)).to_pylist()), np.uint8).reshape(len(those), -1)
            norm, off = (group.column(c).to_numpy()[those] for c in ("norm", "off"))
            for at in range(0, len(these), 64):
                found += _k_best(books, queries[at : at + 64], names[these[at : at + 64]], x, codes, norm, off, names[those], pool, k)
        columns = [np.concatenate(c) for c in zip(*found, strict=True)] if found else [[], [], []]
        return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query", "rep", "score"])

    found = left.unionByName(right).groupBy("c", "q").applyInArrow(score, "query long, rep long, score double")
    return _first(found, k, "query", F.desc("score"), "rep").drop("rank")


def _k_best(books: Codebooks, queries: np.ndarray, asking: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, off: np.ndarray, names: np.ndarray, pool: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each query its name, and the names and inner products of the k nearest rows, ties to the smaller name.

    Until the end all products are those of the query's direction, divided by the largest norm, so that none overflows.
    """
    directions, most = units(queries), norm.max()
    length, scaled = norm / most, x / most
    rough = _roughly(books, directions, codes) * length
    size, k = min(max(pool, k), len(x)), min(k, len(x))
    near = np.argpartition(-rough, size - 1, axis=1)[:, :size]
    first = np.stack([scaled[these] @ q for these, q in zip(near, directions, strict=True)])
    least = np.partition(first, size - k, axis=1)[:, size - k]
    slack = 1e-14 * x.shape[1]  # of products in double precision, whatever the order of their terms
    open_ = rough + length * (off + books.rounding) >= (least - slack)[:, None]
    rows = np.flatnonzero(open_.any(axis=0))
    product = np.where(open_[:, rows], directions @ scaled[rows].T, -np.inf)
    least = np.partition(product, len(rows) - k, axis=1)[:, len(rows) - k]
    for name, q, ranked, bar in zip(asking, queries, product, least, strict=True):
        chosen = rows[ranked >= bar - 2 * slack]
        # Component by component in order, so that equal products get equal scores.
        exact = np.zeros(len(chosen))
        for component, value in zip(x[chosen].T, q, strict=True):
            exact += component * value
        order = np.lexsort((names[chosen], -exact))[:k]
        yield np.full(len(order), name), names[chosen[order]], exact[order]


def _roughly(books: Codebooks, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """(queries, rows): sums of the entries of the queries' tables of inner products."""
    table = books.table(queries)
    rough = np.zeros((len(codes), len(queries)), np.float32)
    for at in range(0, len(codes), 2048):  # small enough to stay in cache
        part = rough[at : at + 2048]
        for m in range(len(table)):
            part += table[m][codes[at : at + 2048, m]]
    return np.ascontiguousarray(rough.T)


def _first(rows: DataFrame, n: int, by: str, *order: Column | str) -> DataFrame:
    """The first n rows of each `by`, with their `rank`."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= n)


def nearest(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 20, pool: int = 128, books: Codebooks | None = None, **settings) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest of each row for which `is_query`, an expression of column `k`, holds.

    Nearness is the inner product in double precision, ties go to the smaller key, and a row is no neighbour of its own.
    Rows whose vector is null, empty, zero, or holds a null or non-finite component, and rows of another dimension or
    with a null key, take no part; no usable vector, as in an empty table, gives no rows. Keys are integers; repeated
    rows are a candidate each and one query, rows of one key and unlike vectors a query each. Other columns, whatever their names, are left out.

    The index holds each distinct vector once, named by its smallest key, so that no number of copies displaces another
    vector; copies are put back behind the exact scores, the k + 1 smallest keys of each. Whatever the vectors, the
    answer is exact: `pool` decides only how many are scored before the bounds are.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).alias("x")).where(usable("x") & F.col("k").isNotNull())
    distinct = materialize(rows.groupBy("x").agg(F.min("k").alias("rep")), "distinct")
    books = books or _fit_distinct(distinct)
    if books is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    distinct = distinct.where(F.size("x") == books.dimension)
    # Both sides are plain exchanges, so that a hot vector can be split; from here on rows go by the name of their vector.
    named = materialize(rows.select("k", "x", is_query.alias("asks")).join(distinct, "x").select("k", "rep", "asks"), "named")
    asked = materialize(named.where("asks").select(F.col("k").alias("query_id"), F.col("rep").alias("query")).distinct(), "asked")
    queries = distinct.join(asked.select(F.col("query").alias("rep")).distinct(), "rep", "left_semi").select(F.col("rep").alias("query"), "x")
    best = candidates(materialize(index(distinct, books), "index"), queries, books, k=k + 1, pool=pool, **settings)  # one may be the query itself
    copies = _first(named.select("rep", "k"), k + 1, "rep", "k").drop("rank")
    best = _first(best.join(copies, "rep"), k + 1, "query", F.desc("score"), "k").select("query", F.col("k").alias("vec_id"), "score")
    answers = asked.join(materialize(best, "best"), "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id"))
    return answers.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
