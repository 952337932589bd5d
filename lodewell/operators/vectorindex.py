"""Vector search over a stored index of coarse lists.

Vectors lie in a folder for each list, that of the centroid nearest by angle. A search opens the lists that are probed and
no other. With the angle between a list's centroid and its farthest member, the triangle inequality bounds
the similarity of all its members to a query: an exact search opens lists until no bound reaches the k-th similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from lodewell.functions.vectors import cosine, literal, usable

LISTS = 100  # fixed value: how many lists an index has unless told otherwise
_SLACK = 1e-6  # of an angle


def _units(vectors) -> np.ndarray:
    """Rows of length 1; squares neither overflow nor vanish."""
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def _centroids(x: np.ndarray, lists: int, rounds: int = 10, seed: int = 7) -> np.ndarray:
    """Directions of k-means by angle; a list without members keeps its direction."""
    centres = x[np.random.default_rng(seed).choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(rounds):
        near = (x @ centres.T).argmax(axis=1)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres)
    return centres


@dataclass(frozen=True)
class VectorIndex:
    """An index below `path`, with the centroids of its lists; `probes` is how many lists a query opens by default."""

    spark: SparkSession
    path: str
    key_type: str
    probes: int
    centroids: np.ndarray = field(repr=False)

    @staticmethod
    def open(spark: SparkSession, path: str) -> VectorIndex:
        """The index that `build` wrote."""
        meta = spark.read.parquet(f"{path}/meta").first()
        rows = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()
        return VectorIndex(spark, path, meta["key_type"], meta["probes"], np.array([r["x"] for r in rows], np.float64) if rows else np.zeros((0, 0)))

    def vectors(self) -> DataFrame:
        """(key, x, list)."""
        return self.spark.read.schema(f"key {self.key_type}, x array<double>, list int").parquet(f"{self.path}/vectors")

    def lists(self) -> DataFrame:
        """(list, n, widest): the members of each list, and the largest angle of one to its centroid."""
        added = self.spark.read.schema("list int, n long, widest double").parquet(f"{self.path}/lists")
        return added.groupBy("list").agg(F.sum("n").alias("n"), F.max("widest").alias("widest"))

    def add(self, vectors: DataFrame, *, key: str, vector: str) -> None:
        """Vectors put into the index beside those there are; centroids stay.

        Vectors that are null, empty or zero, of another dimension, or that hold a null or non-finite component are left out.
        """
        if not len(self.centroids):
            return
        sent = self.spark.sparkContext.broadcast(self.centroids)
        rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x")).where(usable(F.col("x")) & (F.size("x") == self.centroids.shape[1]))

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    angles = _angles(_units(batch.column(1).to_pylist()), sent.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(angles.argmin(axis=1), pa.int32()), pa.array(angles.min(axis=1))], names=["key", "x", "list", "angle"])

        dealt = rows.mapInArrow(assign, f"key {self.key_type}, x array<double>, list int, angle double")
        # A list of any size is split into files of an even size.
        dealt.hint("rebalance", "list").select("key", "x", "list").write.mode("append").partitionBy("list").parquet(f"{self.path}/vectors")
        dealt.groupBy("list").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).write.mode("append").parquet(f"{self.path}/lists")

    def _near(self, query) -> tuple[np.ndarray, np.ndarray]:
        """(lists by angle to the query, the bound on the similarity of the members of each list; -2 for those without)."""
        angles = _angles(_units([query]), self.centroids)[0]
        widest = np.full(len(angles), -np.inf)
        for r in self.lists().collect():  # a row for each list
            widest[r["list"]] = r["widest"]
        bound = np.where(np.isinf(widest), -2.0, np.cos(np.clip(angles - widest - _SLACK, 0.0, np.pi)))
        return angles.argsort(kind="stable"), bound

    def search(self, query, k: int, *, threshold: float | None = None, exclude=(), exact: bool = True, probes: int | None = None, name: str = "id") -> DataFrame:
        """(name, similarity): the k nearest by cosine, of at least `threshold`, ties to the smaller key.

        Of an exact search the first `probes` lists give a k-th similarity, and every list whose bound reaches it, or the
        threshold, is opened too; otherwise these lists are all. A query without direction finds nothing.
        """
        query = np.asarray([np.nan if v is None else v for v in query], np.float64)
        none = self.spark.createDataFrame([], f"{name} {self.key_type}, similarity double")
        if not len(self.centroids) or len(query) != self.centroids.shape[1] or not np.isfinite(query).all() or not query.any():
            return none
        order, bound = self._near(query)
        first = [int(c) for c in order if bound[c] > -2][: probes or self.probes]

        def best(lists: list[int]) -> DataFrame:
            rows = self.vectors().where(F.col("list").isin(lists))
            rows = rows.where(~F.col("key").isin(list(exclude))) if len(exclude) else rows
            rows = rows.select(F.col("key").alias(name), cosine(F.col("x"), literal(query)).alias("similarity"))
            return (rows if threshold is None else rows.where(F.col("similarity") >= threshold)).orderBy(F.desc("similarity"), name).limit(k)

        if not first:
            return none
        if not exact:
            return best(first)
        found = best(first).collect()
        least = max(found[-1]["similarity"] if len(found) == k else -1.0, -1.0 if threshold is None else threshold)
        more = [int(c) for c in order if bound[c] >= least and int(c) not in first]
        return best(first + more)

    def search_all(self, queries: DataFrame, k: int, *, key: str, vector: str, probes: int | None = None, unit_rows: int = 16384) -> DataFrame:
        """(query, rank, match, similarity): the k nearest of each of `queries` (key, vector) among the lists it probes.

        Queries go to the lists they probe; a large list is dealt in units, and each unit compares its members with its queries
        in one product. A member with the query's own key is no match. Queries without a usable vector find nothing.
        """
        return self._found(queries, k, key=key, vector=vector, probes=probes, unit_rows=unit_rows).select("query", "rank", "match", "similarity")

    def _found(self, queries: DataFrame, k: int, *, key: str, vector: str, probes: int | None = None, unit_rows: int = 16384) -> DataFrame:
        """As `search_all`, with the list that the match lies in."""
        kind = queries.schema[key].dataType.simpleString()
        if not len(self.centroids):
            return self.spark.createDataFrame([], f"query {kind}, rank int, match {self.key_type}, similarity double, list int")
        n, sizes = probes or self.probes, {r["list"]: r["n"] for r in self.lists().collect()}
        units = [max(1, -(-sizes.get(c, 0) // unit_rows)) for c in range(len(self.centroids))]
        sent, out = self.spark.sparkContext.broadcast(self.centroids), f"query {kind}, match {self.key_type}, similarity double, list int"
        asked = queries.select(F.col(key).alias("query"), F.col(vector).cast("array<double>").alias("x")).where(usable(F.col("x")) & (F.size("x") == self.centroids.shape[1]))

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    near = _angles(_units(batch.column(1).to_pylist()), sent.value).argsort(axis=1, kind="stable")[:, :n]
                    pairs = [(i, int(c), u) for i, row in enumerate(near) for c in row for u in range(units[c])]
                    at = pa.array([p[0] for p in pairs])
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array([p[1] for p in pairs], pa.int32()), pa.array([p[2] for p in pairs], pa.int32())], names=["query", "x", "list", "unit"])

        ways = F.element_at(F.array(*map(F.lit, units)), F.col("list") + 1)
        members = self.vectors().withColumn("unit", F.pmod(F.xxhash64("key"), ways).cast("int"))
        routed = asked.mapInArrow(route, f"query {kind}, x array<double>, list int, unit int")

        def compare(these: pd.DataFrame, those: pd.DataFrame) -> pd.DataFrame:
            found = []
            if len(these) and len(those):
                those = those.sort_values("key")
                keys, y = those["key"].to_numpy(), _units(those["x"])
                for at in range(0, len(these), 256):
                    part = these.iloc[at : at + 256]
                    x = _units(part["x"])
                    for query, one, cos in zip(part["query"], x, x @ y.T, strict=True):
                        cos[keys == query] = -np.inf
                        # Products of blocks are rounded by their shape: what is near the k-th is multiplied one by one.
                        least = np.partition(cos, -k)[-k] - 1e-9 if len(cos) > k else -2.0
                        near = np.flatnonzero(cos >= max(least, -2.0))
                        score = (y[near] * one).sum(axis=1)
                        best = np.argsort(-score, kind="stable")[:k]
                        found.append((np.full(len(best), query), keys[near[best]], score[best]))
            query, match, similarity = map(np.concatenate, zip(*found, strict=True)) if found else ([], [], [])
            return pd.DataFrame({"query": query, "match": match, "similarity": similarity, "list": those["list"].iloc[0] if found else []})

        found = routed.groupBy("list", "unit").cogroup(members.groupBy("list", "unit")).applyInPandas(compare, out)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "match"))
        return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "match", "similarity", "list")


def build(
    vectors: DataFrame, path: str, *, key: str, vector: str, lists: int = LISTS, sample_rows: int = 32768, recall: float = 0.95, k: int = 10, trial_rows: int = 200
) -> VectorIndex:
    """An index of `vectors` (key, vector), written below `path`, where nothing is yet. Keys are unique.

    The centroids are fitted on at most `sample_rows` distinct vectors, by hash, of the commonest dimension there. How many
    lists a query probes is measured: at most `trial_rows` vectors, by hash, are compared with all others, and as
    many lists are probed as hold the share `recall` of their k nearest.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).alias("key"), F.col(vector).cast("array<double>").alias("x")).where(usable(F.col("x")))
    hashed = rows.select("x", F.xxhash64("x").alias("h"))
    share = min(1.0, 4 * sample_rows / max(1, rows.count()))
    picked = hashed.where(F.pmod("h", F.lit(1 << 20)) < int(share * (1 << 20))).distinct().orderBy("h").limit(sample_rows).select("x").toPandas()["x"]
    dimension = int(picked.map(len).mode().min()) if len(picked) else 0
    sample = _units(picked[picked.map(len) == dimension]) if dimension else np.zeros((0, 0))
    centroids = _centroids(sample, lists) if dimension else sample
    kind = vectors.schema[key].dataType.simpleString()
    index = VectorIndex(spark, path, kind, max(1, len(centroids)), centroids)
    index.add(vectors, key=key, vector=vector)
    if len(centroids):
        # With all lists probed the search is exact, and tells in which list by rank the nearest of a query lie.
        trial = index.vectors().orderBy(F.xxhash64("x"), "key").limit(trial_rows)
        where = index._found(trial, k, key="key", vector="x", probes=len(centroids)).select("query", "list").toPandas()
        asked = {r["key"]: r["x"] for r in trial.collect()}
        ranks = []
        for query, group in where.groupby("query"):
            place = _angles(_units([asked[query]]), centroids)[0].argsort(kind="stable").argsort()
            ranks += place[group["list"].to_numpy()].tolist()
        probes = int(np.quantile(ranks, recall, method="higher")) + 1 if ranks else 1
        index = VectorIndex(spark, path, kind, probes, centroids)
    spark.createDataFrame([(i, [float(v) for v in c]) for i, c in enumerate(centroids)], "list int, x array<double>").coalesce(1).write.parquet(f"{path}/centroids")
    spark.createDataFrame([(kind, index.probes)], "key_type string, probes int").coalesce(1).write.parquet(f"{path}/meta")
    return index
