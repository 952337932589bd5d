"""The nearest stored vector of each new one, from a similarity on."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodewell.functions.vectors import usable
from lodewell.operators.vectorindex import _SLACK, _angles, _centroids, _units
from lodewell.sources.tables import materialize


_ROWS = 256  # fixed value: of a batch worked on at once, and 16 times as many of one that is sent on


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, _ROWS):
            yield batch.slice(at, _ROWS)


def _by_length(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(length, positions, unit vectors) of the rows of a batch, length by length."""
    places = defaultdict(list)
    values = batch.column(column).to_pylist()
    for i, v in enumerate(values):
        places[len(v)].append(i)
    for d, at in places.items():
        yield d, pa.array(at, pa.int64()), _units([values[i] for i in at])


def best_matches(new: DataFrame, stored: DataFrame, *, threshold: float = 0.85, key: str = "id", vector: str = "embedding", block_rows: int = 4096, sample_rows: int = 8192) -> DataFrame:
    """(key, match, similarity): for each new vector the nearest stored one with a cosine of at least `threshold`.

    Vectors of one length are compared; null, empty and zero ones and those with a null or non-finite component match
    nothing. Stored vectors go to the nearest of the centroids fitted on a sample of theirs, one for each quarter of a
    block. A new vector visits the lists whose members, by the triangle inequality, can be within the threshold,
    and no other. Lists and their visitors are dealt in units by hash, and each pair of units is one matrix product in a group of
    its own; of a unit the best match comes back, and `max_by` picks among units. Nothing that grows with either side but a
    row for each list is broadcast or collected. Ties go to the smaller key.
    """
    kind = new.schema[key].dataType.simpleString()
    some = lambda df: df.select(F.col(key).alias("k"), F.col(vector).cast("array<double>").alias("x")).where(usable(F.col("x")))
    known, fresh = some(stored), some(new)
    n, asked = known.count(), fresh.count()
    picked = known.orderBy(F.xxhash64("x"), "k").limit(sample_rows).toPandas()["x"]
    cents: dict[int, np.ndarray] = {}
    for d in sorted(set(picked.map(len))):
        own = picked[picked.map(len) == d]
        cents[d] = _centroids(_units(own), max(1, min(1024, round(4 * n / block_rows * len(own) / len(picked)))))
    sent = new.sparkSession.sparkContext.broadcast(cents)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            for d, at, x in _by_length(batch, 1):
                angles = _angles(x, sent.value[d]) if d in sent.value else np.full((len(x), 1), np.pi)  # a length that the sample lacks
                yield pa.RecordBatch.from_arrays([*batch.take(at).columns, pa.array(np.full(len(x), d), pa.int32()), pa.array(angles.argmin(axis=1), pa.int32()), pa.array(angles.min(axis=1))], names=["k", "x", "d", "list", "angle"])

    members = materialize(known.mapInArrow(assign, f"k {kind}, x array<double>, d int, list int, angle double"), "members")
    lists = members.groupBy("d", "list").agg(F.count("*").alias("n"), F.max("angle").alias("widest")).collect()  # a row for each list
    widest, units = defaultdict(dict), {}
    for r in lists:
        widest[r["d"]][r["list"]] = r["widest"]
        units[r["d"], r["list"]] = -(-r["n"] // block_rows)
    parts = max(1, -(-asked // block_rows))
    reach = np.arccos(np.clip(threshold, -1.0, 1.0)) + _SLACK

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _sliced(batches):
            for d, at, x in _by_length(batch, 1):
                if d not in widest:
                    continue
                angles = _angles(x, sent.value[d]) if d in sent.value else np.zeros((len(x), 1))
                pairs = [(i, c, u) for c, wide in widest[d].items() for i in np.flatnonzero(angles[:, c] <= wide + reach).tolist() for u in range(units[d, c])]
                own = batch.take(at)
                for begin in range(0, len(pairs), 16 * _ROWS):  # a vector may visit every list
                    some = pairs[begin : begin + 16 * _ROWS]
                    rows = own.take(pa.array([p[0] for p in some], pa.int64()))
                    yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([d] * len(some), pa.int32()), *(pa.array([p[j] for p in some], pa.int32()) for j in (1, 2))], names=["k", "x", "d", "list", "unit"])

    part = F.pmod(F.xxhash64("k"), F.lit(parts)).cast("int").alias("part")
    visitors = fresh.mapInArrow(visit, f"k {kind}, x array<double>, d int, list int, unit int").select("*", part)
    ways = F.create_map(*(F.lit(v) for (d, c), u in units.items() for v in (d * 1024 + c, u))) if units else F.create_map().cast("map<int,int>")
    unit = F.pmod(F.xxhash64("k"), F.try_element_at(ways, F.col("d") * 1024 + F.col("list"))).cast("int").alias("unit")
    dealt = members.select("k", "x", "d", "list", unit, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))

    def match(those: pd.DataFrame, these: pd.DataFrame) -> pd.DataFrame:
        if not len(these) or not len(those):
            return pd.DataFrame({"k": [], "match": [], "similarity": []})
        these = these.sort_values("k")
        cos = _units(those["x"]) @ _units(these["x"]).T
        best = cos.argmax(axis=1)
        return pd.DataFrame({"k": those["k"].to_numpy(), "match": these["k"].to_numpy()[best], "similarity": cos[np.arange(len(cos)), best]})

    by = ["d", "list", "unit", "part"]
    found = visitors.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(match, f"k {kind}, match {kind}, similarity double")
    found = found.where(F.col("similarity") >= threshold)
    best = found.groupBy("k").agg(F.max("similarity").alias("similarity"), F.max_by(F.struct("match"), F.struct("similarity", -F.col("match"))).alias("m"))
    return best.select(F.col("k").alias(key), F.col("m.match").alias("match"), "similarity")
