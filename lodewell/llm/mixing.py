"""Mixing sources to target weights by Pfair scheduling.

Think of all sources as flowing at once: at every moment each source that is not yet used up gets a share of the slot in
proportion to its target weight. Block k of a source flows between the moments when k and k + 1 of its blocks have
flowed; it is released at the first moment rounded down, and due by the second rounded up. Slots go to the released
block with the earliest deadline. The flow fills every slot exactly, so every deadline is met, no slot is empty, and
after any number of slots each source is less than one block from its target. A source that has run out leaves the flow,
and the others go on in the proportion of their weights.

All moments are fractions of whole numbers, so weights are never rounded. The schedule needs no common start: which
blocks are done at a moment depends only on what has been released since the earliest release among the blocks in
progress then. Tasks therefore schedule stretches of slots independently, each with such a lead, and agree exactly.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from fractions import Fraction
from functools import cached_property
from itertools import islice
from math import gcd, lcm

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import AtomicType

from lodewell.functions.names import fresh
from lodewell.sources.tables import materialize

_BATCH = 1 << 16


def whole_weights(weights: Mapping[str, float]) -> dict[str, int]:
    """Whole numbers in exactly the proportion of the positive weights, by name; a float stands for its exact value."""
    exact = {s: Fraction(w) for s, w in sorted(weights.items()) if w is not None and w > 0}
    scale = lcm(*(w.denominator for w in exact.values())) if exact else 1
    whole = {s: int(w * scale) for s, w in exact.items()}
    common = gcd(*whole.values()) or 1
    return {s: w // common for s, w in whole.items()}


@dataclass(frozen=True)
class Course:
    """The flow of sources with whole `weights` and so many `blocks` each, and its schedule."""

    weights: tuple[int, ...]
    blocks: tuple[int, ...]

    @cached_property
    def phases(self) -> list[tuple[int, int, int, int]]:
        """(source, blocks, done, active) in the order in which sources run out: until this source does, the moment at
        which everyone has had v blocks per unit of weight is done + active * v."""
        order = sorted((i for i, n in enumerate(self.blocks) if n), key=lambda i: (Fraction(self.blocks[i], self.weights[i]), i))
        done, active, out = 0, sum(self.weights[i] for i in order), []
        for i in order:
            out.append((i, self.blocks[i], done, active))
            done, active = done + self.blocks[i], active - self.weights[i]
        return out

    @property
    def slots(self) -> int:
        return sum(self.blocks)

    @property
    def longest(self) -> int:
        """No block is in progress for more slots than this."""
        some = [self.weights[i] for i, *_ in self.phases]
        return sum(some) // min(some) + 2 if some else 0

    def moment(self, i: int, k: int, phase: int = 0) -> tuple[int, int, int]:
        """When k blocks of source i have flowed, rounded down and up, and the phase in which that is (not before `phase`)."""
        weight = self.weights[i]
        last, n, done, active = self.phases[phase]
        while k * self.weights[last] > n * weight:
            phase += 1
            last, n, done, active = self.phases[phase]
        whole, rest = divmod(active * k, weight)
        return done + whole, done + whole + (rest > 0), phase

    def flowed(self, slot: int) -> tuple[list[int], list[int]]:
        """How many whole blocks of each source have flowed by a slot, and the sources with a block in progress."""
        counts, busy, gone = list(self.blocks), [], 0
        for last, n, done, active in self.phases:
            if done * self.weights[last] + active * n >= slot * self.weights[last]:
                break
            gone += 1
        else:
            return counts, busy
        for i, *_ in self.phases[gone:]:
            counts[i], rest = divmod(self.weights[i] * (slot - done), active)
            if rest and counts[i] < self.blocks[i]:
                busy.append(i)
        return counts, busy

    def schedule(self, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, int, int, int]]:
        """(source, block, slot, release, deadline) of the slots from begin to end, as if scheduled from the first on.

        Ties between deadlines go to the source that comes first.
        """
        end = self.slots if end is None else min(end, self.slots)
        counts, _ = self.flowed(begin)
        start = min([begin, *(self.moment(i, k)[0] for i, k in enumerate(counts) if k < self.blocks[i])])
        counts, busy = self.flowed(start)
        # Which of the blocks in progress here are done makes no difference from `begin` on, only how many.
        for i in sorted(busy, key=lambda i: (self.moment(i, counts[i] + 1)[1], i))[: start - sum(counts)]:
            counts[i] += 1
        waiting = []
        for i, k in enumerate(counts):
            if k < self.blocks[i]:
                release, _, phase = self.moment(i, k)
                waiting.append((release, i, k, phase))
        heapq.heapify(waiting)
        ready: list[tuple[int, int, int, int, int, int]] = []
        for slot in range(start, end):
            while waiting and waiting[0][0] <= slot:
                release, i, k, phase = heapq.heappop(waiting)
                after, due, phase = self.moment(i, k + 1, phase)
                heapq.heappush(ready, (due, i, k, release, after, phase))
            due, i, k, release, after, phase = heapq.heappop(ready)
            if k + 1 < self.blocks[i]:
                heapq.heappush(waiting, (after, i, k + 1, phase))
            if slot >= begin:
                yield i, k, slot, release, due


def scheduled(spark, course: Course, task_slots: int = 1 << 18) -> DataFrame:
    """(i, block, slot, release, deadline) of every block of a course, in stretches of `task_slots` slots or of the
    longest time that a block is in progress, if that is more: a task's lead is no longer than its stretch."""
    stretch = max(task_slots, course.longest)
    tasks = max(1, -(-course.slots // stretch))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number in batch.column(0).to_pylist():
                rows = course.schedule(number * stretch, (number + 1) * stretch)
                while some := list(islice(rows, _BATCH)):
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*some, strict=True)], names=["i", "block", "slot", "release", "deadline"])

    return spark.range(0, tasks, 1, tasks).mapInArrow(run, "i long, block long, slot long, release long, deadline long")


def tempered_weights(docs: DataFrame, *, source: str = "source", power: float = 0.7) -> dict[str | None, float]:
    """Each source's row count to `power`: above 0 and below 1, small sources count for more than their size.

    One count per source reaches the driver; null is a source of its own, with key None. Sources of another type go by their
    strings, as in `interleave`. An empty table has no weights.
    """
    counts = docs.groupBy(F.col(source).cast("string")).count().collect()
    return {r[0]: float(r[1]) ** power for r in counts}


def _spread(rows: DataFrame, most: int) -> DataFrame:
    """`rows`, where a `hash` that stands in more than `most` of them differs from row to row.

    The counts combine map-side; there are fewer such hashes than rows / most, and Spark broadcasts them or not by their
    size. Their rows alone are written, with the number that tells them apart, so that a lost task finds the same one.
    """
    crowded = materialize(rows.groupBy("hash").count().where(F.col("count") > most).select("hash"), "crowded")
    if crowded.isEmpty():
        return rows
    numbered = materialize(rows.join(crowded, "hash", "left_semi").withColumn("number", F.monotonically_increasing_id()), "repeated")
    numbered = numbered.withColumn("hash", F.xxhash64("hash", "number")).drop("number")
    return rows.join(crowded, "hash", "left_anti").unionByName(numbered).select(*rows.columns)


def interleave(
    docs: DataFrame,
    weights: Mapping[str | None, float],
    *,
    source: str = "source",
    key: str = "doc_id",
    block_rows: int = 32,
    bucket_rows: int = 1024,
    task_slots: int = 1 << 18,
) -> DataFrame:
    """Every row of `docs`, with struct column `mix` (underscores in front if taken): block, slot, position, release, deadline, in_mix.

    Rows of a source are taken in the order of a hash and cut into blocks of `block_rows`; `slot` numbers the blocks of
    all sources, from 0 without gaps, and `position` the rows, skipping numbers only behind a source's last block if that
    is not full. After any number of slots every source is less than one block from what its weight, given exactly as a
    float, int or Fraction, entitles it to; a source that has run out leaves the mix and the others go on in proportion.
    in_mix is true for every row of a source with a positive weight. The key None of `weights` stands for a null source.
    Rows of sources with no weight have null `mix` fields and in_mix false. Nothing is repeated. No weights, or an
    empty table, mix nothing.

    The hash is of all columns of simple types, so that rows under one key, null included, spread; rows equal in all of
    them are ranked in arbitrary order, and where more than `bucket_rows` are, those are written once with a number that
    goes into their hash, so that they spread over all buckets. Texts of any length travel once. A source is numbered through hash buckets of
    about `bucket_rows` rows, so that no source is ever sorted in one task. One row per source reaches the driver; the
    blocks are scheduled by tasks and joined to the buckets.
    """
    spark = docs.sparkSession
    # A null source has the name "", the others start with "=".
    whole = whole_weights({"" if s is None else f"={s}": w for s, w in weights.items()})
    numbers = F.broadcast(spark.createDataFrame([(s, i) for i, s in enumerate(whole)], "source string, i long"))
    buckets = max(1, -(-docs.count() // bucket_rows))
    hashed = F.xxhash64(*(F.col(f.name) for f in docs.schema if isinstance(f.dataType, AtomicType) or f.name == key))
    named = F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))
    # The row travels as one struct, so that none of its columns can clash with those made here.
    rows = _spread(docs.select(F.struct("*").alias("row"), named.alias("source"), F.col(key).alias("key"), hashed.alias("hash")), bucket_rows)
    rows = rows.withColumn("bucket", F.floor(F.shiftrightunsigned("hash", 1) / F.lit(2.0**63) * buckets).cast("int")).join(numbers, "source", "left").drop("source")
    counts = rows.groupBy("i", "bucket").agg(F.count("*").alias("n"))
    running = F.sum("n").over(Window.partitionBy("i").orderBy("bucket")) - F.col("n")
    counts = materialize(counts.where("i IS NOT NULL").withColumn("before", running), "buckets")
    totals = dict(counts.groupBy("i").agg(F.sum("n").alias("n")).collect())
    course = Course(tuple(whole.values()), tuple(-(-totals.get(i, 0) // block_rows) for i in range(len(whole))))
    # Of each bucket the blocks that its rows are in: about bucket_rows / block_rows of them.
    first, last = F.floor(F.col("before") / block_rows), F.floor((F.col("before") + F.col("n") - 1) / block_rows)
    spans = counts.select("i", "bucket", "before", first.alias("first"), F.explode(F.sequence(first, last)).alias("block"))
    placed = spans.join(scheduled(spark, course, task_slots), ["i", "block"])
    placed = placed.groupBy("i", "bucket", "before", "first").agg(F.array_sort(F.collect_list(F.struct("block", "slot", "release", "deadline"))).alias("blocks"))

    rank = F.row_number().over(Window.partitionBy("i", "bucket").orderBy("hash", "key")) - 1
    mixed = rows.withColumn("rank", rank).join(materialize(placed, "blocks"), ["i", "bucket"], "left")
    mixed = mixed.withColumn("at", F.col("rank") + F.col("before"))
    mixed = mixed.withColumn("b", F.get("blocks", (F.floor(F.col("at") / block_rows) - F.col("first")).cast("int")))
    fields = F.struct(
        "b.block",
        "b.slot",
        (F.col("b.slot") * block_rows + F.col("at") % block_rows).alias("position"),
        "b.release",
        "b.deadline",
        F.col("b").isNotNull().alias("in_mix"),
    )
    return mixed.select("row.*", fields.alias(fresh(docs, "mix")))
