"""Memories of conversations as a stream: keyed state that expires, merged as the batch operator does."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_COLUMNS = ["content", "turn", "version", "first_ms", "last_ms"]


class Memories(StatefulProcessor):
    """The generations of one conversation and kind of memory that have not expired."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getListState("generations", "content string, turn long, version long, first_ms long, last_ms long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        kept = [tuple(g) for g in self.state.get()]
        changed, merged = [], []
        for frame in rows:
            for content, turn, at in zip(frame["content"], frame["turn"], frame["at_ms"], strict=True):
                one = (content, int(turn), 1, int(at), int(at))
                near = [g for g in kept if g[3] <= one[4] + self.ttl_ms and one[3] <= g[4] + self.ttl_ms]
                union = self._union([one, *near])
                merged += [g for g in near if g[3] != union[3]]
                kept = [g for g in kept if g not in near] + [union]
                changed = [g for g in changed if g not in near] + [union]
        self.state.put(kept) if kept else self.state.clear()
        for g in changed:
            self.handle.registerTimer(g[4] + self.ttl_ms + 1)  # what is set when the time is just up still counts
        yield self._frame(key, [(g, "merged") for g in merged] + [(g, "live") for g in changed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        kept = [tuple(g) for g in self.state.get()]
        gone = [g for g in kept if g[4] + self.ttl_ms < now]
        rest = [g for g in kept if g not in gone]
        self.state.put(rest) if rest else self.state.clear()
        yield self._frame(key, [(g, "expired") for g in gone])

    @staticmethod
    def _union(parts: list[tuple]) -> tuple:
        """One generation of several: the content of the latest event, all versions, the whole time."""
        content, turn, *_ = max(parts, key=lambda g: (g[4], g[1]))
        return content, turn, sum(g[2] for g in parts), min(g[3] for g in parts), max(g[4] for g in parts)

    @staticmethod
    def _frame(key, rows: list[tuple]) -> pd.DataFrame:
        frame = pd.DataFrame([(*key, *g, status) for g, status in rows], columns=["key", "memory_type", *_COLUMNS, "status"])
        return frame.astype({c: "int64" for c in _COLUMNS[1:]})


def memories(events: DataFrame, ttl: str, late: str, *, key: str = "conv_id") -> DataFrame:
    """What becomes of memories, as a log for `current`: a row whenever one is set, expires, or becomes part of another.

    `events` is a stream of (key, memory_type, content, at, turn); `generations` says what they come to. Events later than
    `late` behind the latest one change nothing. State holds the generations that can still change, and goes when
    the watermark has passed the end of their `ttl`. The state store must be RocksDB's, as any store of this kind of
    state; the session's setting is left to the caller.
    """
    spark = events.sparkSession
    if spark.conf.get(_STORE, "") != ROCKS:
        raise ValueError(f"set {_STORE} to {ROCKS}")
    ttl_ms = spark.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {ttl})").first()[0]
    told = events.where((F.coalesce("content", F.lit("")) != "") & F.col("at").isNotNull()).withWatermark("at", late)
    rows = told.select(F.col(key).alias("key"), "memory_type", "content", F.col("turn").cast("long").alias("turn"), F.unix_millis("at").alias("at_ms"), "at")
    kind = events.schema[key].dataType.simpleString()
    schema = f"key {kind}, memory_type string, content string, turn long, version long, first_ms long, last_ms long, status string"
    out = rows.groupBy("key", "memory_type").transformWithStateInPandas(Memories(ttl_ms), schema, "Append", "EventTime")
    at = lambda name: F.timestamp_millis(name)
    return out.select(F.col("key").alias(key), "memory_type", "content", "version", at("first_ms").alias("first_at"), at("last_ms").alias("last_at"), "status")


def current(log: DataFrame, *, key: str = "conv_id") -> DataFrame:
    """The rows of `generations`, from all that `memories` has written."""
    stage = F.when(F.col("status") == "live", 0).when(F.col("status") == "merged", 1).otherwise(2)
    order: list[Column] = [F.desc("version"), F.desc(stage)]
    last = F.row_number().over(Window.partitionBy(key, "memory_type", "first_at").orderBy(*order))
    return log.withColumn("n", last).where((F.col("n") == 1) & (F.col("status") != "merged")).drop("n")
