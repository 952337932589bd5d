"""Ingestion: recency, thresholds, exact deduplication and the counts of a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodewell.functions.names import fresh
from lodewell.functions.text import strip
from lodewell.sources.tables import discard, materialize


def recent(df: DataFrame, anchor: Column, hours: int, *, when: str = "published_at") -> DataFrame:
    """Rows at most `hours` older than the anchor; undated rows stay."""
    return df.where(F.col(when).isNull() | (F.col(when) >= anchor - F.make_interval(hours=F.lit(hours))))


def above(df: DataFrame, custom: float | None = None, *, default: float = 5.0, score: str = "total_score") -> DataFrame:
    """Rows that reach both the default threshold and the custom one; a custom 0 counts as unset, a null score as 0."""
    threshold = max(default, custom or default)
    return df.where(F.coalesce(F.col(score), F.lit(0.0)) >= threshold)


# The fewest characters, stripped, of a text that is cut into chunks when it is stored, and when chunks are
# made afterwards.
CHUNKED_WHEN_STORED, CHUNKED_AFTERWARDS = 101, 100


def long_enough(text: Column, *, afterwards: bool = False) -> Column:
    """Whether a text is cut into chunks; null counts as empty."""
    return F.length(strip(F.coalesce(text, F.lit("")))) >= (CHUNKED_AFTERWARDS if afterwards else CHUNKED_WHEN_STORED)


def known_urls(df: DataFrame, stored: DataFrame, *, url: str = "source_url") -> DataFrame:
    """`df` with `known`: whether its URL is among those stored; a null URL is not."""
    there = stored.where(F.col(url).isNotNull()).select(F.col(url).alias("_url")).distinct()
    return df.join(there, F.col(url) == F.col("_url"), "left").withColumn("known", F.col("_url").isNotNull()).drop("_url")


def first_seen(df: DataFrame, *, order: str, content: str, url: str, stored: DataFrame | None = None) -> DataFrame:
    """Greedy exact deduplication in the order of `order`: a row goes if its content or its URL was already kept, or
    its URL is in `stored`; rows that went block no others.

    Set-based: rows of a stored URL first, by anti join. A row that is first by content and by URL is certainly kept,
    and certainly blocks the others of its content and URL; rounds repeat this on what is undecided until nothing is,
    which takes as many rounds as the longest chain of rows that alternately share a content and a URL. Firsts are
    minima, which combine map-side, so that a content of very many rows is never in one task. Such a chain has at most as many rows as
    there are contents and URLs that each stand in two of them, so that rounds are few unless a feed is made to defeat
    them. The table of a round is deleted after the next one's is written; what was kept stays. A null content or URL
    equals no other. `order` is unique and not null.
    """
    if stored is not None:
        df = df.join(stored.select(F.col(url)).distinct(), url, "left_anti")
    left, kept = materialize(df.select(order, content, url), "undecided"), None
    undecided = left
    while True:
        sure = left
        for c in (content, url):
            firsts = left.where(F.col(c).isNotNull()).groupBy(c).agg(F.min(order).alias(order)).select(order)
            sure = sure.join(firsts.union(left.where(F.col(c).isNull()).select(order)), order, "left_semi")
        sure = materialize(sure, "kept")
        kept = sure if kept is None else kept.unionByName(sure)
        left = left.join(sure.select(order), order, "left_anti").join(sure.select(content), content, "left_anti").join(sure.select(url), url, "left_anti")
        before, left = undecided, materialize(left, "undecided")
        undecided = left
        discard(before)
        if left.isEmpty():
            return df.join(kept.select(order), order, "left_semi")


def funnel(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(stage, n) of each stage, in one job."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(name).alias("stage"), "n") for i, (name, df) in enumerate(stages)]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def split_by(df: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one under `error`."""
    name = fresh(df, "error")
    marked = df.withColumn(name, error)
    return marked.where(F.col(name).isNull()).drop(name), marked.where(F.col(name).isNotNull())


def run_status(errors: Column) -> Column:
    """The status of a run with so many errors."""
    return F.when(F.coalesce(errors, F.lit(0)) == 0, "completed").otherwise("completed_with_errors")


def backfill_status(text: Column) -> Column:
    """What cutting a text into chunks afterwards comes to: there is none (error), it is too short (skipped), or success."""
    return F.when(F.coalesce(text, F.lit("")) == "", "error").when(~long_enough(text, afterwards=True), "skipped").otherwise("success")
