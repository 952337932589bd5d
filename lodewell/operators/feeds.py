"""The table of feeds: url, name, is_active."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def created(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """Feeds with those asked for, but for urls that are stored already; of one url asked for twice the smallest name."""
    new = asked.groupBy("url").agg(F.min_by(F.struct("name", "is_active"), F.struct("name", "is_active")).alias("f"))
    new = new.join(stored.select("url"), "url", "left_anti").select("url", "f.name", "f.is_active")
    return stored.select("url", "name", "is_active").unionByName(new)


def rejected(stored: DataFrame, asked: DataFrame) -> DataFrame:
    """The feeds asked for whose url is stored already."""
    return asked.join(stored.select("url"), "url", "left_semi")


def toggled(stored: DataFrame, urls: DataFrame) -> DataFrame:
    """Feeds in which those of `urls` are active if they were not, and the other way round; unknown urls change nothing."""
    hit = urls.select("url").distinct().withColumn("_hit", F.lit(True))
    active = F.when(F.col("_hit"), ~F.col("is_active")).otherwise(F.col("is_active"))
    return stored.join(hit, "url", "left").select("url", "name", active.alias("is_active"))


def listed(stored: DataFrame, *, active_only: bool = True) -> DataFrame:
    """Feeds by name, by default the active ones."""
    return (stored.where("is_active") if active_only else stored).orderBy("name", "url")
