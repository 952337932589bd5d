"""Upserts and merges into stored tables, as joins and aggregations over whole batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """The batch's rows, and the stored rows of other keys."""
    return stored.join(batch.select(*keys), keys, "left_anti").unionByName(batch)


def remove(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows whose key is not in `gone`, children of removed rows included."""
    return stored.join(gone.select(*keys), keys, "left_anti")


def removed(stored: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """One row, `deleted`: whether any stored row has a key in `gone`."""
    hit = stored.join(gone.select(*keys), keys, "left_semi").limit(1)
    return hit.agg((F.count("*") > 0).alias("deleted"))


def append(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """All stored rows and all of the batch's, whatever repeats: runs are kept side by side."""
    return stored.unionByName(batch, allowMissingColumns=True)


def record(stored: DataFrame, batch: DataFrame, *, user: str) -> DataFrame:
    """Records appended to those there are; what no user is known of is not recorded."""
    return append(stored, batch.where(F.col(user).isNotNull()))


def update(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """Stored rows with the batch's values where these are not null; keys that nothing is stored under change nothing.

    The batch holds a key once.
    """
    given = [c for c in batch.columns if c not in keys]
    new = batch.select(*keys, F.struct(*given).alias("_new")) if given else batch.select(*keys, F.lit(None).alias("_new"))
    joined = stored.join(new, keys, "left")
    return joined.select(*(F.coalesce(F.col("_new")[c], F.col(c)).alias(c) if c in given else F.col(c) for c in stored.columns))


def seed(stored: DataFrame, defaults: DataFrame) -> DataFrame:
    """`defaults` if nothing is stored, else what is stored."""
    return defaults.select(*stored.columns) if stored.isEmpty() else stored


def _last_text(column: str, ordinal: str = "ordinal"):
    """Of the non-empty values the last by ordinal."""
    some = F.nullif(F.col(column), F.lit(""))
    return F.max_by(some, F.when(some.isNotNull(), F.col(ordinal)))


def _numbered(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Both sides, stored rows before all of the batch's."""
    return stored.withColumn("ordinal", F.lit(-1).cast("long")).unionByName(batch.withColumn("ordinal", F.col("ordinal").cast("long")), allowMissingColumns=True)


def merge_entity_rows(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Entities by canonical_name: mention counts summed, the description the batch's last non-empty one or else the stored
    one, name and type those first seen.

    Both sides hold canonical_name, name, type, description and mention_count, and the batch an ordinal. What belongs
    to an entity in any number, its articles and spellings, is kept by `merge_links`; no row grows with them.
    """
    return _numbered(stored, batch).groupBy("canonical_name").agg(
        F.min_by("name", "ordinal").alias("name"),
        F.min_by("type", "ordinal").alias("type"),
        _last_text("description").alias("description"),
        F.sum("mention_count").alias("mention_count"),
    )


def merge_relationship_rows(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Edges by (source, target, relation_type): weights summed, the last non-empty description; articles are links."""
    return _numbered(stored, batch).groupBy("source", "target", "relation_type").agg(F.sum("weight").alias("weight"), _last_text("description").alias("description"))


def merge_links(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Rows such as (canonical_name, article) or (canonical_name, alias) of either side, each once; null ends are left out."""
    some = batch.select(*stored.columns)
    for c in stored.columns:
        some = some.where(F.col(c).isNotNull())
    return stored.union(some).distinct()


def merge_entities(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """As `merge_entity_rows`, with article_ids and aliases united as arrays: for entities of a bounded number of either.

    Sets are united element by element, so that no row holds more than the result does; that row holds all of them.
    """
    base, rows = merge_entity_rows(stored, batch), _numbered(stored, batch)
    for column in ("article_ids", "aliases"):
        single = rows.select("canonical_name", F.explode(column).alias("one")).distinct()
        sets = single.groupBy("canonical_name").agg(F.array_sort(F.collect_list("one")).alias(column))
        base = base.join(sets.hint("shuffle_hash"), "canonical_name", "left")  # no set goes through the driver
    return base


def merge_relationships(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """As `merge_relationship_rows`, with article ids united as arrays: for edges of a bounded number of them."""
    keys = ["source", "target", "relation_type"]
    base, rows = merge_relationship_rows(stored, batch), _numbered(stored, batch)
    single = rows.select(*keys, F.explode("article_ids").alias("one")).distinct()
    return base.join(single.groupBy(*keys).agg(F.array_sort(F.collect_list("one")).alias("article_ids")), keys, "left")


def merge_memories(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Memories by (conversation, type): a batch row with content replaces the stored one and counts its version up.

    Where both sides hold `updated_at`, the batch's is kept with its content. The batch holds a memory once.
    """
    keys = ["conv_id", "memory_type"]
    when = ["updated_at"] if "updated_at" in stored.columns and "updated_at" in batch.columns else []
    new = batch.where(F.coalesce("content", F.lit("")) != "")
    new = new.join(stored.select(*keys, F.col("version").alias("old")), keys, "left")
    new = new.select(*keys, "content", (F.coalesce("old", F.lit(0)) + 1).alias("version"), *when)
    return upsert(stored.select(*keys, "content", "version", *when), new, keys)
