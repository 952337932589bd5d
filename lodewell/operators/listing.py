"""Pages, counts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.types import BinaryType, DateType, DecimalType, StructField, TimestampNTZType, TimestampType

from lodewell.functions.names import fresh
from lodewell.sources.tables import materialize


def page(df: DataFrame, number: int, size: int, *order: Column) -> DataFrame:
    """Page `number` (from 1), with total and pages of the whole listing on every row."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((number - 1) * size).limit(size)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", F.floor((F.col("total") + size - 1) / size))  # one row


def after(df: DataFrame, size: int, cursor: tuple | None, when: str, key: str) -> DataFrame:
    """The `size` newest rows before the cursor (when, key), each with has_more: whether another page follows."""
    if cursor is not None:
        earlier = (F.col(when) < F.lit(cursor[0])) | ((F.col(when) == F.lit(cursor[0])) & (F.col(key) < F.lit(cursor[1])))
        df = df.where(earlier)
    probe = df.orderBy(F.desc(when), F.desc(key)).limit(size + 1)
    rows = probe.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(when), F.desc(key))))
    rows = rows.withColumn("has_more", F.max("rank").over(Window.partitionBy()) > size)
    return rows.where(F.col("rank") <= size).drop("rank")


def latest(df: DataFrame, n: int, group: str, order: str) -> DataFrame:
    """The n last rows of each group."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def touching(pairs: DataFrame, wanted: DataFrame, member: str, keys: list[str]) -> DataFrame:
    """The distinct `keys` of those pairs (keys, member) whose member is in `wanted`; no key's members are gathered."""
    return pairs.join(wanted.select(F.col(wanted.columns[0]).alias(member)), member, "left_semi").select(*keys).distinct()


def overlapping(df: DataFrame, ids: str, wanted: DataFrame, key: str) -> DataFrame:
    """Rows whose array `ids` shares an element with `wanted`."""
    return df.join(_hits(df, ids, wanted, key), key, "left_semi")


def _hits(df: DataFrame, ids: str, wanted: DataFrame, key: str) -> DataFrame:
    member = wanted.columns[0]
    return df.select(key, F.explode(ids).alias(member)).join(wanted, member, "left_semi").select(key).distinct()


def json_rows(df: DataFrame) -> Column:
    """Each row as a JSON object, nulls included: times in ISO 8601, decimals as numbers of double precision, any other
    value that JSON has no type for as text."""

    def plain(field: StructField) -> Column:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (TimestampType, TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
        elif isinstance(field.dataType, DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(field.dataType, DecimalType):
            c = c.cast("double")
        elif isinstance(field.dataType, BinaryType):
            c = F.base64(c)
        return c.alias(field.name)

    return F.to_json(F.struct(*map(plain, df.schema.fields)), {"ignoreNullFields": "false"})


def appended(stored: DataFrame, batch: DataFrame, key: str, items: str) -> DataFrame:
    """(key, items) with the batch's items behind those stored, repeats kept; a key on either side is in the result."""
    new = batch.select(F.col(key), F.col(items).alias("_new"))
    both = stored.select(key, items).join(new, key, "full_outer")
    none = F.array().cast(stored.schema[items].dataType)
    return both.select(key, F.concat(F.coalesce(items, none), F.coalesce("_new", none)).alias(items))


def newest(df: DataFrame, n: int, *, when: str, key: str, since: Column | None = None, **equal) -> DataFrame:
    """The n newest rows, of those of one time the smallest keys first; only rows no older than `since`, and only those
    whose columns equal the values given, where a value is not None. Undated rows come last, and go if there is a `since`."""
    for name, value in equal.items():
        df = df if value is None else df.where(F.col(name) == value)
    df = df if since is None else df.where(F.col(when) >= since)
    return df.orderBy(F.desc_nulls_last(when), key).limit(n)


def numbered(df: DataFrame, group: str, *order: str, name: str = "item") -> DataFrame:
    """`df` with the place of each row in its group, from 0, in the order of the columns `order`; null is a group.

    Rows are dealt by ranges of (group, order) and written, so that a group of any size lies in several ranges and is
    never in one task: a row's number is its place within its range and the rows of its group in the ranges before.
    Rows equal in all of `order` are numbered in any order, each with a number of its own.
    """
    part, before, rank = (fresh(df, n) for n in ("_range", "_before", "_rank"))
    rows = materialize(df.repartitionByRange(group, *order).withColumn(part, F.spark_partition_id()), "ranges")
    sizes = rows.groupBy(group, part).agg(F.count("*").alias(before))
    sizes = sizes.withColumn(before, F.sum(before).over(Window.partitionBy(group).orderBy(part)) - F.col(before))
    sizes = sizes.select(F.col(group).alias("_group"), F.col(part).alias("_part"), before)
    place = F.row_number().over(Window.partitionBy(part, group).orderBy(*order)) - 1
    ranked = rows.withColumn(rank, place).join(sizes, F.col(group).eqNullSafe(F.col("_group")) & (F.col(part) == F.col("_part")))
    return ranked.select(*df.columns, (F.col(rank) + F.col(before)).cast("long").alias(name))
